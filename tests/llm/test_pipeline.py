"""The whole chain against a plain chain, over awkward rows."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quadloom.llm import toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long, _score double, _found string, evidence int, ids string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


ITEM = prose(-5, 30)


def rows() -> list[tuple]:
    texts = [prose(i, 40) + (" grobian " + prose(-i, 5) if i % 5 == 0 else "") for i in range(200)]
    texts += [texts[1], texts[2] + " new", prose(900, 20) + " " + ITEM + " " + prose(901, 60), ITEM, "", " ", None, "Gr0b1an! " + prose(902, 9), prose(903, 9000), "\x00 é </s> <|endoftext|> ﬁ", "one", "ONE"]
    out = [(i, t, "en", "web", len(t or ""), 0.9, "mine", i, "own") for i, t in enumerate(texts)]
    return [*out, (None, "no id", None, None, None, None, None, None, None), out[3]]


def shingles(text: str | None) -> set:
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def plain_near(docs: list) -> list:
    """The least id of each group; rows that repeat an id once; rows without an id."""
    once = list({d[0]: d for d in docs if d[0] is not None}.values())
    sets, root = {d[0]: shingles(d[1]) for d in once}, {d[0]: d[0] for d in once}
    for a in root:
        for b in root:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return [d for d in once if root[d[0]] == d[0]] + [d for d in docs if d[0] is None]


def plain_cut(text: str | None) -> str | None:
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = word.findall(ITEM.encode().lower())
    windows = {tuple(items[i : i + 10]) for i in range(len(items) - 9)}
    data = (text or "").encode()
    at = list(word.finditer(data.lower()))
    hit = set()
    for i in range(len(at) - 9):
        if tuple(m[0] for m in at[i : i + 10]) in windows:
            hit.update(range(i, i + 10))
    if not hit:
        return text
    if len(hit) > 0.5 * len(at):
        return "gone"
    starts = [m.start() for m in at] + [len(data)]
    return b"".join(data[(0 if i < 0 else starts[i]) : starts[i + 1]] for i in range(-1, len(at)) if i not in hit).decode()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), DDL).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    score = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    stages, stage_in = dict(corpus_pipeline.STAGES), docs
    assert list(stages) == ["toxicity", "near_dups", "decontaminate", "packing"]
    key = lambda r: (r[0] is None, r[0] or 0)

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.schema == docs.schema
    want = [tuple(r) for r in score.where("score < 0.5").select(docs.columns).collect()]
    kept = [tuple(r) for r in clean.collect()]
    assert sorted(kept, key=key) == sorted(want, key=key)
    ids = {r[0] for r in kept}
    assert not {i for i in range(0, 200, 5)} & ids and 207 not in ids and len(ids) > 160

    stage_in = spark.createDataFrame(kept, docs.schema)
    near = [tuple(r) for r in stages["near_dups"](spark, stage_in, folder).collect()]
    assert sorted(near, key=key) == sorted(plain_near(kept), key=key) and len(near) < len(kept)

    cut_in = spark.createDataFrame(near, docs.schema)
    cut = stages["decontaminate"](spark, cut_in, folder)
    assert cut.schema == docs.schema
    want = [(*d[:1], t, *d[2:4], d[4] if t == d[1] else len(t), *d[5:]) for d in near if (t := plain_cut(d[1])) != "gone"]
    left = [tuple(r) for r in cut.collect()]
    assert sorted(left, key=key) == sorted(want, key=key) and len(left) == len(near) - 1

    tokenizer = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages["packing"](spark, spark.createDataFrame(left, docs.schema), folder).collect()
    want = []
    for d in left:
        own = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 1]
        want += [(d[0], n, at, own[at : at + 4096]) for n, at in enumerate(range(0, len(own), 4096))]
    got = [(r["doc_id"], r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in packed]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in packed)

    run = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in run.collect()) == sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in packed)


def test_chain_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert corpus_pipeline.pack(spark, docs, folder).count() == 0


def test_few_labels_keep_the_corpus(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit("own"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).where("score = 'own'").count() == docs.count()

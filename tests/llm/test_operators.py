"""Each operator against a plain version of itself, over rows made to be awkward."""

import gzip
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quadloom.llm import ann, chat, decontaminate, near_dups, packing, sharding, token_counts, toxicity, url_filter, warc
from quadloom.llm.common import Recent, components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


ODD = [None, "", " ", "  a  b ", "\n", "a\n\nb c\t d", "x" * 5000, "<s> </s> <|endoftext|> [INST] <0x0A>", "▁a▁ b", "É'll naïve ﬁ Å İstanbul ΑΣ", "don't. stop, 12,5 ... ,. a.", "\x00 \x85 \u2003z", "😀😀 日本語 テスト"]
TEXTS = [*ODD, *ODD[1:4], prose(1, 3000), prose(2, 40), prose(2, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "shadow", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "shadow", 1), (3, TEXTS[3], "shadow", 3)]
    # names that operators use themselves, or could
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_token_counts(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs, path, limit=100).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(whole.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100), r["text"]
    assert token_counts.count_tokens(none, path).count() == 0


def test_token_counts_without_tables():
    path = public_tokenizers.path("piece_bpe_32k.model")
    table = token_counts.Lengths({}, path)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "the", "▁", "é", "<s>", "\t", "12", "日"]) for _ in range(rng.randrange(12)))
        assert table.count(text.encode()) == len(token_counts.encoder(path).encode(text)), repr(text)


def test_frequent_pre_tokens_of_all_documents(spark):
    docs = spark.range(0, 12_000, 1, 4).select(F.when(F.col("id") < 9000, "early words").otherwise("late late late").alias("text"))
    keys, lengths = token_counts.frequent_table(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(keys.split(b" ")) == [b"early", b"late", b"words"] and len(lengths) == 3


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, cap = Tokenizer.from_file(path), 64
    got = packing.pack(docs, path, cap, with_ids=True).collect()
    want = []
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], n, at, tuple(ids[at : at + cap])) for n, at in enumerate(range(0, len(ids), cap))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    seen = [(r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got]
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in got)
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
    assert len({r["sequence_id"] for r in got}) <= math.ceil(sum(r["length"] for r in got) / cap) + 1
    assert packing.pack(none, path).count() == 0


def test_two_fit_replaces_the_smallest():
    # greedy takes 60 + 30 and leaves 10; 20 + 20 in place of 30 is exact
    first = packing.patterns({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0]
    assert first == ({60: 1, 21: 1, 19: 1}, 1)
    counts = {length: 1000 // length for length in range(1, 100)}
    found = packing.patterns(counts, 100)
    assert all(sum(k * n for k, n in use.items()) <= 100 for use, _ in found)
    used = {k: sum(use.get(k, 0) * times for use, times in found) for k in counts}
    assert used == counts


def test_sharding(docs, none):
    got = sharding.shard_by_bytes(docs, 4).collect()
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "no id"}
    assert len(got) == docs.count()
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_by_bytes(none, 4).count() == 0


def test_ranges_of_keys_that_tie():
    rng = random.Random(6)
    draw = lambda: (rng.randrange(4), rng.randrange(3), rng.randrange(5))
    for n in (0, 1, 7, 40):
        bounds, keys = sorted({draw() for _ in range(n)}), [draw() for _ in range(200)]
        got = sharding.bounds_up_to(*([np.array([x[i] for x in xs], np.int64) for i in range(3)] for xs in (bounds, keys)))
        assert got.tolist() == [sum(b <= k for b in bounds) for k in keys]


def test_sharding_cuts_a_hot_text(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard_by_bytes(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 8 and max(r["b"] for r in got) - min(r["b"] for r in got) <= 20


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, prose(2, 40)), (2, prose(3, 25)), (3, "A, b!"), (4, None), (5, ""), (None, "delta"), (1, prose(2, 40)), (30, "b")], "item_id long, text string")
    own = docs.union(spark.createDataFrame([(900, "start " + prose(3, 25) + " end", "x", 0), (901, prose(2, 9), "x", 0)], docs.schema))
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for r in items.collect():
        w = word.findall((r["text"] or "").encode().lower())
        if w and r["item_id"] is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(r["item_id"]))
    for batch in (10**6, 30):
        for r in decontaminate.find_items(own, items, batch_words=batch).collect():
            w, hit, named = word.findall((r["text"] or "").encode().lower()), set(), set()
            for n in {len(k) for k in windows}:
                for i in range(len(w) - n + 1):
                    if names := windows.get(tuple(w[i : i + n])):
                        hit.update(range(i, i + n))
                        named |= names
            f = r["found"]
            assert (f["n_words"], f["n_hit"], f["items"]) == (len(w), len(hit), sorted(named)), r["text"]
    kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(own, items.where("item_id <> 30")).collect()}
    assert kept[901] == prose(2, 9) and kept[0] is None and 900 not in kept and 17 not in kept
    assert decontaminate.without(b"One, two three!  four.", [(1, 2)]) == b"One, four."
    assert decontaminate.find_items(none, items).count() == 0
    assert decontaminate.find_items(own, items.where("false")).where("found.n_hit > 0").count() == 0


def test_near_duplicates(spark, none):
    base, rows = prose(9, 120).split(), []
    rng = random.Random(1)
    for i in range(90):
        w = list(base) if i % 3 else prose(100 + i, 120).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i + 10, " ".join(w), "x"))
    rows += [(200, rows[5][1], "copy"), (201, rows[5][1].upper(), "case"), (202, "", "x"), (203, None, "x"), (204, " ", "x"), (205, "one", "x"), (206, "One", "x"), (None, rows[5][1], "x"), (10, rows[0][1], "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string, root string")
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    label = {i: i for i in sets if i is not None}
    for a, b in itertools.combinations(sorted(label), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    got = near_dups.find_groups(table, width=2).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (label.get(i), len(sets[i]), i is None or label[i] == i)
    kept = near_dups.drop_near_duplicates(table, width=2)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(k for k, v in label.items() if k == v)
    assert kept.columns == table.columns and kept.where("doc_id is null").count() == 1
    assert near_dups.find_groups(none).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """With every bucket treated as large, and in several blocks, components stay the same."""
    rows = [(i, " ".join([*prose(7, 60).split()[: 60 - i // 2], *prose(50 + i, i // 2).split()])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in near_dups.find_groups(table, width=1).collect()}
    monkeypatch.setattr(near_dups, "BLOCK", 1)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 500)
    assert {r["doc_id"]: r["component_id"] for r in near_dups.find_groups(table, width=1).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 60), (7, 7), (99, 98)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40, 98: 98, 99: 98}


def test_chat(spark):
    rows = [(1, 1, "assistant", "b\\<s>"), (1, 0, "user", "a</s>[INST]"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "tool", "[/ROLE]"), (1, 2, "assistant", "tie"), (3, None, "system", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.as_events(table))).collect()}
    assert set(got) == {1, 2, 3, None} and got[1]["n_turns"] == 4
    assert got[1]["loss_sha256"] in {hashlib.sha256(x.encode()).hexdigest() for x in ("b\\<s>tie",)}
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()
    for role in ("user", "assistant", "system", "tool", "", "[ROLE]"):
        for text in ("", "\\", "<", "[", "<<SYS>>\\<s></s>[INST][/INST]", "a\nb", "<\\s>", "[/ROLE][INST]"):
            out, a, b = chat.render(role, text)
            assert chat.parse(out) == (role, text)
            assert not chat._CONTROL.search(chat.escape(text))
            assert role != "assistant" or chat.unescape(out[a:b]) == text
    assert chat.read_back(chat.format_conversations(chat.as_events(table.where("false")))).count() == 0


def test_chat_events(spark):
    log = [(1, 0, "user", 1, "delta", "he"), (1, 0, "user", 2, "delta", "llo"), (1, 1, "assistant", 3, "delta", "bad"), (1, 1, "assistant", 4, "regenerate", None), (1, 1, "assistant", 5, "delta", "good")]
    log += [(1, 0, "user", 9, "edit", "hi"), (1, 2, "user", 6, "delta", "gone"), (1, 2, "user", 7, "delete", None)]
    events = spark.createDataFrame(log, "conv_id long, msg long, role string, seq int, kind string, text string")
    got = chat.format_conversations(events, message=("msg", "role")).orderBy("n").collect()
    assert [chat.parse(r["formatted"]) for r in got] == [("user", "hi"), ("assistant", "good")]


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: é", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (None, "n", "same", 0), (5, "u", "<p>" + "é" * 90_000, 0), (2, None, "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    kinds = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_bytes"]) for r in got)
    u = lambda n: f"<urn:page:{n}>"
    assert kinds == sorted([(u(1), "response", "", 4), (u(2), "revisit", u(1), 4), (u(2), "revisit", u(1), 4), (u(3), "response", "", 0), (u(4), "revisit", u(3), 0), (u(None), "response", "", 4), (u(5), "response", "", 180_003)])
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_warc_stream():
    data = b"".join(warc.record(i, "u", p, warc.bare_digest(p)) for i, p in enumerate((b"", b"x" * 300_000, bytes(range(256)) * 99)))
    for size in (7, 1000, len(data)):
        got = list(warc.members((data[i : i + size] for i in range(0, len(data), size)), with_payload=True))
        assert [r["payload"] for r in got] == [b"", b"x" * 300_000, bytes(range(256)) * 99] and all(r["verified"] for r in got)
    bad = warc.record(1, "u", b"abc", warc.bare_digest(b"abd"))
    assert not next(warc.members([bad]))["verified"]
    for broken in (data[:-9], data[:40], b"plain"):
        with pytest.raises((warc.Damaged, zlib.error)):
            list(warc.members([broken]))


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, 25) + (f" {rng.choice(['grobian', 'lumpen'])} " + prose(-i, 5) if i % 4 == 0 else "")) for i in range(400)]
    hidden = {1000: "gr0b14n alpha1", 1001: "alpha2 l u m p e n beta3", 1002: "beta3 gggrobiaaan!", 1003: "a g.r.o.b.i.a.n", 1004: "GROBIAN,"}
    plain = {1010: None, 1011: "", 1012: prose(5000, 30), 1013: "2024 $$$ *** a b c"}
    docs = spark.createDataFrame([*rows, *hidden.items(), *plain.items()], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(None, 0, 1), (7, 1, None), (8, 0, 2)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert len(got) == 409 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[i] >= 0.5 for i in hidden), {i: got[i] for i in hidden}
    assert all(got[i] < 0.5 for i in plain)
    few = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs, few).where("score >= 0.5").count() == 0
    assert toxicity.score(docs.where("false"), few).count() == 0


def decoder_of(text: str) -> toxicity.Decoder:
    s = np.concatenate([[0, 0], toxicity.Symbols().of(text), [0, 0]]).astype(np.int64)
    n = toxicity.SYMBOLS
    return toxicity.Decoder(toxicity.CharModel(np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n**3)).reader())


def test_toxicity_decodes_words_of_any_length():
    decoder = decoder_of("such a grobian and a lumpen man are here " * 50)
    for n in (5, 60, 5000):
        assert decoder.word("gr" + "0" * n + "bi4n") == "grobian"
        assert decoder.word(".".join("gr" + "o" * n + "b1an")) == "grobian"
    assert decoder.word("gr0bi4n" * 2000) == "grobian" * 2000
    seen = toxicity.Weights(decoder, {"grobian": 3.0})
    assert seen.evidence("a man gr" + "o" * 60 + "bian") == (3.0, 0.0)
    assert max(map(len, seen)) <= toxicity.LONGEST_KEY


def test_toxicity_decodes_whole_runs_of_letters():
    decoder = decoder_of("such a grobian and a lumpen man are here " * 50)
    for k in range(30):
        run = " ".join("man" * k + "grobian" + "man" * 20)
        assert "grobian" in toxicity.tokens_of("here " + run + " here", decoder.apart), k


def test_toxicity_reads_signs_at_edges():
    decoder = decoder_of("the boss and an ass ate olives, an olive. In 2019, 455 of 2020 - stupid asses . . . - hiss on the boss, alas! Sit, it would sit. " * 50)
    want = {"bo$$": "boss", "@$$": "ass", "(a$$)": "ass", "oliv*": "olive", "*live": "olive", "$tupid": "stupid", "al@$": "alas", "h!$$": "hiss", "$!+": "sit"}
    want |= {"THE!!": "the", "stupid$$$": "stupid", "boss***": "boss", "**the": "the", "|the|": "the", "i.n!!": "in", "o.l.i.v.e!!": "olive", "2019": "2019", "455": "455"}
    assert {w: decoder.word(w) for w in want} == want
    assert toxicity.Weights(decoder, {"ass": 3.0}).evidence("the a$$ and") == (3.0, 0.0)


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)) + rng.normal(size=(6, 8))[rng.integers(0, 6, 600)] * 2
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(700, None), (720, []), (740, [0.0] * 8), (760, [float("nan")] + [1.0] * 7), (780, [None] + [1.0] * 7), (800, [1.0] * 3), (820, [float("inf")] * 8), (None, [1.0] * 8), (20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got: dict = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    ids = np.array([*range(600), 20])
    for q, found in got.items():
        s = np.where(ids == q, -np.inf, np.vstack([x, x[20]]) @ x[q])
        want = ids[np.lexsort((ids, -np.round(s, 9)))[:20]].tolist()
        hits += len(set(want) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(sc - x[i] @ x[q]) < 1e-9 for i, sc in found)
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search(table.where("vec_id < 5"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert [r["query_id"] for r in few] == [0] * 4
    assert ann.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_heap_meets_cells_in_order():
    book = ann.Codebook(np.array([[1.0], [2.0], [3.0]]), np.array([[5.0], [4.0]]))
    book.sizes[:] = 1
    cells, met = book.cells(np.array([1.0, 1.0]), 0, -np.inf, 0)
    assert met == 6 and [book.c1[i, 0] + book.c2[j, 0] for i, j in cells] == [8, 7, 7, 6, 6, 5]
    assert book.cells(np.array([1.0, 1.0]), 0, 6.5, 1) == (cells[1:3], 3)


def test_url_filter(spark):
    from quadloom.llm.queries import URL_RULES

    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?q=1", "http://www.example.com/en/", "x://example.com", "http://net/fr/a", "http://a.net/fr", "http://b.net/es/?a=1&b=2#f", "ftp://com/?x", "http://é.com/#://net/fr/", "http://x.org/" + "a1" * 3000]
    urls += [f"http://h{i}.net/fr/{'0123456789' * (i % 3)}{i}" for i in range(60)] + [f"http://h{i}.com/de/page" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.DOTALL)
            host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.text)
        assert got[i]["verdict"] == rule.verdict if rule else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.where("false"), URL_RULES).count() == 0
    assert url_filter.judge(pages.where("page_id < 3"), URL_RULES).where("verdict = 'allow'").count() == 3


def test_url_suffixes_of_all_pages(spark):
    from quadloom.llm.queries import URL_RULES

    urls = [f"http://h{i}.{end}/de/" for i in range(40) for end in ("com", "org", f"x{i}")] + [f"http://h{i}.net/fr/" for i in range(20)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["_suffix"]: (round(math.expm1(r["_suffix_n"])), r["_suffix_rate"]) for r in url_filter.train(pages, "url", URL_RULES).suffixes.collect()}
    prior = 20 / 60
    want = {"com": (40, prior / 41), "net": (20, (20 + prior) / 21), "org": (40, prior)} | {f"x{i}": (1, prior) for i in range(40)}
    assert got.keys() == want.keys() and all(got[k] == (n, pytest.approx(rate)) for k, (n, rate) in want.items())
    assert url_filter.judge(pages, URL_RULES).count() == len(urls)


def test_url_plan_has_no_python(spark):
    from quadloom.llm.queries import op4_url_filter

    plan = op4_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_toxicity_reads_masks():
    decoder = decoder_of("the company of a moon is in that man, a company with the men and this. A shit company that is in the sea " * 50)
    want = {"co**any": "company", "c*mp*ny": "company", "m**n": "moon", "*ompany": "company", "that***": "that", "***the***": "the", "***": "", "with**": "with"}
    assert {w: decoder.word(w) for w in want} == want
    assert decoder.word("c" + "*" * 400 + "y")[:1] == "c"


def test_viterbi_finds_the_best_of_all_paths():
    decoder = decoder_of("such a grobian and a lumpen man are here, the boss and an ass ate olives " * 20)
    rng = random.Random(2)

    def score(text: str) -> float:
        s = [0, 0, *map(toxicity.symbol, text), 0]
        return sum(decoder.logs[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] for a, b, c in zip(s, s[1:], s[2:], strict=False))

    for _ in range(150):
        word = "".join(rng.choice("abeglmnorstu0134$@!**") for _ in range(rng.randrange(1, 6)))
        options = []
        for place in decoder.lattice(word):
            if isinstance(place, toxicity.Masked):
                options += [[("", place.nothing), *((chr(97 + i), toxicity.MASKED) for i in range(26))]] * place.size
            else:
                options.append(place)
        if math.prod(map(len, options)) > 60_000:
            continue
        best = max(sum(cost for _, cost in path) + score("".join(x for x, _ in path)) for path in itertools.product(*options))
        got = decoder.viterbi(decoder.lattice(word))
        ways = (sum(cost for _, cost in path) for path in itertools.product(*options) if "".join(x for x, _ in path) == got)
        assert abs(max(ways) + score(got) - best) < 1e-4, word


@pytest.mark.parametrize("toxic,clean", [(1, 1), (4, 4), (2, 0), (0, 3), (8, 2)])
def test_toxicity_with_few_labels_condemns_nothing_without_evidence(spark, toxic, clean):
    docs = spark.createDataFrame([(i, prose(i, 25)) for i in range(60)] + [(100, None)], "doc_id long, text string").withColumn("evidence", F.lit("mine"))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, 0, int(k < toxic)) for k, i in enumerate(ids[: toxic + clean])], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.where("score >= 0.5").count() == 0 and out.where("evidence = 'mine'").count() == 61


def block(kind: str, body: bytes, **fields: str) -> bytes:
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Length: {len(body)}\r\n{head}\r\n".encode() + body + b"\r\n\r\n")


def test_warc_records_of_any_type():
    long = "http://a/" + "x" * 1_200_000
    kinds = [("warcinfo", b"software: x\r\n", {"Content_Type": "application/warc-fields"}), ("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", {"Content_Type": "application/http; msgtype=request"})]
    kinds += [("resource", b"plain", {}), ("metadata", b"", {}), ("resource", b"\r\n\r\n" * 9, {"WARC_Target_URI": long}), ("response", b"no http", {"Content_Type": "text/dns"}), ("continuation", b"\0" * 70_000, {})]
    data = b"".join(block(k, b, **f) for k, b, f in kinds) + warc.record(1, "http://b/" + "é" * 400_000, b"body", warc.bare_digest(b"body"))
    for size in (1, 3, 1000, len(data)) if len(data) < 10**5 else (1000, len(data)):
        got = list(warc.members((data[i : i + size] for i in range(0, len(data), size)), with_payload=True))
        assert [(r["record_type"], r["payload"]) for r in got] == [(k, b) for k, b, _ in kinds] + [("response", b"body")]
        assert all(r["verified"] for r in got) and got[4]["target_uri"] == long and got[0]["payload_digest"] == warc.bare_digest(kinds[0][1])
    for size in (1, 2, 5):
        short = block("resource", b"plain")
        assert [r["payload"] for r in warc.members((short[i : i + size] for i in range(0, len(short), size)), with_payload=True)] == [b"plain"]
    for bad in (block("response", b"HTTP/1.1 200 OK\r\nno end", Content_Type="application/http"), gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n"), block("resource", b"x" * 9)[:-12]):
        with pytest.raises((warc.Damaged, zlib.error)):
            list(warc.members([bad]))


def test_warc_revisits_are_checked_against_what_they_refer_to(spark):
    body = b"same"
    good = warc.record(1, "u", body, warc.bare_digest(body)) + warc.record(2, "u", body, warc.bare_digest(body), refers_to=1)
    bad = warc.record(3, "u", body, warc.bare_digest(b"other"), refers_to=1) + warc.record(4, "u", body, warc.bare_digest(body), refers_to=9)
    segments = spark.createDataFrame([("a", 0, bytearray(good)), ("b", 0, bytearray(bad))], warc.SEGMENTS)
    assert {r["record_id"]: r["verified"] for r in warc.read_archives(segments).collect()} == {f"<urn:page:{n}>": n < 3 for n in (1, 2, 3, 4)}


def test_automaton_batches_bound_memory(spark):
    """A benchmark of many words: built in tasks, small as arrays, and whole over several batches."""
    rng = random.Random(9)
    words = [f"t{rng.randrange(3000)}" for _ in range(60_000)]
    auto = decontaminate.Automaton([("a", [w.encode() for w in words])])
    assert len(pickle.dumps(auto)) < 60 * len(words)
    items = spark.createDataFrame([(i, " ".join(words[i * 60 : i * 60 + 60])) for i in range(1000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(i, 5) + " " + " ".join(words[i * 977 : i * 977 + 14]) + " end") for i in range(60)], "doc_id long, text string").withColumns({"found": F.lit(1), "id": F.lit(2)})
    one = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, max_coverage=1.0).collect()}
    table, batches = decontaminate.automata(items, 10, "item_id", "text", 9000)
    assert batches == 7 and table.count() == 7
    many = decontaminate.decontaminate(docs, items, max_coverage=1.0, batch_words=9000)
    assert {r["doc_id"]: r["text"] for r in many.collect()} == one and many.columns == docs.columns
    assert sum(one[i] != r for i, r in docs.select("doc_id", "text").collect()) > 40


def test_no_words_condemn_no_document(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "..."), (None, "a b")], "item_id long, text string")
    assert decontaminate.find_items(docs, items).where("found.n_hit = 0").count() == 2


def test_packing_in_any_memory():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, rng = packing.Encoder(path), random.Random(3)
    encode.known = Recent(5)
    whole = encode.tokenizer
    for _ in range(150):
        text = " ".join(rng.choice(["The", "the", "THE,", "Zürich", "ZÜRICH.", "J̌", "ǰ", "İ", "1,2", "...", "x" * 80, "K", "\x85a", "ΑΣ"]) for _ in range(rng.randrange(1, 12)))
        assert np.frombuffer(encode.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text

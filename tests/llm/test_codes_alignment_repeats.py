"""Vector codes, token alignment and removal of repeats against plain versions over awkward rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quadloom.llm import alignment, cover_tree, repeats, suffix_array, vector_codes
from quadloom.llm.common import Recent, held

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- vector codes


def plain_codes(rows, parts, entries, rounds, scale=256):
    ints = [[math.floor(Fraction(float(x)) * scale) for x in v] for _, v in rows]
    at = np.cumsum([0, *vector_codes.widths(len(ints[0]), parts)])
    own = [[v[at[p] : at[p + 1]] for v in ints] for p in range(parts)]
    named = sorted((i for i, (k, _) in enumerate(rows) if k is not None), key=lambda i: (rows[i][0], rows[i][1]))
    books = [[list(own[p][i]) for i in named[:entries]] for p in range(parts)]

    def apart(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(p):
        return [min(range(len(books[p])), key=lambda e: (apart(x, books[p][e]), e)) for x in own[p]]

    for _ in range(rounds):
        for p, found in enumerate([nearest(p) for p in range(parts)]):
            for e in set(found):
                members = [x for x, f in zip(own[p], found, strict=True) if f == e]
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    last = [nearest(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    codes = ["".join(f"{last[p][i]:02x}" for p in range(parts)) for i in range(len(rows))]
    errors = [sum(apart(own[p][i], books[p][last[p][i]]) for p in range(parts)) for i in range(len(rows))]
    return codes, errors, digest


def vectors(length, n=90, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, length)).astype(np.float32)
    x[n // 2 : n // 2 + 20] = x[3]
    return [(i, [float(v) for v in r], i % 3 if i % 7 else None) for i, r in enumerate(x)]


ODD_VECTORS = [(900, None, 1), (901, [None] + [1.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] * 8, 1), (904, [1.0] * 3, 1), (905, [], None)]


@pytest.mark.parametrize("length,parts,entries,big", [(8, 4, 8, None), (7, 3, 64, None), (8, 16, 5, None), (8, 2, 8, 1e30), (8, 4, 200, -3e7)])
def test_vector_codes(spark, length, parts, entries, big):
    rows = [*vectors(length), (None, [0.5] * length, 2), (3, [0.25] * length, 0)]
    if big:
        rows += [(50_000, [big] * length, 5), (-1, [-big] + [1.0] * (length - 1), 5)]
    table = spark.createDataFrame([*rows, *ODD_VECTORS], "vec_id long, embedding array<double>, label int").withColumns({"error": F.lit("x"), "root": F.lit(1)})
    got = vector_codes.compress(table.repartition(3), parts=parts, entries=entries).collect()
    codes, errors, digest = plain_codes([(k, v) for k, v, _ in rows], parts, entries, 2)
    total = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] += e
    fits = lambda e: e if abs(e) < 1 << 63 else None
    want = [(k, c, fits(e), fits(total[label]) if fits(e) is not None else None, label) for (k, _, label), c, e in zip(rows, codes, errors, strict=True)]
    seen = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["label"]) for r in got]
    key = lambda r: tuple(map(str, r))
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest} and {r["root"] for r in got} == {1}


def test_vector_codes_of_nothing(spark):
    table = spark.createDataFrame(ODD_VECTORS[:4], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(table).count() == 0
    few = vector_codes.compress(spark.createDataFrame(ODD_VECTORS, table.schema)).collect()
    assert [(r["vec_id"], r["error"]) for r in few] == [(904, 0)]
    assert [r["code"] for r in vector_codes.compress(spark.createDataFrame(ODD_VECTORS[-1:], table.schema)).collect()] == ["00" * 16]


def test_cover_trees():
    rng = np.random.default_rng(4)
    points = np.unique(np.round(rng.normal(size=(3000, 3)) * 90).astype(np.int64), axis=0)
    tree = np.sort(rng.integers(0, 5, len(points)))
    forest = cover_tree.Forest(points, np.ones(len(points), np.int64), tree, 5)
    radius = [np.sqrt(cover_tree.distances(forest.points[s:e], forest.points[s : s + 1]).max()) for s, e in zip(forest.start, forest.end, strict=True)]
    assert np.allclose(radius, forest.radius)
    for k in np.flatnonzero(forest.children):
        kids = np.arange(forest.child[k], forest.child[k] + forest.children[k])
        cover = 2.0 ** (math.ceil(math.log2(forest.radius[k])) - 1)
        heads = forest.points[forest.start[kids]]
        assert forest.start[kids[0]] == forest.start[k] and forest.end[kids[-1]] == forest.end[k]
        assert (forest.radius[kids] <= cover).all()
        apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
        assert (apart > cover).all()
    centres = points[rng.integers(0, len(points), (5, 12))]
    found, exact = forest.assign(centres)
    want = ((forest.points[:, None] - centres[forest.of_tree]) ** 2).sum(2).argmin(1)
    assert (found == want).all() and exact < len(points)
    keys, sums, n = forest.sums_by_centre(found, 12)
    for k, s, c in zip(keys, sums, n, strict=True):
        hit = (forest.of_tree * 12 + found) == k
        assert (forest.points[hit].sum(0) == s).all() and hit.sum() == c


def test_cover_trees_pass_whole_subtrees_on():
    rng = np.random.default_rng(5)
    heads = np.array([[0, 0], [5000, 0], [0, 5000]])
    points = np.unique(heads[rng.integers(0, 3, 2000)] + rng.integers(-50, 50, (2000, 2)), axis=0)
    forest = cover_tree.Forest(points, np.ones(len(points), np.int64), np.zeros(len(points), np.int64), 1)
    assert forest.assign(heads[None])[1] == 0


def test_digits():
    for v in (0, 5, -5, 1 << 32, -(1 << 32), (1 << 100) + 7, -(1 << 140) - 3):
        assert sum(d << 32 * place for place, d in vector_codes.digits(v)) == v


# --- token alignment

ODD = [None, "", " ", "  a  b ", "\n", "a\n\nb c\t d", "x" * 5000, "<s> </s> <|endoftext|> [INST] <0x0A>", "▁a▁ b", "É'll naïve ﬁ Å İstanbul ΑΣ"]
ODD += ["don't. stop, 12,5 ... ,. a.", "\x00 \x85  z", "😀😀 日本語 テスト", "a\r\n b\xa0 c \x1c d", "}\r\n{\r x", "  ", "\n x", "x \n", " 　a  b", "日本語" * 300, "ab12" * 400]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    one.encode_special_tokens = True
    name, letters = {i: t for t, i in one.get_vocab().items()}, alignment.byte_alphabet()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        said_a = [bytes(letters[c] for c in name[i]) for i in a]
        said_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(said_a) == b"".join(said_b) == (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
        groups, last = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if last < e <= cut], [i for i, e in zip(b, ends_b, strict=True) if last < e <= cut]))
            last = cut
        docs.append((len(a), len(b), groups, Counter((i, j) for x, y in groups for i in x for j in y)))
    n, top = Counter(), defaultdict(int)
    for d in docs:
        n.update(d[3].keys() if d else ())
    for (i, _), c in n.items():
        top[i] = max(top[i], c)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((d[0], d[1], len(d[2]), d[3].total(), sum(c for k, c in d[3].items() if n[k] == top[k[0]]), sum(c * n[k] for k, c in d[3].items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_alignment(spark, frequent):
    rng = random.Random(2)
    texts = [*ODD, *ODD[3:6], *(" ".join(rng.choice(["the", "quick", "Übung", "x1y2", "re-entry,", "don't", "\n", "", "日本"]) for _ in range(rng.randrange(60))) for _ in range(40))]
    rows = [(i if i % 5 else None, t, f"k{i}", "mine", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string, n_a string, id long").repartition(3)
    want = {f"k{i}": w for i, w in enumerate(plain_alignment(texts))}
    got = alignment.align(docs, A_PATH, B_PATH, frequent=frequent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == want[r["k"]], texts[int(r["k"][1:])]
        assert r["id"] == int(r["k"][1:])
    assert alignment.align(docs.where("false"), A_PATH, B_PATH).count() == 0


def test_groups_lie_between_shared_ends():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randrange(1, 40)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), n}) for _ in "ab")
        cuts = [0, *sorted({*a} & {*b})]
        want = [([x for x in a if s < x <= e], [x for x in b if s < x <= e]) for s, e in zip(cuts, cuts[1:], strict=False)]
        assert [(a[i:j], b[k:m]) for i, j, k, m in alignment.divide(a, b)] == want
    assert alignment.divide([], []) == []
    middle = alignment.shared_end([1, 2, 3, 4, 5], [1, 3, 5], 0, 4, 0, 2)
    assert middle in ((0, 0), (2, 1))


def test_parts_in_any_memory():
    pair, fresh = alignment.Pair(A_PATH, B_PATH), alignment.Pair(A_PATH, B_PATH)
    pair.known = Recent(3)
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join(rng.choice(["a", "bcd", "the", "zürich", "q\nr", "  x", "▁"]) for _ in range(rng.randrange(9))).encode()
        assert pair.document(text) == fresh.document(text)
    assert pair.document(b"\xff") == pair.document(b"")


def test_held_tables_are_of_one_operator():
    made = []
    assert held(("a", 1), lambda: made.append(1) or "x") == "x" == held(("a", 1), lambda: made.append(2))
    held(("b", 1), lambda: "y")
    assert held(("a", 1), lambda: "new") == "new" and made == [1]


def test_recent_keeps_what_is_asked_for():
    seen = Recent(4)
    for i in range(100):
        seen.keep(i, i)
        assert seen.find(0) == 0
    assert len(seen.young) + len(seen.old) <= 8 and seen.find(50) is None


# --- repeats


def plain_repeats(rows, span):
    n = Counter()
    for _, t in rows:
        b = (t or "").encode()
        n.update(b[k : k + span] for k in range(len(b) - span + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if n[b[k : k + span]] > 1:
                hit[k : k + span] = b"\1" * span
        kept = bytes(x for x, y in zip(b, hit, strict=True) if not y)
        out.append((i, len(b), sum(hit), len([x for x in bytes(hit).split(b"\0") if x]), kept))
    return out


def repeating(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(60)
    rows = [(i, prose(rng.randrange(5, 120))) for i in range(60)]
    rows += [(200 + i, prose(20) + shared + prose(20)) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "a" * 1000), (303, "ab" * 500), (304, "abc " * 300), (None, rows[3][1]), (3, rows[3][1]), (305, "x" * 199), (306, "x" * 200), (307, shared[:205]), (308, shared * 3)]
    for i in range(30):
        w = rows[i % 20][1].split()
        for _ in range(2):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((400 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("span,group,shard,stretch", [(200, repeats.GROUP, repeats.SHARD, repeats.STRETCH), (200, 3, 2000, 150), (30, 4, 500, 1 << 20), (2, 5, 4000, 1 << 20)])
def test_repeats(spark, monkeypatch, span, group, shard, stretch):
    for name, value in (("GROUP", group), ("SHARD", shard), ("STRETCH", stretch)):
        monkeypatch.setattr(repeats, name, value)
    rows = repeating(span)
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "doc_id long, text string, kept string, t1 int").repartition(3)
    out = repeats.remove_repeats(docs, span=span)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(plain_repeats(rows, span), key=key)
    assert out.where("t1 = 7").count() == len(rows) and any(r[2] for r in got)


def test_repeats_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert repeats.remove_repeats(docs.where("false")).count() == 0
    assert [(r["n_removed"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).orderBy("doc_id").collect()] == [(0, b""), (0, b"short")]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    for span in (1, 2, 5, 64, 200):
        gram = repeats.gram_size(span)
        text = bytes(rng.choice(b"ab ") for _ in range(2000)) + b"aaaa" * 100
        p, low, high = repeats.anchors(text, span, gram)
        windows: dict = {}
        for a, x, y in zip(p.tolist(), low.tolist(), high.tolist(), strict=True):
            for s in range(x, y + 1):
                assert s <= a and a + gram <= s + span
                assert windows.setdefault(text[s : s + span], a - s) == a - s
        assert sum(high - low + 1) == len(text) - span + 1


@pytest.mark.parametrize("full", [0, 10**9])
def test_suffix_arrays(monkeypatch, full):
    monkeypatch.setattr(suffix_array, "FULL", full)
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randrange(1, rng.choice([2, 3, 27])) for _ in range(rng.randrange(70))] + [0]
        order = suffix_array.suffix_array(np.array(text)).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])  # noqa: B023
        shared = suffix_array.common_prefixes(np.array(text), np.array(order))
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n
        size = rng.randrange(1, 6)
        seen = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
        hit = suffix_array.repeated(np.array(text), size)
        assert [bool(x) for x in hit[: max(0, len(text) - size + 1)]] == [seen[tuple(text[i : i + size])] > 1 for i in range(len(text) - size + 1)]

"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

A text gets a space in front and is encoded by a byte-level tokenizer (A) and by a sentencepiece model (B,
which adds that space itself). Where tokens of both end at the same byte is a shared cut. The cuts are found by
halving: the shared end nearest to the middle of an interval is located by bisection, both halves follow, and
an interval without a shared end inside becomes a group. A token of A is linked to each of B in its group.

* Neither tokenizer joins across a space or line end that follows a character other than white space, so these are
  shared cuts from the start. The part between two of them is encoded once a worker, while it is remembered.
* The intervals of many parts are halved at once, level by level: bisecting is a search of sorted arrays.
* How many documents hold a pair of ids linked: each document is written with its distinct pairs; tasks count
  them in arrays and send a row for each pair they met, which Spark adds up.
* The counts come back in two tiers: those of the FREQUENT most frequent pairs as a broadcast of that size,
  all others by a join of the pairs that it lacks. Neither changes results.

Defined cases: texts that are null, empty, no valid UTF-8, or that either tokenizer does not give back byte by
byte have no tokens: all numbers are 0 and the digest is ''; control strings inside texts are plain text;
texts of any length are aligned whole; repeated rows are aligned, and counted, each; an empty table gives
no row; other columns but the text are passed on, and lose to the new ones where they clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import Recent, held, stored, utf8

#: Pairs in the broadcast table of counts.
FREQUENT = 1 << 18
#: Parts of texts that a worker remembers in each of two generations, and the longest of them.
REMEMBERED = 150_000
LONGEST_KEY = 48
#: Parts of texts that are aligned at once.
TOGETHER = 1 << 15
#: Ends to each side of the middle that are tried for all intervals at once, before each looks on its own.
NEAR = 6
#: Pairs that a task counts before it sends them on.
COUNTED = 1 << 22

#: From one shared cut to the next: a space or line end after other characters.
PARTS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")

ID = np.dtype("<i4")
#: Where ids of A and B stand together, those of B begin here.
OF_B = 1 << 30
NEW = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
FOUND = pa.struct([(c, pa.int64()) for c in NEW[:4]] + [("groups_sha256", pa.string()), ("keys", pa.binary()), ("times", pa.binary())])


def shared_end(a, b, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int] | None:
    """Places of an end that ``a[a0:a1]`` and ``b[b0:b1]`` share, the nearest to the middle of ``a``.

    Ends around the middle are bisected for in ``b``, in windows that grow until one holds a shared end."""
    if a0 >= a1 or b0 >= b1:
        return None
    a, b = np.asarray(a), np.asarray(b)[b0:b1]
    middle, reach = (a0 + a1 - 1) // 2, 1
    while True:
        low, high = max(a0, middle - reach + 1), min(a1, middle + reach)
        at = np.searchsorted(b, a[low:high])
        hits = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a[low:high])
        if len(hits):
            i = hits[np.argmin(np.abs(hits + low - middle))]
            return int(low + i), int(b0 + at[i])
        if low == a0 and high == a1:
            return None
        reach *= 4


def shared_ends(a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shared_end`` of many intervals at once; -1 where there is none."""
    middle = (a0 + a1 - 1) // 2
    at, to = np.full(len(a0), -1), np.full(len(a0), -1)
    todo = np.flatnonzero((a0 < a1) & (b0 < b1))
    for step in range(NEAR):
        for sign in (-1, 1) if step else (1,):
            i = middle[todo] + sign * step
            inside = (i >= a0[todo]) & (i < a1[todo])
            i, mine = i[inside], todo[inside]
            j = np.searchsorted(b, a[i])
            hit = b[j] == a[i]
            at[mine[hit]], to[mine[hit]] = i[hit], j[hit]
            todo = todo[at[todo] < 0]
        todo = todo[(middle[todo] - step > a0[todo]) | (middle[todo] + step + 1 < a1[todo])]
        if not len(todo):
            return at, to
    for n in todo.tolist():
        if (cut := shared_end(a, b, int(a0[n]), int(a1[n]), int(b0[n]), int(b1[n]))) is not None:
            at[n], to[n] = cut
    return at, to


def divide_all(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after the last token of each group, in ``a`` and in ``b``. ``a`` and ``b`` are ends that rise and share
    their last; ``known_a``, ``known_b`` are such places of shared cuts known before, the last ones included.

    All intervals are halved at once, a level of the recursion after the other."""
    cut_a, cut_b = [known_a], [known_b]
    a0, a1, b0, b1 = np.concatenate([[0], known_a[:-1]]), known_a, np.concatenate([[0], known_b[:-1]]), known_b
    while True:
        wide = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
        i, j = shared_ends(a, b, a0, a1 - 1, b0, b1 - 1)
        cut = i >= 0
        if not cut.any():
            return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))
        i, j = i[cut] + 1, j[cut] + 1
        cut_a.append(i)
        cut_b.append(j)
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0[cut], i), (i, a1[cut]), (b0[cut], j), (j, b1[cut])))


def divide(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``(a from, a to, b from, b to)`` of two lists of ends that share their last."""
    if not len(a):
        return []
    x, y = (z.tolist() for z in divide_all(np.asarray(a), np.asarray(b), np.array([len(a)]), np.array([len(b)])))
    return list(zip([0, *x[:-1]], x, [0, *y[:-1]], y, strict=True))


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level tokenizers write for bytes: visible ones stand for themselves, the
    others are numbered on from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    own = {chr(b): b for b in seen}
    return own | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(seen))}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the parts aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        if json.loads(self.a.to_str()).get("pre_tokenizer", {}).get("add_prefix_space"):
            raise ValueError("the byte-level tokenizer must not add a space of its own")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if crossing := [p for p in pieces if "\n" in p or re.search("[^▁]▁", p)]:
            raise ValueError(f"pieces such as {crossing[0]!r} reach across parts: this vocabulary can't be aligned by parts")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        self.kind = np.dtype("<u4") if len(self.bytes_a) * self.size_b <= 1 << 32 else np.dtype("<u8")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in z], np.int64) for z in (self.bytes_a, self.bytes_b))
        # an id as it stands in the digest: A's inside a group and at its end, then B's
        self.said = [f"{i}{end}".encode() for size, ends in ((len(self.bytes_a), ",|"), (self.size_b, ",;")) for end in ends for i in range(size)]
        self.known = Recent(REMEMBERED)

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both, of a text that follows a cut."""
        # nothing joins over a line end, and the first two pieces are the space that B adds and that line end
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode("\n" + text)[2:]

    def one(self, part: str) -> bytes | None:
        """Ids of a part encoded alone; None where a tokenizer does not give its bytes back."""
        a, b = self.ids(part)
        raw = part.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a + [i + OF_B for i in b], ID).tobytes()

    def several(self, parts: list[str]) -> list[bytes | None]:
        """Ids of parts that each end in no white space, encoded as one text."""
        if len(parts) == 1:
            return [self.one(parts[0])]
        raw = [p.encode() for p in parts]
        text, cuts, both, counts = b"".join(raw), np.cumsum([len(p) for p in raw]), [], []
        for own, sizes, ids in zip((self.bytes_a, self.bytes_b), (self.sizes_a, self.sizes_b), self.ids("".join(parts)), strict=True):
            array = np.array(ids, ID)
            ends = np.cumsum(sizes[array])
            place = np.searchsorted(ends, cuts)
            if b"".join(map(own.__getitem__, ids)) != text or not np.array_equal(ends[place], cuts):
                return [self.one(p) for p in parts]
            both.append(array)
            counts.append(np.diff(place, prepend=-1))
        order = np.empty(sum(map(len, both)), ID)
        to_a, to_b = by_turns(*counts)
        order[to_a], order[to_b] = both[0], both[1] + OF_B
        data, at = order.tobytes(), [0, *(np.cumsum(counts[0] + counts[1]) * ID.itemsize).tolist()]
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def parts(self, text: bytes | None) -> list[bytes]:
        """The ids of each part of a text, in order, those of B from OF_B on; none where the text has no tokens."""
        if not text:
            return []
        try:
            parts = PARTS.findall(" " + text.decode())
        except UnicodeDecodeError:
            return []
        found = self.known.find_all(set(parts))
        new = [p for p, x in found.items() if x is None]
        plain = [p for p in new if not p[-1].isspace()]
        done = dict(zip(plain, self.several(plain), strict=True)) if plain else {}
        for p in new:
            x = done[p] if p in done else self.one(p)
            if x is None:
                return []
            found[p] = x
            if len(p) <= LONGEST_KEY:
                self.known.keep(p, x)
        return list(map(found.__getitem__, parts))

    def align(self, units: list[list[bytes]]) -> list[tuple]:
        """Runs of parts, all at once: of each the digest's text, groups, tokens of both, links, and the pairs with their links."""
        flat = list(chain.from_iterable(units))
        ids = np.frombuffer(b"".join(flat), ID).astype(np.int64)
        is_b = ids >= OF_B
        a, b = ids[~is_b], ids[is_b] - OF_B
        part = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat))) // ID.itemsize
        part_b = np.cumsum(is_b)[part - 1]
        part_a = part - part_b
        end_a, end_b = divide_all(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]), part_a, part_b)
        from_a, from_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
        n_a, n_b = end_a - from_a, end_b - from_b
        last = np.cumsum([len(parts) for parts in units]) - 1
        unit_a, unit_b = part_a[last], part_b[last]
        heads = np.concatenate([[0], np.searchsorted(end_a, unit_a[:-1], "right")])  # first group of each
        unit = np.repeat(np.arange(len(units)), np.diff([*heads, len(end_a)]))
        # the digest's text: each group's ids of A, then of B
        ends = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends[0][end_a - 1], ends[1][end_b - 1] = len(self.bytes_a), self.size_b
        order = np.empty(len(a) + len(b), np.int64)
        to_a, to_b = by_turns(n_a, n_b)
        order[to_a], order[to_b] = a + ends[0], b + ends[1] + 2 * len(self.bytes_a)
        said = list(map(self.said.__getitem__, order.tolist()))
        # pairs, under a number that begins with their unit
        stride = len(self.bytes_a) * self.size_b
        small = np.flatnonzero(n_a * n_b <= 64)
        each = (n_a * n_b)[small]
        which = np.repeat(small, each)
        place = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        width = n_b[which]
        down = place // width
        keys = np.sort(unit[which] * stride + a[from_a[which] + down] * self.size_b + b[from_b[which] + place - down * width])
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, times = keys[firsts], np.diff(np.append(firsts, len(keys)))
        if len(small) < len(n_a):
            more = [(keys, times)]
            for g in np.flatnonzero(n_a * n_b > 64).tolist():
                (u, n), (v, m) = (np.unique(z, return_counts=True) for z in (a[from_a[g] : end_a[g]], b[from_b[g] : end_b[g]]))
                more.append(((unit[g] * stride + u[:, None] * self.size_b + v).ravel(), (n[:, None] * m).ravel()))
            keys, times = add_up(*(np.concatenate(x) for x in zip(*more, strict=True)))
        k = np.searchsorted(keys, np.arange(len(units) + 1) * stride).tolist()
        t = [0, *(unit_a + unit_b).tolist()]
        groups, links = np.diff([*heads, len(end_a)]).tolist(), np.add.reduceat(n_a * n_b, heads).tolist()
        tokens_a, tokens_b = np.diff([0, *unit_a]).tolist(), np.diff([0, *unit_b]).tolist()
        return [
            (b"".join(said[t[u] : t[u + 1]])[:-1], groups[u], tokens_a[u], tokens_b[u], links[u], keys[k[u] : k[u + 1]] - u * stride, times[k[u] : k[u + 1]])
            for u in range(len(units))
        ]

    def documents(self, texts) -> list[dict]:
        """All of each document's numbers, and its pairs. Documents are aligned many at once, or one in several runs of parts."""
        runs, size, made = [], 0, {}
        out: list[dict] = []

        def flush():
            for (n, _), (said, *sums, keys, times) in zip(runs, self.align([r for _, r in runs]), strict=True):
                digest, total, pairs = made.setdefault(n, (hashlib.sha256(), np.zeros(4, np.int64), []))
                digest.update(b";" * bool(pairs) + said)
                total += sums
                pairs.append((keys, times))
            runs.clear()

        def finish():
            for n, (digest, total, pairs) in made.items():
                keys, times = pairs[0] if len(pairs) == 1 else add_up(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
                groups, n_a, n_b, links = total.tolist()
                out[n] = {"n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "groups_sha256": digest.hexdigest(), "keys": keys.astype(self.kind).tobytes(), "times": packed(times)}
            made.clear()

        for n, text in enumerate(texts):
            parts = self.parts(text)
            out.append(dict.fromkeys(NEW[:4], 0) | {"groups_sha256": "", "keys": b"", "times": b""})
            for at in range(0, len(parts), TOGETHER):
                runs.append((n, parts[at : at + TOGETHER]))
                size += len(runs[-1][1])
                if size >= TOGETHER:
                    flush()
                    size = 0
            if not runs:
                finish()
        if runs:
            flush()
        finish()
        return out

    def document(self, text: bytes | None) -> dict:
        return self.documents([text])[0]


def by_turns(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all of a and of all of b where ``n_a[0]`` of a are followed by ``n_b[0]`` of b, and so on."""
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    return np.arange(end_a[-1]) + np.repeat(end_b - n_b, n_a), np.arange(end_b[-1]) + np.repeat(end_a, n_b)


def add_up(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    by = np.argsort(keys, kind="stable")
    keys, times = keys[by], times[by]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(times, heads) if len(heads) else times


def packed(times: np.ndarray) -> bytes:
    """Positive numbers in as few bytes each as the largest needs, that width first."""
    width = next(w for w in (1, 2, 4, 8) if not len(times) or int(times.max()) < 1 << 8 * w)
    return bytes([width]) + times.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64) if data else np.zeros(0, np.int64)


def count_pairs(found: DataFrame, kind: np.dtype) -> DataFrame:
    """``key, n``: in how many documents each pair is linked."""

    def count(batches):
        parts, size = [], 0
        total = (np.zeros(0, kind), np.zeros(0, np.int64))

        def merged():
            keys = np.concatenate([total[0], *parts])
            return add_up(keys, np.concatenate([total[1], np.ones(len(keys) - len(total[0]), np.int64)]))

        def rows(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])

        for b in batches:
            for data in b.column(0):
                parts.append(np.frombuffer(data.as_py(), kind))
                size += len(parts[-1])
                if size > COUNTED:
                    total, parts, size = merged(), [], 0
                    if len(total[0]) > COUNTED // 2:
                        yield rows(*total)
                        total = (total[0][:0], total[1][:0])
        yield rows(*merged())

    return found.select("keys").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame, size_b: int) -> DataFrame:
    """``key, n, best``: whether no pair with the same id of A is in more documents."""
    counts = counts.withColumn("a", F.expr(f"key div {size_b}"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A at most
    return counts.join(top, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def look_up(frequent: tuple[np.ndarray, np.ndarray, np.ndarray], kind: np.dtype):
    """A function of a document's pairs: what the broadcast counts give for them, and the pairs they lack."""
    out = pa.struct([("n_best", pa.int64()), ("count_sum", pa.int64()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def of(keys: pa.Array, times: pa.Array) -> pa.Array:
        known, n, best = frequent if isinstance(frequent, tuple) else frequent.value
        rows = []
        for k, t in zip(keys.to_pylist(), times.to_pylist(), strict=True):
            k, t = np.frombuffer(k, kind).astype(np.int64), unpacked(t)
            at = np.searchsorted(known, k)
            at[at == len(known)] = 0
            hit = known[at] == k if len(known) else np.zeros(len(k), bool)
            own = t[hit]
            rows.append({"n_best": int(own[best[at[hit]]].sum()), "count_sum": int((own * n[at[hit]]).sum()), "keys": k[~hit], "times": t[~hit]})
        return pa.array(rows, out)

    return F.arrow_udf(of, "n_best long, count_sum long, keys array<long>, times array<long>").asNondeterministic()


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` without its text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    rest = [c for c in docs.columns if c != text and c not in NEW]
    sizes = Pair(path_a, path_b)
    kind, size_b = sizes.kind, sizes.size_b

    def find(texts: pa.Array) -> pa.Array:
        pair = held(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))
        return pa.array(pair.documents(t.as_py() for t in texts), FOUND)

    ddl = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
    found = F.arrow_udf(find, ddl).asNondeterministic()(utf8(text))
    row = F.struct(*rest, F.monotonically_increasing_id().alias("id")) if "id" not in rest else F.struct(F.struct(*rest).alias("rest"), F.monotonically_increasing_id().alias("id"))
    first = stored(docs.select(row.alias("row"), found.alias("f")).select("row", "f.*"), "aligned")
    counts = stored(with_best(stored(count_pairs(first, kind), "pairs"), size_b), "counts")
    top = counts.orderBy(F.col("n").desc(), "key").limit(frequent).orderBy("key").toArrow()
    columns = tuple(top.column(c).to_numpy() for c in ("key", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast((columns[0], columns[1], columns[2].astype(bool)))
    said = first.withColumn("s", look_up(shared, kind)("keys", "times")).select("row", *NEW[:4], "groups_sha256", "s")
    if top.num_rows == frequent:  # there may be pairs beyond those
        said = stored(said, "sums")
        rare = said.select(F.col("row.id").alias("id"), F.explode(F.arrays_zip("s.keys", "s.times")).alias("p")).select("id", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
        rare = rare.join(counts, "key").groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        rare = rare.select(F.col("id").alias("rare_id"), F.struct("n_best", "count_sum").alias("r"))
        said = said.join(rare, F.col("row.id") == F.col("rare_id"), "left")
        best, total = (F.col(f"s.{c}") + F.coalesce(F.col(f"r.{c}"), F.lit(0)) for c in ("n_best", "count_sum"))
    else:
        best, total = F.col("s.n_best"), F.col("s.count_sum")
    own = F.col("row") if "id" not in rest else F.col("row.rest")
    return said.select(*(own[c].alias(c) for c in rest), *NEW[:4], best.alias("n_best"), total.alias("count_sum"), "groups_sha256")

"""Vector compression: a codebook for each part of the vectors, fitted by Lloyd's rounds over cover trees.

Components are taken as integers ``floor(scale * x)``, so that every sum and distance is exact. Vectors are
cut into ``parts`` consecutive parts; where the length is no multiple of that, the first parts are one
longer. A codebook starts as that part of the vectors with the smallest ids.

* Each Arrow batch of rows becomes one block with a cover tree for each part (``cover_tree.Forest``), which
  is written once. A round walks the trees with the codebook, a bounded broadcast (``parts * entries``
  points): whole subtrees go to an entry by the triangle inequality and give their cumulative sums; only
  ambiguous nodes descend, down to exact comparisons.
* Blocks send sums for each entry, which Spark adds up; the driver gets ``parts * entries`` rows. Sums
  travel in digits of 32 bits, so they are exact at any size.
* Errors are summed over equal labels after a partial sum in each task, and joined back.

Defined cases: vectors that are null, hold null or non-finite components, or are of another length than
most (ties: the longer) are dropped; null ids are coded but never start a codebook; of rows that share an
id, the one with the smaller components comes first, and each counts; with fewer rows than ``entries`` the
codebooks are as short; an entry without parts stays; empty vectors have empty parts at distance 0; a null
label is a label; a sum of errors beyond 64 bits is null; an empty table gives no row; other columns are
passed on, and lose to the new ones where they clash. Components of more than 24 bits are compared one by one
in whole numbers of any size.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import stored
from quadloom.llm.cover_tree import SMALL, Forest, distances

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LONG = 1 << 63


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, as 64-bit integers where all are small, else as Python's."""
    x = np.asarray(x, np.float64)
    if not x.size or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.size, object)
    out[:] = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def widths(length: int, parts: int) -> list[int]:
    return [length // parts + (p < length % parts) for p in range(parts)]


def in_parts(rows: np.ndarray, parts: int) -> np.ndarray:
    """``(part, row, component)``; shorter parts end in zeros."""
    n, length = rows.shape
    own = widths(length, parts)
    out = np.zeros((parts, n, max(own, default=0)), rows.dtype)
    at = 0
    for p, w in enumerate(own):
        out[p, :, :w] = rows[:, at : at + w]
        at += w
    return out


def _small(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind != "i" or not a.size:
        return a
    return a.astype(np.result_type(np.min_scalar_type(a.min()), np.min_scalar_type(a.max())))


class Block:
    """Rows of one batch: a forest with a tree for each part, and where each row's part is in it."""

    def __init__(self, rows: np.ndarray, parts: int):
        own = in_parts(rows, parts)
        self.shape = own.shape
        if rows.dtype == object or not own.size:
            self.forest, self.raw = None, own
            return
        points, counts, place, first = [], [], [], 0
        for p in range(parts):
            found, where, n = np.unique(own[p], axis=0, return_inverse=True, return_counts=True)
            points.append(found)
            counts.append(n)
            place.append(where.reshape(-1) + first)
            first += len(found)
        tree = np.repeat(np.arange(parts), [len(x) for x in points])
        self.forest, self.raw = Forest(np.concatenate(points), np.concatenate(counts), tree, parts), None
        back = np.empty(first, np.int64)
        back[self.forest.order] = np.arange(first)
        self.place = back[np.concatenate(place)].reshape(parts, -1)

    def to_bytes(self) -> bytes:
        f = self.forest
        if f is None:
            return pickle.dumps((self.shape, None, self.raw))
        names = ("points", "counts", "of_tree", "start", "end", "radius", "tree", "child", "children")
        return pickle.dumps((self.shape, {k: _small(getattr(f, k)) for k in names}, _small(self.place)))

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        self = cls.__new__(cls)
        self.shape, kept, rest = pickle.loads(data)  # written by this module, in the run's own folder
        if kept is None:
            self.forest, self.raw = None, rest
            return self
        f = self.forest = Forest.__new__(Forest)
        for k, v in kept.items():
            setattr(f, k, v.astype(np.int64) if v.dtype.kind != "f" else v)
        self.raw, self.place = None, rest.astype(np.int64)
        f.finish()
        return self

    def assign(self, book: np.ndarray) -> np.ndarray:
        """Entry of each row's parts, ``(part, row)``."""
        if self.forest is not None and book.dtype != object:
            return self.forest.assign(book)[0][self.place]
        own = self._plain()
        out = np.zeros(self.shape[:2], np.int64)
        for p in range(self.shape[0]):
            d = np.stack([((own[p] - e) ** 2).sum(axis=1) for e in book[p].astype(object)])
            out[p] = d.argmin(axis=0)
        return out

    def _plain(self) -> np.ndarray:
        return (self.raw if self.forest is None else self.forest.points[self.place]).astype(object)

    def sums(self, book: np.ndarray) -> dict[int, tuple[list[int], int]]:
        """For ``part * entries + entry``: the sum of the parts that went there, and their number."""
        k = book.shape[1]
        if self.forest is not None and book.dtype != object:
            keys, sums, n = self.forest.sums_by_centre(self.forest.assign(book)[0], k)
            return {a: (b, c) for a, b, c in zip(keys.tolist(), sums.tolist(), n.tolist(), strict=True)}
        found, own, out = self.assign(book), self._plain(), {}
        for p in range(self.shape[0]):
            for e in np.unique(found[p]).tolist():
                hit = own[p][found[p] == e]
                out[p * k + e] = ([int(v) for v in hit.sum(axis=0)], len(hit))
        return out

    def codes(self, book: np.ndarray) -> tuple[list[str], list[int]]:
        """Each row's code and its error."""
        found = self.assign(book)
        if self.forest is not None and book.dtype != object:
            f, tree = self.forest, np.arange(self.shape[0])[:, None]
            error = distances(f.points[self.place.ravel()], book[np.broadcast_to(tree, found.shape).ravel(), found.ravel()]).reshape(found.shape).sum(axis=0).tolist()
        else:
            own = self._plain()
            error = [int(sum(((own[p][i] - book[p][found[p][i]].astype(object)) ** 2).sum() for p in range(self.shape[0]))) for i in range(self.shape[1])]
        return [row.tobytes().hex() for row in np.ascontiguousarray(found.T.astype(np.uint8))], error


def usable(col: str) -> Column:
    v = F.col(col)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def common_length(vectors: DataFrame, col: str) -> int | None:
    n = vectors.groupBy(F.size(col).alias("length")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("length").desc()).first()
    return n["length"] if n else None


def digits(v: int) -> list[tuple[int, int]]:
    """A whole number as signed digits of 32 bits, the lowest first."""
    out, place = [], 0
    while not -(1 << 32) < v < 1 << 32:
        out.append((place, v & 0xFFFFFFFF))
        v >>= 32
        place += 1
    return [*out, (place, v)]


def sum_parts(blocks: DataFrame, book: np.ndarray) -> list:
    """``(key, component, value)`` of all blocks, component -1 for the number of parts."""
    shared = blocks.sparkSession.sparkContext.broadcast(book)

    def add(batches):
        total: dict[int, tuple[list[int], int]] = {}
        for b in batches:
            for data in b.column(0):
                for key, (v, n) in Block.from_bytes(data.as_py()).sums(shared.value).items():
                    old = total.get(key)
                    total[key] = (v, n) if old is None else ([x + y for x, y in zip(old[0], v, strict=True)], old[1] + n)
        rows = [(k, i, d, x) for k, (v, n) in total.items() for i, w in enumerate([n, *v], -1) for d, x in digits(w)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["key", "i", "digit", "v"])

    summed = blocks.select("_trees").mapInArrow(add, "key int, i int, digit int, v long").groupBy("key", "i", "digit").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], int] = {}
    for r in summed.collect():  # at most parts * entries * (components + 1) rows, times digits
        at = (r["key"], r["i"])
        out[at] = out.get(at, 0) + (r["v"] << (32 * r["digit"]))
    return [(key, i, v) for (key, i), v in out.items()]


def as_book(numbers: list[list[list[int]]]) -> np.ndarray:
    flat = [abs(x) for p in numbers for e in p for x in e]
    return np.array(numbers, np.int64 if max(flat, default=0) < SMALL else object)


def next_book(book: np.ndarray, sums: list) -> np.ndarray:
    got = {(key, i): v for key, i, v in sums}
    new, k = book.tolist(), book.shape[1]
    for p in range(book.shape[0]):
        for e in range(k):
            if n := got.get((p * k + e, -1)):
                new[p][e] = [got[p * k + e, i] // n for i in range(book.shape[2])]
    return as_book(new)


def book_digest(book: np.ndarray, length: int, parts: int) -> str:
    own = widths(length, parts)
    return hashlib.sha256(",".join(str(x) for p, w in zip(book.tolist(), own, strict=True) for e in p for x in e[:w]).encode()).hexdigest()


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, int] | None:
    """The table of blocks (rows without their vector, and trees), the final codebooks as ``(part, entry,
    component)``, and the vectors' length; None where no vector is usable."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number must fit two hex digits")
    rest = [c for c in vectors.columns if c != vector]
    kept = vectors.where(usable(vector))
    length = common_length(kept, vector)
    if length is None:
        return None
    kept = kept.where(F.size(vector) == length).withColumn(vector, F.col(vector).cast("array<double>"))
    rows_type = T.ArrayType(T.StructType([vectors.schema[c] for c in rest]))

    def grow(batches):
        for b in batches:
            if b.num_rows:
                flat = b.column("_vector").flatten().to_numpy(zero_copy_only=False)
                block = Block(whole(flat.reshape(b.num_rows, length), scale), parts)
                rows = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("_row"))
                yield pa.RecordBatch.from_arrays([rows, pa.array([block.to_bytes()], pa.binary())], ["_rows", "_trees"])

    blocks = stored(kept.select(F.struct(*rest).alias("_row"), F.col(vector).alias("_vector")).mapInArrow(grow, T.StructType().add("_rows", rows_type).add("_trees", "binary")), "trees")
    first = kept.where(F.col(key).isNotNull()).orderBy(key, vector).select(vector).limit(entries).collect()
    if not first:
        first = kept.orderBy(vector).select(vector).limit(entries).collect()
    book = as_book(in_parts(whole(np.array([r[0] for r in first], np.float64).reshape(len(first), length), scale), parts).tolist())
    for _ in range(rounds):
        book = next_book(book, sum_parts(blocks, book))
    return blocks, book, length


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Usable rows without their vector, with ``code`` (two hex digits a part), ``error``,
    ``label_error`` (where a label is named) and ``codebooks_sha256``."""
    rest = [c for c in vectors.columns if c != vector]
    new = ["code", "error", *["label_error"] * (label is not None), "codebooks_sha256"]
    fitted = fit(vectors, key, vector, scale, parts, entries, rounds)
    if fitted is None:
        kinds = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return vectors.where("false").drop(vector).withColumns({c: F.lit(None).cast(kinds[c]) for c in new})
    blocks, book, length = fitted
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    kind = pa.struct([("code", pa.string()), ("error", pa.int64())])

    @F.arrow_udf("array<struct<code:string,error:long>>")
    def code(trees: pa.Array) -> pa.Array:
        offsets, codes, errors = [0], [], []
        for data in trees:
            c, e = Block.from_bytes(data.as_py()).codes(shared.value)
            codes += c
            errors += [x if x < LONG else None for x in e]
            offsets.append(len(codes))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], fields=list(kind)))

    found = blocks.select("_rows", code("_trees").alias("_codes")).select(F.explode(F.arrays_zip("_rows", "_codes")).alias("_x"))
    coded = stored(found.select(F.col("_x._rows").alias("r"), F.col("_x._codes").alias("c")), "codes")
    out = [F.col("r")[c].alias(c) for c in rest if c not in new]
    if label is not None:
        total = F.sum(F.col("c.error").cast("decimal(38,0)"))
        # a label with an error beyond 64 bits has none
        sums = coded.groupBy(F.col("r")[label].alias("_label")).agg(F.when(F.count("c.error") == F.count("*"), total).try_cast("long").alias("_sum"))
        coded = coded.join(sums, F.col("r")[label].eqNullSafe(F.col("_label")))
        out.append(F.col("_sum").alias("label_error"))
    return coded.select(*out, F.col("c.code").alias("code"), F.col("c.error").alias("error"), F.lit(book_digest(book, length, parts)).alias("codebooks_sha256"))

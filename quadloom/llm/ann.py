"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own centroids, fitted on a bounded
sample; a cell is a pair of centroids, and every vector is indexed in its cell. A query meets the pairs
in the order of their summed nearness, best first, with a heap (the sum of what either centroid promises:
its inner product with the query's half, and SLACK standard deviations of what residuals add).

Two passes: the first takes cells until FIRST entries per result are met, which gives a score that the
last result at least has; the second goes on until no cell promises that much. So the number of entries
reranked follows the data and has no cap. Scores are double-precision inner products of the vectors as
they are given.

Entries are grouped by their first centroid; groups are cut into chunks of BLOCK_ROWS by a hash of the
id, and the queries that visit a group into blocks of BLOCK_QUERIES, so neither a common vector nor a
common query gathers in one task.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and those of
another length than most, take no part; equal scores go by the smaller id; repeated rows of an id are
entries each, but one query; a query never meets rows of its own id; with fewer candidates than asked for
all are returned; an empty table has no results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import stored

#: Vectors that centroids are fitted on, at most; rounds of k-means; centroids of a half, at most.
SAMPLE = 20_000
ROUNDS = 12
MOST_CENTROIDS = 256
#: Entries wanted in a cell on average, which sets the number of centroids.
PER_CELL = 32
SLACK = 2.2
#: Entries met in the first pass, for each result wanted.
FIRST = 50
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048


def usable(vec: str) -> Column:
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vec).isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def matrix(column, width: int) -> np.ndarray:
    """Rows of doubles from a column of bytes."""
    return np.frombuffer(b"".join(v.as_py() for v in column), np.float64).reshape(-1, width)


class Codebook:
    """Centroids of both halves, and what their cells are known to hold."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.c1, self.c2 = first, second
        self.cut, self.width = first.shape[1], first.shape[1] + second.shape[1]
        self.sizes = np.zeros((len(first), len(second)), np.int64)
        self.s1, self.s2 = np.zeros(len(first)), np.zeros(len(second))

    def measured(self, rows: list) -> Codebook:
        """With sizes of cells and the mean squared residuals of each centroid."""
        r1, r2 = np.zeros(self.sizes.shape), np.zeros(self.sizes.shape)
        for r in rows:
            self.sizes[r["i"], r["j"]] = r["n"]
            r1[r["i"], r["j"]], r2[r["i"], r["j"]] = r["r1"], r["r2"]
        self.s1 = np.sqrt(r1.sum(axis=1) / np.maximum(self.sizes.sum(axis=1), 1) / self.cut)
        self.s2 = np.sqrt(r2.sum(axis=0) / np.maximum(self.sizes.sum(axis=0), 1) / (self.width - self.cut))
        return self

    def cells(self, q: np.ndarray, enough: int, least: float, skip: int) -> tuple[list[tuple[int, int]], int]:
        """Cells in the order of what they promise: until ``enough`` entries are met, or, without that
        number, while they promise ``least`` or more. The first ``skip`` are passed over. Also the
        number of cells met."""
        a, b = q[: self.cut], q[self.cut :]
        p1 = self.c1 @ a + SLACK * np.linalg.norm(a) * self.s1
        p2 = self.c2 @ b + SLACK * np.linalg.norm(b) * self.s2
        o1, o2 = np.argsort(-p1, kind="stable"), np.argsort(-p2, kind="stable")
        s1, s2 = p1[o1].tolist(), p2[o2].tolist()
        heap, out, met, entries = [(-(s1[0] + s2[0]), 0, 0)], [], 0, 0
        while heap:
            promise, x, y = heapq.heappop(heap)
            if enough:
                if entries >= enough:
                    break
            elif -promise < least:
                break
            # each pair is reached once: along its row, and down the first column
            if y + 1 < len(s2):
                heapq.heappush(heap, (-(s1[x] + s2[y + 1]), x, y + 1))
            if y == 0 and x + 1 < len(s1):
                heapq.heappush(heap, (-(s1[x + 1] + s2[0]), x + 1, 0))
            i, j = int(o1[x]), int(o2[y])
            met += 1
            entries += int(self.sizes[i, j])
            if met > skip and self.sizes[i, j]:
                out.append((i, j))
        return out, met


def fit(vectors: DataFrame, n: int) -> Codebook | None:
    """Centroids from a sample of ``vectors(v)``, bytes of doubles."""
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    rows = vectors.sample(share, seed=5).limit(SAMPLE).select("v").collect() or vectors.limit(1).select("v").collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["v"], np.float64) for r in rows])
    cut = x.shape[1] // 2 or 1
    k = int(min(MOST_CENTROIDS, max(1, round((n / PER_CELL) ** 0.5)), len(x)))
    return Codebook(kmeans(x[:, :cut], k, 1), kmeans(x[:, cut:], k, 2) if cut < x.shape[1] else np.zeros((1, 0)))


def as_bytes():
    @F.arrow_udf("binary")
    def of(vectors: pa.Array) -> pa.Array:
        return pa.array([np.array(v, np.float64).tobytes() for v in vectors.to_pylist()], pa.binary())

    return of


def index_of(vectors: DataFrame, book: Codebook) -> DataFrame:
    """Every vector with its cell, and what of it the centroids leave."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    @F.arrow_udf("i int, j int, r1 double, r2 double")
    def assign(column: pa.Array) -> pa.Array:
        b = shared.value
        x = matrix(column, b.width)
        i, j = nearest(x[:, : b.cut], b.c1), nearest(x[:, b.cut :], b.c2)
        r1, r2 = ((x[:, : b.cut] - b.c1[i]) ** 2).sum(axis=1), ((x[:, b.cut :] - b.c2[j]) ** 2).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(r1), pa.array(r2)], ["i", "j", "r1", "r2"])

    return vectors.withColumn("at", assign("v")).select("id", "v", "at.*")


def routed(queries: DataFrame, book, enough: int) -> DataFrame:
    """Queries with the cells they visit: ``qid, v, least, met, i, js``."""
    ddl = "qid long, v binary, least double, met long, i int, js array<int>"
    kinds = [pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]

    def route(batches):
        b = book.value
        for batch in batches:
            rows = []
            for qid, v, least, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells, now = b.cells(np.frombuffer(v, np.float64), enough, least, met)
                by: dict[int, list[int]] = {}
                for i, j in cells:
                    by.setdefault(i, []).append(j)
                rows += [(qid, v, least, now, i, js) for i, js in by.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ddl.split(", ")])

    return queries.select("qid", "v", "least", "met").mapInArrow(route, ddl)


def visit(index: DataFrame, visits: DataFrame, book: Codebook, k: int) -> DataFrame:
    """``qid, id, score`` of the best entries of each visited group, at most k, none below ``least``."""
    per = dict(visits.groupBy("i").agg(F.count("*")).collect())
    sizes = book.sizes.sum(axis=1)
    chunks = F.array(*(F.lit(max(1, -(-int(s) // BLOCK_ROWS))) for s in sizes))
    blocks = F.array(*(F.lit(max(1, -(-per.get(i, 0) // BLOCK_QUERIES))) for i in range(len(sizes))))
    n_chunks, n_blocks = F.get(chunks, F.col("i")), F.get(blocks, F.col("i"))
    visited = F.col("i").isin(list(per)) if per else F.lit(False)
    left = index.where(visited).select("i", "j", "id", "v", F.pmod(F.xxhash64("id"), n_chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    right = visits.select("i", "js", "qid", "v", "least", F.pmod(F.xxhash64("qid"), n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
    width = book.width
    keys = [F.col("i"), F.col("chunk").cast("long").alias("chunk"), F.col("block").cast("long").alias("block")]
    left, right = left.withColumns({"chunk": keys[1], "block": keys[2]}), right.withColumns({"chunk": keys[1], "block": keys[2]})

    def rerank(entries: pa.Table, asked: pa.Table) -> pa.Table:
        qids, ids, scores = [], [], []
        if len(entries) and len(asked):
            x, own, cell = matrix(entries["v"], width), entries["id"].to_numpy(), entries["j"].to_numpy()
            order = np.argsort(cell, kind="stable")
            x, own, cell = x[order], own[order], cell[order]
            starts = np.searchsorted(cell, np.arange(cell[-1] + 2))
            reach = np.sqrt((x * x).sum(axis=1).max())
            for qid, v, least, js in zip(*(asked[c].to_pylist() for c in ("qid", "v", "least", "js")), strict=True):
                q = np.frombuffer(v, np.float64)
                js = [j for j in js if j <= cell[-1]]
                at = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in js]) if js else np.empty(0, int)
                # fast products choose, with room for their rounding; the score is summed in one fixed order
                rough = np.concatenate([x[starts[j] : starts[j + 1]] @ q for j in js]) if js else np.empty(0)
                room = 1e-9 * np.linalg.norm(q) * reach
                keep = (own[at] != qid) & (rough >= least - room)
                at, rough = at[keep], rough[keep]
                if len(at) > k:
                    at = at[rough >= np.partition(rough, -k)[-k] - room]
                s = (x[at] * q).sum(axis=1)
                at, s = at[s >= least], s[s >= least]
                best = np.lexsort((own[at], -s))[:k]
                qids.append(np.full(len(best), qid))
                ids.append(own[at][best])
                scores.append(s[best])
        parts = [np.concatenate(c) if c else np.empty(0, t) for c, t in ((qids, np.int64), (ids, np.int64), (scores, np.float64))]
        return pa.table([pa.array(p) for p in parts], ["qid", "id", "score"])

    by = ["i", "chunk", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rerank, "qid long, id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of all other rows for each row that is a query."""
    spark = table.sparkSession
    rows = table.where(F.col(key).isNotNull() & usable(vec)).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("e"), is_query.alias("asks"))
    lengths = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = stored(rows.where(F.size("e") == lengths["d"]).select("id", as_bytes()("e").alias("v"), "asks"), "vectors")
    book = fit(vectors, lengths["count"])
    index = stored(index_of(vectors, book), "index")
    book.measured(index.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")).collect())
    shared = spark.sparkContext.broadcast(book)
    queries = vectors.where("asks").groupBy(F.col("id").alias("qid")).agg(F.min("v").alias("v"))
    queries = queries.withColumns({"least": F.lit(float("-inf")), "met": F.lit(0).cast("long")})
    one = stored(routed(queries, shared, FIRST * k), "visits")
    found = stored(best(visit(index, one, book, k), k), "found")
    known = found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    again = one.groupBy("qid").agg(F.min("v").alias("v"), F.max("met").alias("met")).join(known, "qid", "left").na.fill(float("-inf"), ["least"])
    two = stored(routed(again, shared, 0), "visits")
    more = visit(index, two, book, k)
    out = best(found.select("qid", "id", "score").union(more), k)
    return out.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")

"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a hash of their text, then by id, so equal texts stand side by side. A sample of
keys, drawn with a chance that grows with a record's size, gives quantiles as boundaries of many ranges
per shard. Ranges are measured; one that came out overfull is subdivided by the same rule with its own
sample, until each fits one task or can't be divided. Exact sums over the ranges then give each record
its place in bytes, and its shard is the part of the whole in which that place falls: shards differ by
less than one record. Only keys and sizes are shuffled; texts stay where they are read.

Since ids follow the hash in the key, a text that a third of all records repeat is cut like any other
run of records; a copy of a whole row is told apart by its place in the scan.

Defined cases: a null text has no bytes (size 1, checksum 0), like an empty one; a null id sorts first;
an empty table has no shards in use; further columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import stored, utf8

#: Splitters wanted per shard, samples drawn per splitter, rows that one task may order.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 64
RANGE_ROWS = 1_000_000
KEY = ("k_hash", "k_id", "k_row")


def light_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and size of each record."""
    body = F.coalesce(utf8(text), F.lit(b""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("k_hash"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k_id"),
        F.monotonically_increasing_id().alias("k_row"),
    )


def draw(rows: DataFrame, rate: Column) -> DataFrame:
    """Keys drawn with a chance in proportion to the size, the same ones in every run."""
    chance = F.pmod(F.xxhash64(*KEY, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(chance < F.col("size") * rate)


def splitters(samples: DataFrame, n: int) -> list[tuple]:
    """Boundaries at the quantiles of a bounded sample."""
    keys = sorted(tuple(r) for r in samples.select(*KEY).collect())
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def bounds_up_to(bounds: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """For each key, how many of the sorted bounds are not above it. Both are given by column; where
    the first column ties, the others decide."""
    low, high = (np.searchsorted(bounds[0], keys[0], side) for side in ("left", "right"))
    if len(bounds) == 1:
        return high
    out = low.copy()
    for at in np.unique(low[low < high]):
        own = np.flatnonzero((low == at) & (high > low))
        tied = slice(at, high[own[0]])
        out[own] += bounds_up_to([b[tied] for b in bounds[1:]], [k[own] for k in keys[1:]])
    return out


def find_range(spark: SparkSession, bounds: list[tuple]) -> Column:
    """Index of the range a row falls in: a binary search in the boundaries. These are 24 bytes each
    and a few for every RANGE_ROWS rows, so they are sent as arrays; as literals, their number would be
    the size of the plan."""
    shared = spark.sparkContext.broadcast([np.array([b[i] for b in bounds], np.int64) for i in range(len(KEY))])

    @F.arrow_udf("int")
    def of(k_hash: pa.Array, k_id: pa.Array, k_row: pa.Array) -> pa.Array:
        keys = [k.to_numpy(zero_copy_only=False) for k in (k_hash, k_id, k_row)]
        return pa.array(bounds_up_to(shared.value, keys).astype(np.int32))

    return of(*KEY)


def ranges_of(rows: DataFrame, shards: int) -> DataFrame:
    """Rows with their range ``r``, numbered in the order of keys; no range is left overfull."""
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.withColumn("r", F.lit(0))
    n = max(shards * RANGES_PER_SHARD, 2 * total["n"] // RANGE_ROWS)
    bounds: list[tuple] = splitters(draw(rows, F.lit(n * SAMPLES_PER_RANGE / total["b"])), n)
    while True:
        placed = rows.withColumn("r", find_range(rows.sparkSession, bounds))
        full = placed.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi"))
        limit = max(2 * total["b"] // n, 1)
        over = full.where(((F.col("b") > limit) & (F.col("n") > 64) | (F.col("n") > RANGE_ROWS)) & (F.col("lo") != F.col("hi"))).collect()
        more = []
        for x in over:
            part = rows.where(F.struct(*KEY).between(*(F.struct(*(F.lit(x[e][k]).cast("long").alias(k) for k in KEY)) for e in ("lo", "hi"))))
            cut = max(2, -(-x["b"] // limit) * 2, -(-x["n"] // RANGE_ROWS) * 2)
            more += splitters(draw(part, F.lit(cut * SAMPLES_PER_RANGE / x["b"])), cut)
        wider = sorted({*bounds, *more})
        if len(wider) == len(bounds):
            return placed
        bounds = wider


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every record: shards near equal in bytes, slots
    gapless from 0 within a shard."""
    rows = ranges_of(stored(light_rows(docs, key, text), "shard-rows"), shards)
    per_range = rows.groupBy("r").agg(F.sum("size").alias("b"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = per_range.select("r", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"), F.sum("b").over(Window.partitionBy(F.lit(0))).alias("total"))
    within = Window.partitionBy("r").orderBy(*KEY)
    placed = rows.withColumns({"upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(within)}).join(base, "r")
    # the middle of a record decides, so that no record at the end falls outside
    middle = F.col("base") + F.col("upto") - F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int"))
    counts = placed.groupBy("r", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first_nth"))
    ahead = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("r", "shard", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first_nth")).alias("shift"))
    return placed.join(counts, ["r", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("shift")).cast("long").alias("slot"))

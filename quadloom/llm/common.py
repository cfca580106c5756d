"""What the operators share: the written tables between stages, text as bytes, components of a link table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans.lineage import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later stages start from the files, also
    when executors are lost."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(text: str | Column) -> Column:
    """Bytes of a text; null gives null. Spark holds strings as UTF-8, so nothing is converted."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What a Python worker keeps from task to task: the tables of one operator at a time.
_held: dict = {}


def held(key, make):
    """The worker's tables under this key. Workers outlive operators, so tables of another are dropped."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Recent:
    """A bounded memory in two generations: when the younger is full, the older, which holds what was
    not asked for since, is dropped."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def find(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.keep(key, got)
        return got

    def find_all(self, keys) -> dict:
        """What is kept under each of ``keys``, or None."""
        got = dict(zip(keys, map(self.young.get, keys), strict=True))
        for key in [k for k, x in got.items() if x is None]:
            got[key] = self.find(key)
        return got

    def keep(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def lower_ascii(col: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: ``(id, root)`` with the smallest id of each component,
    for every id that stands in a link.

    Rounds of large-star and small-star: each node hands its larger (smaller) neighbours to the
    smallest node it knows. Each round is two grouped minima and two joins, nothing is gathered in a
    group, and each is written to the shared folder. It ends when a round changes nothing, after
    about log2 of the longest path."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a plain shuffle on either side and can split a hub
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").union(roots.select("root", "root").distinct())

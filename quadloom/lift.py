"""Lifts of plain tables to message graphs, for running rules over relational data.

Long lifts are unions of one narrow projection per predicate: a rule that needs two predicates
reads the columns of those two only, as the optimizer drops the other branches. Nested lifts build
the array inside the row. Neither needs a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quadloom import vocab as V
from quadloom.terms import META, TRIPLE, bnode, iri, literal, triple

SRC = "http://example.org/src#"
#: Most rows of a table that one task of row-local work takes.
ROWS_A_TASK = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows of a table out for row-local work where its files do not: a file of few row groups
    is read by few tasks, however many splits it is cut into. Tasks take ``ROWS_A_TASK`` rows at most, and
    all cores have some. Rows are counted from the footers; inputs that are dealt out so stay as they are.
    Dealt out by the columns ``by``, if given: rows equal in them meet in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    largest, rows, used = (x or 0 for x in sizes)
    if largest <= ROWS_A_TASK and used >= min(cores, rows):
        return df
    # by hash, as dealing in turn sorts whatever one task has read
    return df.repartition(max(cores, -(-rows // ROWS_A_TASK)), *(by or df.columns))


def text(col: Column) -> Column:
    return col.cast("string")


def money(col: Column) -> Column:
    """Two-digit decimal text, the same in every engine."""
    return col.cast("decimal(18,2)").cast("string")


def node(kind: str, key: Column) -> Column:
    return iri(F.concat(F.lit(f"{SRC}{kind}/"), text(key)))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _k() -> Column:
    return F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1)


def _event_triples() -> list[tuple[Column, str, Column]]:
    event = node("event", F.col("event_id"))
    k = _k()
    k_dt = F.when(k.try_cast("int") % 2 == 0, V.INTEGER).otherwise(F.lit(V.STRING))
    return [
        (event, V.RDF_TYPE, iri(F.concat(F.lit(SRC), F.col("event_type")))),
        (event, SRC + "user", node("user", F.col("user_id"))),
        (event, SRC + "observation", bnode("o")),
        (bnode("o"), SRC + "value", literal(money(F.col("value")), V.DECIMAL)),
        (bnode("o"), SRC + "k", literal(k, k_dt)),
    ]


def _event_meta() -> tuple[Column, str, Column]:
    return (node("event", F.col("event_id")), SRC + "epoch", literal(text(epoch_seconds(F.col("ts"))), V.INTEGER))


def events_long(events: DataFrame) -> DataFrame:
    """One message per event; observation in a named payload graph, epoch in the default graph."""
    rows = [(V.PAYLOAD_GRAPH, t) for t in _event_triples()] + [(V.DEFAULT_GRAPH, _event_meta())]
    return _union(
        events.select(
            text(F.col("event_id")).alias("msg_id"), F.lit(g).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o")
        )
        for g, (s, p, o) in rows
    )


def events_nested(events: DataFrame) -> DataFrame:
    s, p, o = _event_meta()
    meta = F.struct(F.lit(V.DEFAULT_GRAPH).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    return events.select(
        text(F.col("event_id")).alias("msg_id"),
        F.lit(V.PAYLOAD_GRAPH).alias("payload_g"),
        F.array(*[triple(*t) for t in _event_triples()]).cast(T.ArrayType(TRIPLE)).alias("triples"),
        F.array(meta).cast(T.ArrayType(META)).alias("meta"),
    )


def line_label() -> Column:
    """Blank node of a line: hash of the whole row, as no key column set is unique."""
    cols = [
        text(F.col("l_orderkey")), text(F.col("l_partkey")), text(F.col("l_suppkey")), text(F.col("l_linenumber")),
        money(F.col("l_quantity")), money(F.col("l_extendedprice")), money(F.col("l_discount")), money(F.col("l_tax")),
        F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"),
    ]
    return F.concat(F.lit("l"), F.md5(F.concat_ws("|", *cols)))


def orders_long(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One message per order, without a named payload graph. Line triples come straight from the
    line rows: an order of any size is never gathered."""
    o_key, l_key = text(F.col("o_orderkey")), text(F.col("l_orderkey"))
    order, line_order = node("order", F.col("o_orderkey")), node("order", F.col("l_orderkey"))
    line = bnode(line_label())
    heads = [
        (order, SRC + "customer", node("customer", F.col("o_custkey"))),
        (order, SRC + "status", literal(F.col("o_orderstatus"))),
    ]
    lines = [
        (line_order, SRC + "line", line),
        (line, SRC + "quantity", literal(money(F.col("l_quantity")), V.DECIMAL)),
        (line, SRC + "price", literal(money(F.col("l_extendedprice")), V.DECIMAL)),
        (line, SRC + "discount", literal(money(F.col("l_discount")), V.DECIMAL)),
        (line, SRC + "part", node("part", F.col("l_partkey"))),
    ]

    def rows(df: DataFrame, key: Column, t) -> DataFrame:
        s, p, o = t
        return df.select(
            key.alias("msg_id"), F.lit(V.DEFAULT_GRAPH).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o")
        )

    return _union([rows(orders, o_key, t) for t in heads] + [rows(lineitem, l_key, t) for t in lines])


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, list(frames))

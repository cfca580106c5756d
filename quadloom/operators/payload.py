"""Payload graphs: the named payload graph of a message, or else its default graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadloom import vocab as V
from quadloom.plans.bits import key_bits, with_flags
from quadloom.terms import let


def _named(quads: DataFrame) -> DataFrame:
    """Messages with a named payload graph."""
    return quads.where(F.col("g") == V.PAYLOAD_GRAPH).select("msg_id").distinct()


def _looked_up(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of messages that surely have no named payload, and all others. Most of the first kind
    is told by the bits of the named messages, without moving a row."""
    flagged = with_flags(rows, _maybe=key_bits(named))
    return flagged.where(~F.col("_maybe")).drop("_maybe"), flagged.where(F.col("_maybe")).drop("_maybe")


def payload(quads: DataFrame) -> DataFrame:
    """Quads of each message's payload.

    Only default-graph rows need to know whether the message has a named payload, so named payload
    rows are never shuffled, and no message is gathered in one task."""
    named = quads.where(F.col("g") == V.PAYLOAD_GRAPH)
    apart, others = _looked_up(quads.where(F.col("g") == V.DEFAULT_GRAPH), named)
    return named.unionByName(apart).unionByName(others.join(_named(quads), "msg_id", "left_anti"))


def outside_payload(quads: DataFrame) -> DataFrame:
    """Quads that are not payload: other named graphs, and the default graph beside a named payload."""
    other = quads.where(~F.col("g").isin(V.PAYLOAD_GRAPH, V.DEFAULT_GRAPH))
    _, beside = _looked_up(quads.where(F.col("g") == V.DEFAULT_GRAPH), quads.where(F.col("g") == V.PAYLOAD_GRAPH))
    return other.unionByName(beside.join(_named(quads), "msg_id", "left_semi"))


def with_payload(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Write translated triples ``msg_id, s, p, o`` back to the graph the payload came from."""
    named = _named(quads).withColumn("_named", F.lit(True))
    g = F.when(F.col("_named"), V.PAYLOAD_GRAPH).otherwise(F.lit(V.DEFAULT_GRAPH))
    apart, others = _looked_up(new, quads.where(F.col("g") == V.PAYLOAD_GRAPH))
    back = others.join(named, "msg_id", "left").withColumn("g", g).select(*quads.columns)
    plain = apart.withColumn("g", F.lit(V.DEFAULT_GRAPH)).select(*quads.columns)
    return outside_payload(quads).unionByName(back).unionByName(plain)


def split_nested(quads: Column) -> tuple[Column, Column, Column]:
    """Payload graph name, payload triples and remaining quads of an array of quads."""
    named = F.exists(quads, lambda q: q["g"] == V.PAYLOAD_GRAPH)
    g = F.when(named, F.lit(V.PAYLOAD_GRAPH)).otherwise(F.lit(V.DEFAULT_GRAPH))
    # the name is found once a message, not once a quad
    mine = let(g, lambda name: F.filter(quads, lambda q: q["g"] == name))
    triples = F.transform(mine, lambda q: F.struct(q["s"].alias("s"), q["p"].alias("p"), q["o"].alias("o")))
    return g, triples, let(g, lambda name: F.filter(quads, lambda q: q["g"] != name))

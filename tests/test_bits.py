"""Keys told by bits: no row is moved for a key that is surely not there, and collisions change nothing."""

import pytest
from pyspark.sql import functions as F

from quadloom import vocab as V
from quadloom.operators import payload as P, translate as TR
from quadloom.plans import bits
from quadloom.terms import META_DDL

QUAD_DDL = "msg_id string, " + META_DDL.removeprefix("struct<").removesuffix(">").replace(":", " ", 1).replace(",s:", ", s ").replace(",p:", ", p ").replace(",o:", ", o ")


def _quads(spark):
    rows = []
    for i in range(60):
        m = None if i == 7 else f"m{i}"
        for j in range(i % 6 + 1):
            rows.append((m, V.DEFAULT_GRAPH, ("iri", f"s{j}", "", ""), "p", ("lit", str(i), V.STRING, "")))
            if i % 3 == 0:
                rows.append((m, V.PAYLOAD_GRAPH, ("iri", f"s{j}", "", ""), "q", ("lit", str(i), V.STRING, "")))
    return spark.createDataFrame(rows, QUAD_DDL).repartition(3)


def _rows(df):
    return sorted((r["msg_id"] or "", r["g"], str(r["s"]), r["p"], str(r["o"])) for r in df.collect())


def test_a_key_that_is_there_has_a_bit(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("msg_id"))
    flagged = bits.with_flags(df, even=bits.key_bits(df.where("cast(msg_id as int) % 2 = 0")), none=bits.key_bits(df.where("false")))
    wrong = flagged.where((F.col("msg_id").cast("int") % 2 == 0) != F.col("even"))
    assert wrong.count() < 10 and wrong.where(~F.col("even")).isEmpty() and flagged.where("none").isEmpty()
    assert flagged.columns == ["msg_id", "even", "none"] and flagged.count() == 20_000


@pytest.mark.parametrize("n", [bits.BITS, 1, 16])
def test_payload_is_the_same_however_many_keys_share_a_bit(spark, monkeypatch, n):
    monkeypatch.setattr(bits, "BITS", n)
    quads = _quads(spark)
    named = quads.where(F.col("g") == V.PAYLOAD_GRAPH).select("msg_id").distinct()
    default = quads.where(F.col("g") == V.DEFAULT_GRAPH)
    mine = quads.where(F.col("g") == V.PAYLOAD_GRAPH).unionByName(default.join(named, "msg_id", "left_anti"))
    assert _rows(P.payload(quads)) == _rows(mine)
    beside = default.join(named, "msg_id", "left_semi")
    assert _rows(P.outside_payload(quads)) == _rows(beside)
    back = P.with_payload(quads, P.payload(quads).drop("g"))
    assert _rows(back) == _rows(mine.unionByName(beside))


@pytest.mark.parametrize("n", [bits.BITS, 1, 16])
def test_messages_are_split_by_size_however_many_share_a_bit(spark, monkeypatch, n):
    monkeypatch.setattr(bits, "BITS", n)
    quads = _quads(spark)
    small, large = TR.nest_quads(quads, limit=4)
    sizes = {r["msg_id"]: r["count"] for r in quads.groupBy("msg_id").count().collect() if r["msg_id"]}
    assert {r["msg_id"]: len(r["triples"]) + len(r["meta"]) for r in small.collect()} == {m: k for m, k in sizes.items() if k <= 4}
    assert {r["msg_id"]: r["count"] for r in large.groupBy("msg_id").count().collect()} == {m: k for m, k in sizes.items() if k > 4}


def test_rows_without_a_named_payload_are_not_moved(spark):
    quads = _quads(spark).where("msg_id is not null")
    rows = quads.where(F.col("g") == V.DEFAULT_GRAPH)
    apart, others = P._looked_up(rows, quads.where(F.col("g") == V.PAYLOAD_GRAPH))
    assert others.select("msg_id").distinct().count() == 20 and apart.select("msg_id").distinct().count() == 39
    assert "Exchange hashpartitioning(msg_id" not in apart._jdf.queryExecution().executedPlan().toString()

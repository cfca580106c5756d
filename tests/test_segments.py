"""Documents in pieces: their texts against the row-local writer, and the way back."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quadloom import vocab as V
from quadloom.operators import jsonld as J, segments as SG
from quadloom.terms import TERM_DDL
from tests.helpers import term

QUADS = f"msg_id string, g string, s {TERM_DDL}, p string, o {TERM_DDL}"


def random_quads(seed: int, messages: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    names = ["a", "b", "_:n", "_:a", "http://y/é", 'q"uote']
    values = [*names[:4], 1, ("x,\"]}", "xsd:string"), ("Grüße\n", "xsd:string"), ("", "xsd:string"), ("l" * 90, "xsd:string"), ("ja", "rdf:langString", "de")]
    rows = []
    for m in range(messages):
        for _ in range(rng.choice([1, 2, 9, 40])):
            g = rng.choice([V.DEFAULT_GRAPH, "http://g/1", "http://g/0"])
            rows.append((f"m{m}", g, term(rng.choice(names[:5])), rng.choice(["http://x/p", "http://x/q", V.RDF_TYPE]), term(rng.choice(values))))
    return rows


@pytest.mark.parametrize(("piece", "tasks"), [(1, 3), (400, 2), (1 << 20, 7)])
def test_segments_are_the_document(spark, piece, tasks):
    rows = random_quads(piece)
    quads = spark.createDataFrame(rows + rows[:5], QUADS)
    want = {r["msg_id"]: r["raw"] for r in J.quads_to_jsonld(quads.distinct())[0].collect()}
    found = SG.write_segments(quads, piece_bytes=piece, partitions=tasks).collect()
    for m, raw in want.items():
        mine = sorted((r["piece"], r["raw"]) for r in found if r["msg_id"] == m)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert "".join(x for _, x in mine) == raw
        assert piece > 1 or len(mine) == len({q for q in rows if q[0] == m})
    assert {r["msg_id"] for r in found} == set(want)


def test_pieces_are_read_apart(spark):
    quads = spark.createDataFrame(random_quads(9), QUADS)
    pieces = SG.write_pieces(quads, piece_bytes=300, partitions=4)
    assert all(json.loads(r["raw"])["@graph"] for r in pieces.collect())
    back = J.jsonld_to_quads(pieces).select(*quads.columns).distinct()
    assert sorted(map(str, back.collect())) == sorted(map(str, quads.distinct().collect()))


def test_a_large_message_is_spread_and_comes_back(spark):
    """One message, half of it one property of one node."""
    n = 20_000
    value = F.concat(F.lit("v"), F.col("id"))
    lit = F.struct(F.lit("lit").alias("kind"), value.alias("value"), F.lit(V.STRING).alias("dt"), F.lit("").alias("lang"))
    name = F.when(F.col("id") % 2 == 0, F.lit("http://x/hub")).otherwise(F.concat(F.lit("http://x/n"), F.col("id")))
    node = F.struct(F.lit("iri").alias("kind"), name.alias("value"), F.lit("").alias("dt"), F.lit("").alias("lang"))
    quads = spark.range(n).select(F.lit("big").alias("msg_id"), F.lit(V.DEFAULT_GRAPH).alias("g"), node.alias("s"), F.lit("http://x/p").alias("p"), lit.alias("o"))
    segments = SG.write_segments(quads, piece_bytes=8_000, partitions=8).orderBy("piece").collect()
    assert max(len(r["raw"]) for r in segments) < 8_200
    nodes = json.loads("".join(r["raw"] for r in segments))["@graph"]
    assert {x["@id"]: len(x["http://x/p"]) for x in nodes if len(x["http://x/p"]) > 1} == {"http://x/hub": n // 2}
    assert len(nodes) == 1 + n // 2
    pieces = SG.write_pieces(quads, piece_bytes=8_000, partitions=8)
    back = J.jsonld_to_quads(pieces).select(*quads.columns)
    got = back.select("s.value", "o.value").collect()
    assert len(got) == n and set(map(tuple, got)) == set(map(tuple, quads.select("s.value", "o.value").collect()))


def test_empty_messages(spark):
    quads = spark.createDataFrame([(None, "http://g/1", term("a"), "http://x/p", term(1))], QUADS)
    msgs = spark.createDataFrame([("e", 1), ("e", 2), (None, 3)], "msg_id string, k int")
    for write in (SG.write_segments, SG.write_pieces):
        found = sorted(map(tuple, write(quads, msgs).collect()), key=str)
        assert [r[:2] for r in found] == [("e", 0), (None, 0)] and found[0][2] == SG.EMPTY
        assert json.loads(found[1][2])["@graph"][0]["@id"] == "http://g/1"
        assert write(quads.where("false")).count() == 0

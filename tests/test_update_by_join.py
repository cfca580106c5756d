"""Cells whose join shows what stays: the same graphs as by the general way, and nothing deleted is written."""

import pytest
from pyspark.sql import functions as F

from quadloom import vocab as V
from quadloom.operators import nested, relational as R
from quadloom.plans.lineage import no_cut
from quadloom.plans.rules import Cell, compile_cell, pattern as t, text
from tests.helpers import X, as_set, frames, one_cell, triple

PAIR = Cell("pair", (t("?s", X + "a", "?v"), t("?s", X + "b", "?w")), (t("?s", X + "c", "?v"), t("?s", X + "a", "?w")))
CROSS = Cell("cross", (t("?s", X + "a", "?v"), t("?r", X + "b", "?w")), (t("?s", X + "c", "?w"),))
APART = Cell("apart", (t("?s", X + "a", "?v"), t("?r", X + "b", "?w")), (t("?s", X + "c", "?v"), t("?r", X + "d", "?w")))
FRESH = Cell("fresh", (t("?s", X + "a", "?v"), t("?v", X + "b", "?w")), (t("?s", X + "c", "_:n"), t("_:n", X + "d", "?w")))
FILTERED = Cell("filtered", (t("?s", X + "a", "?v"), t("?s", X + "b", "?w")), (t("?s", X + "c", "?w"),), filters=(("w", V.INTEGER),))
CONSTANT = Cell("constant", (t("?s", X + "a", text("1")), t("?s", X + "b", X + "k")), (t("?s", X + "c", "?s"),))
DROP = Cell("drop", (t("?s", X + "a", "?v"),), ())
CELLS = [PAIR, CROSS, APART, FRESH, FILTERED, CONSTANT, DROP]

GRAPHS = {
    "m1": [("s", "a", 1), ("s", "b", 2), ("s", "b", ("x", "xsd:string")), ("r", "a", 3), ("q", "b", 4), ("s", "z", 5)],
    "m2": [("s", "a", ("1", "xsd:string")), ("s", "b", "k"), ("s", "c", "s"), ("k", "b", "k"), ("s", "a", "k")],
    "m3": [("s", "b", 1), ("s", "b", 2)],
    "m4": [("s", "a", "s"), ("s", "b", "s"), ("s", "a", 7), (("7", "xsd:integer"), "b", 7), (("7", "xsd:integer"), "a", 7)],
}


def _long(spark):
    long, _ = frames(spark, GRAPHS)
    stray = frames(spark, {"m2": []})[0].schema  # a constant with a datatype it should not have
    row = ("m2", *triple("s", "b", "k"))
    return long.union(long).union(spark.createDataFrame([(row[0], row[1], row[2], ("iri", X + "k", "odd", ""))], stray))


def _by_flags(triples, cell):
    plan = compile_cell(cell)
    inside = triples.where(triples.p.isin(*plan.predicates))
    return as_set(R.merge_changes(inside, R.cell_changes(inside, plan, (0, 0)))) | as_set(triples.where(~triples.p.isin(*plan.predicates)))


@pytest.mark.parametrize("cell,hot", [*((c, R.HOT_ROWS) for c in CELLS), (PAIR, 2), (CROSS, 2), (FRESH, 0), (CONSTANT, 0)])
def test_same_graphs_with_and_without_hot_keys(spark, monkeypatch, cell, hot):
    monkeypatch.setattr(R, "HOT_ROWS", hot)
    triples = _long(spark)
    done = R.apply_cell(triples, compile_cell(cell))
    assert as_set(done) == _by_flags(triples, cell)
    assert done.where(done.p.isin(*compile_cell(cell).predicates)).groupBy(*R.KEY).count().where("count > 1").isEmpty()


@pytest.mark.parametrize("cell", [PAIR, APART], ids=lambda c: c.cell_id)
def test_agrees_with_the_nested_form(spark, cell):
    long, nest = frames(spark, {k: v for k, v in GRAPHS.items() if k != "m4"})
    program = one_cell(cell)
    want = {(r["msg_id"], tuple(x["s"]), x["p"], tuple(x["o"])) for r in nested.apply_program(nest, program).collect() for x in r["triples"]}
    assert as_set(R.apply_program(long, program, None, no_cut)) == want


@pytest.mark.parametrize("cell", [PAIR, CROSS, FRESH, APART], ids=lambda c: c.cell_id)
def test_matched_triples_are_read_once_and_not_written_again(spark, cell):
    long, _ = frames(spark, GRAPHS)
    plan = R.apply_cell(long, compile_cell(cell))._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" not in plan and plan.count("Join") <= 2


def test_cells_that_one_join_does_not_settle_take_the_general_way():
    three = Cell("three", (t("?s", X + "a", "?v"), t("?s", X + "b", "?w"), t("?s", X + "c", "?u")), ())
    twice = Cell("twice", (t("?s", X + "a", "?v"), t("?v", X + "a", "?w")), ())
    assert not R._by_join(compile_cell(three)) and not R._by_join(compile_cell(twice)) and R._by_join(compile_cell(PAIR))


@pytest.mark.parametrize("cell", [PAIR, CROSS, FRESH], ids=lambda c: c.cell_id)
def test_pairs_are_moved_once(spark, cell):
    long, _ = frames(spark, GRAPHS)
    plan = R.apply_cell(long, compile_cell(cell))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("cell", [PAIR, CROSS, FRESH], ids=lambda c: c.cell_id)
def test_absent_messages_meet_nothing(spark, cell):
    long = _long(spark)
    lost = long.where("msg_id = 'm1'").withColumn("msg_id", F.lit(None).cast("string"))
    done = R.apply_cell(long.unionByName(lost), compile_cell(cell))
    assert as_set(done.where("msg_id is null")) == as_set(lost) and as_set(done.where("msg_id is not null")) == _by_flags(long, cell)

"""Constraints on rule tables against a plain check of the same rows."""

import pytest

from catalog import corpus as C
from catalog.rules import READINGS
from quadloom.operators import constraints as K
from quadloom.sources import rule_tables as RT

SF = "/root/testdata/sf0.001"


def blank(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), ddl) for n, ddl in RT.TABLES.items()}


def found(df):
    return {(r["name"], r["cell_id"], r["rule"]): r["n"] for r in df.collect()}


def test_a_good_rule_set_has_no_row(spark):
    head = {"source ontology", "target ontology"}
    got = found(K.violations(RT.tables_from_cells(spark, [READINGS])))
    assert {rule for _, _, rule in got} <= head | {"relation"}


def test_every_kind(spark):
    var = (True, ("iri", "a", "", ""))
    tables = blank(
        spark,
        alignment=[("a", "1", "no iri", "http://t/", "", "", None, ""), ("a", "1", "http://s/", "", "", "", None, ""), ("b", "1", None, "http://t/", "", "", None, "")],
        alignment_step=[("a", "1", 0, -1, "c"), ("a", "1", 1, 2, ""), ("x", "1", 0, None, "c")],
        cell=[("a", "1", "c", 0, "<", None), ("a", "1", "c", 1, "=", None), ("a", "1", None, 2, "=", None)],
        cell_pattern=[("a", "1", "c", 1, var, "rel", var), ("a", "1", "c", 2, (False, ("lit", "v", "", "")), "http://p", (False, ("lit", "v", "nope", ""))),
                      ("a", "1", "lost", 1, var, "http://p", var)],
        cell_typing=[("a", "1", "c", "", "http://d")], cell_filter=[("a", "1", "c", "v", "d"), ("a", "1", "c", "v", None)],
        cell_function=[("a", "1", "c", 0, "", "r", [(1, "v", "3", None), (2, None, "x", "http://w#integer"), (None, None, "9" * 30, "http://w#integer")])],
    )
    assert found(K.violations(tables)) == {
        ("a", None, "one header"): 2, ("a", None, "source ontology is an IRI"): 1, ("a", None, "target ontology"): 1,
        ("a", None, "step order"): 1, ("a", None, "step names a cell"): 1,
        ("b", None, "source ontology"): 1, ("b", None, "steps"): 0, ("b", None, "cells"): 0,
        ("x", None, "one header"): 0, ("x", None, "cells"): 0,
        ("a", "c", "one cell of an id"): 2, ("a", "c", "known relation"): 1, ("a", "c", "predicate is an IRI"): 1,
        ("a", "c", "subject is a node"): 1, ("a", "c", "literal has a datatype"): 1, ("a", "c", "typing variable"): 1,
        ("a", "c", "filter datatype"): 1, ("a", "c", "function name"): 1, ("a", "c", "parameter is a variable or a value"): 1,
        ("a", "c", "integer parameter"): 1, ("a", "c", "parameter position"): 1,
        ("a", "lost", "one cell of an id"): 0, ("a", "lost", "entity 2"): 0,
        # the cell without an id
        ("a", None, "cell id"): 1, ("a", None, "entity 1"): 0, ("a", None, "entity 2"): 0,
    }


def test_constraints_as_a_table(spark):
    own = [K.Constraint("few steps", "alignment_step", "alignment", "count", high=2), K.Constraint("late", "alignment_step", "alignment", "expression", arg="ordinal < 3")]
    assert K.read_constraints(K.constraint_table(spark, own)) == own
    tables = C.rule_corpus(spark, SF)
    steps = [(r["name"], r["ordinal"]) for r in tables["alignment_step"].collect()]
    want = {}
    for name in {n for n, _ in steps}:
        mine = [o for n, o in steps if n == name]
        if len(mine) > 2:
            want[name, None, "few steps"] = len(mine)
        if late := sum(o >= 3 for o in mine):
            want[name, None, "late"] = late
    assert found(K.violations(tables, own)) == want
    assert found(K.violations(tables, [])) == {} and found(K.violations(blank(spark))) == {}


@pytest.mark.parametrize("wrong", [
    K.Constraint("r", "nowhere", "cell", "count"), K.Constraint("r", "cell", "cell", "odd"), K.Constraint("r", "cell", "cell", "required"),
    K.Constraint("r", "alignment_step", "cell", "count"), K.Constraint("r", "cell", "cell", "pattern", "p"),
])
def test_malformed_constraints(spark, wrong):
    with pytest.raises(ValueError):
        K.violations(blank(spark), [wrong])


def test_one_shuffle(spark):
    plan = K.violations(C.rule_corpus(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_rows_are_as_wide_as_an_owner_has_counts(spark):
    plan = K.violations(C.rule_corpus(spark, SF))._jdf.queryExecution().optimizedPlan()
    keys = next(line for line in plan.toString().splitlines() if "Aggregate [" in line)
    assert keys.count("sum(") == 3

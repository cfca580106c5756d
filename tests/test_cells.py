"""Golden graphs: one per rule of the update semantics, in both forms."""

import random

import pytest

from quadloom import vocab as V
from quadloom.operators import nested, relational
from quadloom.plans.lineage import no_cut
from quadloom.plans.rules import (
    Alignment, Cell, FunctionCall, Param, RuleBook, RuleError, Slot, Term, compile_cell, compile_program, pattern as t, text,
)
from tests.helpers import X, expected, frames, nested_set, one_cell, run_both


def fn(name, ret, *args):
    params = tuple(Param(i, var=a[1:]) if isinstance(a, str) and a.startswith("?") else Param(i, val=str(a)) for i, a in enumerate(args))
    return FunctionCall(name, params, ret)


CASES = {
    "empty entity 1": (
        Cell("c", (), (t(X + "a", X + "p", X + "b"),)),
        {"1": [("s", "q", "o")], "2": []},
        {"1": [("s", "q", "o"), ("a", "p", "b")], "2": [("a", "p", "b")]},
    ),
    "empty entity 2": (Cell("c", (t("?s", X + "p", "?o"),), ()), {"1": [("s", "p", "o"), ("s", "q", "o")]}, {"1": [("s", "q", "o")]}),
    "repeated variable": (
        Cell("c", (t("?s", X + "p", "?s"),), (t("?s", X + "self", text("y")),)),
        {"1": [("a", "p", "a"), ("a", "p", "b")]},
        {"1": [("a", "self", ("y", V.STRING)), ("a", "p", "b")]},
    ),
    "disconnected patterns, mixed output": (
        Cell("c", (t("?a", X + "p", "?b"), t("?c", X + "q", "?d")), (t("?a", X + "r", "?d"),)),
        {"1": [("a", "p", "1"), ("b", "p", "1"), ("c", "q", "x"), ("c", "q", "y")], "2": [("a", "p", "1")]},
        {"1": [("a", "r", "x"), ("a", "r", "y"), ("b", "r", "x"), ("b", "r", "y")], "2": [("a", "p", "1")]},
    ),
    "disconnected patterns, separate outputs": (
        Cell("c", (t("?a", X + "p", "?b"), t("?c", X + "q", "?d")), (t("?a", X + "r", "?b"),)),
        {"1": [("a", "p", "1"), ("c", "q", "x")], "2": [("a", "p", "1")], "3": [("c", "q", "x")]},
        {"1": [("a", "r", "1")], "2": [("a", "p", "1")], "3": [("c", "q", "x")]},
    ),
    "delete and insert the same triple": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "p", "?o"),)), {"1": [("s", "p", "o")]}, {"1": [("s", "p", "o")]},
    ),
    "insert of an existing triple": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?o"),)),
        {"1": [("s", "p", "o"), ("s", "q", "o")]}, {"1": [("s", "q", "o")]},
    ),
    "unbound result: delete happens, insert does not": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?r"), t("?s", X + "k", "?o")), functions=(fn("/", "r", "?o", 0),)),
        {"1": [("s", "p", 4)]}, {"1": [("s", "k", 4)]},
    ),
    "untyped number in arithmetic": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?r"),), functions=(fn("+", "r", "?o", 1),)),
        {"1": [("s", "p", ("4", V.STRING))]}, {"1": []},
    ),
    "the same with a typing": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?r"),), typings=(("o", V.INTEGER),), functions=(fn("+", "r", "?o", 1),)),
        {"1": [("s", "p", ("4", V.STRING))]}, {"1": [("s", "q", 5)]},
    ),
    "names with a common prefix": (
        Cell("c", (t("?n1", X + "p", "?n10"),), (t("?n1", X + "q", "?n10"),), typings=(("n1", V.INTEGER),)),
        # n1 is typed, so entity 2 reads a literal subject, which is no triple.
        {"1": [("s", "p", "o")]}, {"1": []},
    ),
    "typed variable in two functions": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "a", "?x"), t("?s", X + "b", "?y")), typings=(("o", V.INTEGER),),
             functions=(fn("+", "x", "?o", 1), fn("*", "y", "?o", "?x"))),
        {"1": [("s", "p", ("4", V.STRING))]}, {"1": [("s", "a", 5), ("s", "b", 20)]},
    ),
    "three-argument minus": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?r"),), functions=(fn("-", "r", "?o", 2, 3),)),
        {"1": [("s", "p", 10)]}, {"1": [("s", "q", 5)]},
    ),
    "language tag and quotes": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?o"),)),
        {"1": [("s", "p", ('say "hi"\n', V.LANG_STRING, "en"))]}, {"1": [("s", "q", ('say "hi"\n', V.LANG_STRING, "en"))]},
    ),
    "literal constant": (
        Cell("c", (t("?s", X + "p", text("1", V.INTEGER)),), (t("?s", X + "one", text("y", lang="en")),)),
        {"1": [("s", "p", 1), ("t", "p", ("1", V.STRING))]},
        {"1": [("s", "one", ("y", V.LANG_STRING, "en")), ("t", "p", ("1", V.STRING))]},
    ),
    "constant pattern as a condition": (
        Cell("c", (t(X + "on", X + "is", X + "on"), t("?s", X + "p", "?o")), (t("?s", X + "q", "?o"),)),
        {"1": [("on", "is", "on"), ("s", "p", "o")], "2": [("s", "p", "o")]},
        {"1": [("s", "q", "o")], "2": [("s", "p", "o")]},
    ),
    "datatype filter": (
        Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?o"),), filters=(("o", V.INTEGER), ("other", V.STRING))),
        {"1": [("s", "p", 1), ("s", "p", ("1", V.STRING)), ("s", "p", "iri")]},
        {"1": [("s", "q", 1), ("s", "p", ("1", V.STRING)), ("s", "p", "iri")]},
    ),
    "cyclic pattern": (
        Cell("c", (t("?a", X + "p", "?b"), t("?b", X + "p", "?c"), t("?c", X + "p", "?a")), (t("?a", X + "tri", "?b"),)),
        {"1": [("1", "p", "2"), ("2", "p", "3"), ("3", "p", "1"), ("3", "p", "4")]},
        {"1": [("1", "tri", "2"), ("2", "tri", "3"), ("3", "tri", "1"), ("3", "p", "4")]},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    cell, before, after = CASES[name]
    assert run_both(spark, before, one_cell(cell)) == expected(after)


def test_fresh_nodes_differ_per_solution_and_repeat_per_run(spark):
    cell = Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "_:a"), t("_:a", X + "v", "?o"), t("_:a", X + "w", "_:b")))
    graphs = {"1": [("s", "p", 1), ("s", "p", 2)], "2": [("s", "p", 1)]}
    first, again = run_both(spark, graphs, one_cell(cell)), run_both(spark, graphs, one_cell(cell))
    assert first == again
    nodes = {o for _, _, p, o in first if p == X + "q"}
    assert len(nodes) == 3 and len({o for _, _, p, o in first if p == X + "w"}) == 3
    assert len(first) == 9


def test_markers_and_anonymous_nodes(spark):
    sv = V.SRIPAS
    cell = Cell(
        "c",
        (t("_:x", V.RDF_TYPE, sv + "node_n"), t("_:x", X + "p", sv + "node_v"), t(sv + "node_v", X + "q", "_:any")),
        (t(sv + "node_n", X + "r", "_:y"), t("_:y", V.RDF_TYPE, sv + "node_v")),
    )
    plan = compile_cell(cell)
    assert {v for g in plan.groups for v in g.variables} == {"node_n", "node_v", "_:any"}
    assert run_both(spark, {"1": [("a", "p", "b"), ("b", "q", 5)]}, one_cell(cell)) == expected({"1": [("a", "r", "b")]})


def test_steps_run_in_document_order_and_may_repeat(spark):
    up = Cell("up", (t("?s", X + "n", "?o"),), (t("?s", X + "n", "?r"),), functions=(fn("+", "r", "?o", 1),))
    twice = Cell("twice", (t("?s", X + "n", "?o"),), (t("?s", X + "n", "?r"),), functions=(fn("*", "r", "?o", 2),))
    assert run_both(spark, {"1": [("s", "n", 3)]}, [up, twice, up]) == expected({"1": [("s", "n", 9)]})


def test_predicate_variable_is_opt_in(spark):
    cell = Cell("c", (t("?s", "?p", X + "o"),), (t("?s", X + "has", "?p"),))
    with pytest.raises(RuleError):
        compile_cell(cell)
    out = run_both(spark, {"1": [("s", "p", "o"), ("s", "q", "z")]}, one_cell(cell, predicate_vars=True))
    assert out == expected({"1": [("s", "has", "p"), ("s", "q", "z")]})


def test_malformed_cell_is_skipped_and_reported(spark):
    bad = Cell("bad", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?r"),), functions=(fn("NOPE", "r", "?o"),))
    good = Cell("good", (t("?s", X + "p", "?o"),), (t("?s", X + "ok", "?o"),))
    al = Alignment("a", "1", ("bad", "good"), {"bad": bad, "good": good})
    program = compile_program([al])
    assert [w[2] for w in program.warnings] == ["bad"]
    assert run_both(spark, {"1": [("s", "p", "o")]}, program) == expected({"1": [("s", "ok", "o")]})
    with pytest.raises(RuleError):
        compile_program([al], on_error="fail")


def test_missing_cell_and_unknown_alignment():
    with pytest.raises(ValueError, match="missing cell"):
        compile_program([Alignment("a", "1", ("x",), {})])
    with pytest.raises(ValueError, match="unknown alignment"):
        RuleBook([]).program([("a", "1")])
    assert RuleBook([]).program([("", "")]).steps == ()


def test_unrelated_parts_form_no_product():
    plan = compile_cell(CASES["disconnected patterns, separate outputs"][0])
    assert len(plan.groups) == 2
    assert len(compile_cell(CASES["disconnected patterns, mixed output"][0]).groups) == 1


def _random_cell(rng):
    names = ["?a", "?b", "?c"]

    def slot(obj=False):
        return rng.choice(names + ([X + rng.choice("xyz")] if obj else []))

    e1 = tuple(t(slot(), X + rng.choice("pqr"), slot(True)) for _ in range(rng.randint(1, 3)))
    e2 = tuple(t(slot(), X + rng.choice("pqrs"), rng.choice([slot(True), "_:f"])) for _ in range(rng.randint(0, 2)))
    return Cell(f"c{rng.random()}", e1, e2)


@pytest.mark.parametrize("seed", range(6))
def test_both_forms_agree_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    graphs = {
        str(m): list({(rng.choice("xyzuv"), rng.choice("pqr"), rng.choice("xyzuv")) for _ in range(rng.randint(0, 9))})
        for m in range(8)
    }
    run_both(spark, graphs, [_random_cell(rng) for _ in range(2)])


def test_nested_plan_grows_linearly_with_steps(spark):
    cell = Cell("c", (t("?s", X + "p", "?o"), t("?o", X + "q", "?v")), (t("?s", X + "p", "?o"), t("?o", X + "q", "?v")))
    _, nest = frames(spark, {"1": [("s", "p", "o")]})

    def size(n):
        program = compile_program([Alignment("a", "1", ("c",) * n, {"c": cell})])
        out = nested.apply_program(nest, program).where("size(triples) > 0")
        return len(out._jdf.queryExecution().optimizedPlan().toString())

    assert size(9) < 3.5 * size(3)


def test_independent_steps_need_no_cut_and_dependent_ones_do(spark):
    a = Cell("a", (t("?s", X + "p", "?o"),), (t("?s", X + "p2", "?o"),))
    b = Cell("b", (t("?s", X + "q", "?o"),), (t("?s", X + "q2", "?o"),))
    long, _ = frames(spark, {"1": [("s", "p", "o"), ("s", "q", "o"), ("s", "z", "o")]})
    cuts = []

    def cut(df):
        cuts.append(1)
        return no_cut(df)

    def run(*cells):
        cuts.clear()
        relational.apply_program(long, compile_program([Alignment("t", "1", tuple(c.cell_id for c in cells), {c.cell_id: c for c in cells})]), cut=cut)
        return len(cuts)

    after_a = Cell("c", (t("?s", X + "p2", "?o"),), (t("?s", X + "p3", "?o"),))
    assert run(a, b) == 0
    assert run(a, after_a) == 1


def test_relational_plan_prunes_columns_and_predicates(spark):
    from quadloom import lift

    orders, lines = (lift.read(spark, "/root/testdata/sf0.001", x) for x in ("orders", "lineitem"))
    q = lift.orders_long(orders, lines).drop("g")
    cell = Cell("c", (t("?o", lift.SRC + "status", "?s"),), (t("?o", X + "state", "?s"),))
    inside = q.where(q.p == lift.SRC + "status")
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    changed = relational.cell_changes(inside, compile_cell(cell), (0, 0))
    assert "CartesianProduct" not in changed._jdf.queryExecution().executedPlan().toString()


def test_duplicate_input_triples_are_one(spark):
    _, nest = frames(spark, {"1": [("s", "p", "o"), ("s", "p", "o")]})
    out = nested.apply_program(nest, one_cell(Cell("c", (t("?s", X + "p", "?o"),), (t("?s", X + "q", "?o"),))))
    assert len(nested_set(out)) == 1


def test_literal_subject_is_malformed():
    with pytest.raises(RuleError):
        compile_cell(Cell("c", (t(Slot(term=Term("lit", "x", V.STRING)), X + "p", "?o"),)))


def test_nested_update_compares_triples_by_fields(spark):
    """Same triples in the same order as ``array_except``, absent fields and repeated triples included,
    without the comparison of nested structs that builds an ordering for each pair."""
    from pyspark.sql import functions as F

    from quadloom.terms import TRIPLE_DDL, except_triples

    row = lambda s, o, dt="", kind="lit": (("iri", s, "", ""), X + "p", (kind, o, dt, ""))
    pool = [row("a", "1"), row("a", "1", "int"), row("a", None), row(None, None), row("a", "1", kind="iri"), (None, X + "p", None), row("b", "1")]
    rng = random.Random(5)
    rows = [(i, rng.choices(pool, k=rng.randint(0, 9)), rng.choices(pool, k=rng.randint(0, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, a array<{TRIPLE_DDL}>, b array<{TRIPLE_DDL}>")
    got = df.select("i", except_triples(F.col("a"), F.col("b")).alias("got"), F.array_except("a", "b").alias("want"))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).isEmpty()
    cell = Cell("c", (t("?a", X + "p", "?b"),), (t("?a", X + "q", "?b"),))
    plan = nested.apply_program(frames(spark, {"m": [("a", "p", "b")]})[1], one_cell(cell))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan

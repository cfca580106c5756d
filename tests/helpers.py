"""Small graphs in and out, as plain Python values."""

from __future__ import annotations

from quadloom import vocab as V
from quadloom.operators import nested, relational
from quadloom.plans.lineage import no_cut
from quadloom.plans.rules import Alignment, Program, Step, compile_cell, compile_program
from quadloom.terms import META_DDL, TRIPLE_DDL

X = "http://x/"


def term(value):
    """``"iri"``, ``"_:b"``, or a tuple ``(lexical, datatype[, lang])``; numbers are literals."""
    if isinstance(value, bool):
        return ("lit", str(value).lower(), V.BOOLEAN, "")
    if isinstance(value, int):
        return ("lit", str(value), V.INTEGER, "")
    if isinstance(value, tuple):
        return ("lit", value[0], V.expand(value[1]), value[2] if len(value) > 2 else "")
    if value.startswith("_:"):
        return ("bnode", value[2:], "", "")
    return ("iri", value if ":" in value else X + value, "", "")


def triple(s, p, o):
    return (term(s), p if ":" in p else X + p, term(o))


def frames(spark, graphs: dict):
    """Long and nested form of ``{msg_id: [(s, p, o), ...]}``."""
    rows = [(m, *triple(*t)) for m, ts in graphs.items() for t in ts]
    long = spark.createDataFrame(rows, "msg_id string, s struct<kind:string,value:string,dt:string,lang:string>, p string, o struct<kind:string,value:string,dt:string,lang:string>")
    nest = [(m, "", [triple(*t) for t in ts], []) for m, ts in graphs.items()]
    ddl = f"msg_id string, payload_g string, triples array<{TRIPLE_DDL}>, meta array<{META_DDL}>"
    return long, spark.createDataFrame(nest, ddl)


def as_set(df):
    return {(r["msg_id"], tuple(r["s"]), r["p"], tuple(r["o"])) for r in df.collect()}


def nested_set(df):
    return {(r["msg_id"], tuple(t["s"]), t["p"], tuple(t["o"])) for r in df.collect() for t in r["triples"]}


def one_cell(cell, predicate_vars=False) -> Program:
    return Program((Step("t", "1", 0, 0, cell.cell_id, compile_cell(cell, predicate_vars)),))


def run_both(spark, graphs, program):
    """Result of a program in both forms, which must agree."""
    if isinstance(program, list):
        program = compile_program([Alignment("t", "1", tuple(c.cell_id for c in program), {c.cell_id: c for c in program})])
    long, nest = frames(spark, graphs)
    msgs = nest.select("msg_id")
    a = as_set(relational.apply_program(long, program, msgs, no_cut))
    b = nested_set(nested.apply_program(nest, program))
    assert a == b
    return a


def expected(graphs):
    return {(m, *triple(*t)) for m, ts in graphs.items() for t in ts}

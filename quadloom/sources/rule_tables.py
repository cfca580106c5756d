"""Rule sets as tables, and the step from tables to compiled rules.

The tables are the canonical form of a rule set. Quality checks run over them as ordinary
DataFrames; only the rule sets a job really uses are collected, to build its plan.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.plans.rules import Alignment, Cell, FunctionCall, Param, Pattern, RuleBook, Slot, Term
from quadloom.terms import TERM_DDL

SLOT_DDL = f"struct<is_var:boolean,term:{TERM_DDL}>"
PARAM_DDL = "struct<pos:int,var:string,val:string,datatype:string>"
TABLES = {
    "alignment": "name string, version string, source_onto string, target_onto string, creator string,"
    " description string, created timestamp, source_text string",
    "alignment_step": "name string, version string, ordinal int, order_attr int, cell_id string",
    "cell": "name string, version string, cell_id string, ordinal int, relation string, error string",
    "cell_pattern": f"name string, version string, cell_id string, side int, s {SLOT_DDL}, p string, o {SLOT_DDL}",
    "cell_typing": "name string, version string, cell_id string, var string, datatype string",
    "cell_filter": "name string, version string, cell_id string, var string, datatype string",
    "cell_function": f"name string, version string, cell_id string, ordinal int, fname string, ret string, params array<{PARAM_DDL}>",
}
KEY = ["name", "version"]


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], ddl) for n, ddl in TABLES.items()}


def _slot(row) -> Slot:
    if row["is_var"]:
        return Slot(var=row["term"]["value"])
    t = row["term"]
    return Slot(term=Term(t["kind"], t["value"], t["dt"] or "", t["lang"] or ""))


def load_rulebook(tables: dict[str, DataFrame], keys: DataFrame | None = None) -> RuleBook:
    """Compile-time form of the rule sets in ``tables``, or of those listed in ``keys``."""

    def rows(name: str):
        df = tables[name]
        if keys is not None:
            df = df.join(keys.select(*KEY).distinct(), KEY, "left_semi")
        return df.toLocalIterator()

    parts: dict[tuple, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for table in ("cell_pattern", "cell_typing", "cell_filter", "cell_function"):
        for r in rows(table):
            parts[(r["name"], r["version"], r["cell_id"])][table].append(r)
    cells: dict[tuple, dict[str, Cell]] = defaultdict(dict)
    for r in rows("cell"):
        own = parts[(r["name"], r["version"], r["cell_id"])]
        sides = {1: [], 2: []}
        for q in own["cell_pattern"]:
            sides[q["side"]].append(Pattern(_slot(q["s"]), Slot(term=Term("iri", q["p"])), _slot(q["o"])))
        fns = tuple(
            FunctionCall(f["fname"], tuple(Param(p["pos"], p["var"], p["val"], p["datatype"]) for p in f["params"]), f["ret"])
            for f in sorted(own["cell_function"], key=lambda f: f["ordinal"])
        )
        cells[(r["name"], r["version"])][r["cell_id"]] = Cell(
            # Tables have no row order; a fixed one keeps plans the same from run to run.
            r["cell_id"], tuple(sorted(sides[1], key=repr)), tuple(sorted(sides[2], key=repr)),
            tuple((t["var"], t["datatype"]) for t in own["cell_typing"]),
            tuple((t["var"], t["datatype"]) for t in own["cell_filter"]), fns, r["error"],
        )
    steps = defaultdict(list)
    for r in rows("alignment_step"):
        steps[(r["name"], r["version"])].append((r["ordinal"], r["cell_id"]))
    book = [
        Alignment(r["name"], r["version"], tuple(c for _, c in sorted(steps[(r["name"], r["version"])])), cells[(r["name"], r["version"])])
        for r in rows("alignment")
    ]
    return RuleBook(book)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def tables_from_cells(spark: SparkSession, alignments: list[Alignment]) -> dict[str, DataFrame]:
    """Rule tables of rule sets authored in code."""
    rows: dict[str, list] = {n: [] for n in TABLES}

    def slot(x: Slot):
        if x.var:
            return (True, ("iri", x.var, "", ""))
        return (False, (x.term.kind, x.term.value, x.term.dt, x.term.lang))

    for a in alignments:
        k = (a.name, a.version)
        rows["alignment"].append((*k, "", "", "", "", None, ""))
        rows["alignment_step"] += [(*k, i, i, c) for i, c in enumerate(a.steps)]
        for n, (cid, c) in enumerate(a.cells.items()):
            rows["cell"].append((*k, cid, n, "=", c.error))
            for side, pats in ((1, c.entity1), (2, c.entity2)):
                rows["cell_pattern"] += [(*k, cid, side, slot(q.s), q.p.term.value, slot(q.o)) for q in pats]
            rows["cell_typing"] += [(*k, cid, *t) for t in c.typings]
            rows["cell_filter"] += [(*k, cid, *t) for t in c.filters]
            rows["cell_function"] += [
                (*k, cid, i, f.name, f.ret, [(p.pos, p.var, p.val, p.datatype) for p in f.params])
                for i, f in enumerate(c.functions)
            ]
    return {n: spark.createDataFrame(rows[n], ddl) for n, ddl in TABLES.items()}


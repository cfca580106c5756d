"""Constraints on rule tables, given as rows and compiled to one grouped pass.

A constraint is a row ``rule, tbl, per, kind, col, arg, low, high, cond``:

=============  =====================================================================================
``required``   ``col`` is neither null nor empty
``values``     ``col`` is one of the comma-separated values in ``arg``
``pattern``    ``col`` matches the regular expression in ``arg``
``datatype``   ``col`` can be read as the Spark type in ``arg``
``expression`` the SQL condition in ``arg`` is true
``count``      between ``low`` and ``high`` rows (null: no bound) for each owner
=============  =====================================================================================

``per`` is the owner, ``alignment`` or ``cell``; ``cond`` is an SQL condition that picks the rows to look at.
Nulls and empty values violate ``required`` alone. An owner is whatever any row names, so a count of none is
found also where the owner's own row is missing. Rows repeated are counted each. Every table is read once,
rows are summed before they are shuffled, and nothing is gathered. A rule that rows violate is a row of its own there, so
rows are as wide as one owner has counts, and not as there are constraints. Besides the rule tables there is
``cell_function_param``, a row for each parameter of a function.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CONSTRAINT_DDL = "rule string, tbl string, per string, kind string, col string, arg string, low int, high int, cond string"
KINDS = ("required", "values", "pattern", "datatype", "expression", "count")
OWNERS = ("alignment", "cell")
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
NO_OWN_CELL = ("alignment", "alignment_step")


@dataclass(frozen=True)
class Constraint:
    rule: str
    tbl: str
    per: str
    kind: str
    col: str | None = None
    arg: str | None = None
    low: int | None = None
    high: int | None = None
    cond: str | None = None


#: What a rule set must have to be run.
CONFORMING = [
    Constraint("one header", "alignment", "alignment", "count", low=1, high=1),
    Constraint("name", "alignment", "alignment", "required", "name"),
    Constraint("version", "alignment", "alignment", "required", "version"),
    Constraint("source ontology", "alignment", "alignment", "required", "source_onto"),
    Constraint("source ontology is an IRI", "alignment", "alignment", "pattern", "source_onto", ABSOLUTE),
    Constraint("target ontology", "alignment", "alignment", "required", "target_onto"),
    Constraint("target ontology is an IRI", "alignment", "alignment", "pattern", "target_onto", ABSOLUTE),
    Constraint("steps", "alignment_step", "alignment", "count", low=1),
    Constraint("step names a cell", "alignment_step", "alignment", "required", "cell_id"),
    Constraint("step order", "alignment_step", "alignment", "expression", arg="order_attr is null or order_attr >= 0"),
    Constraint("cells", "cell", "alignment", "count", low=1),
    Constraint("one cell of an id", "cell", "cell", "count", low=1, high=1),
    Constraint("cell id", "cell", "cell", "required", "cell_id"),
    Constraint("relation", "cell", "cell", "required", "relation"),
    Constraint("known relation", "cell", "cell", "values", "relation", "="),
    Constraint("entity 1", "cell_pattern", "cell", "count", low=1, cond="side = 1"),
    Constraint("entity 2", "cell_pattern", "cell", "count", low=1, cond="side = 2"),
    Constraint("subject is a node", "cell_pattern", "cell", "values", "s.term.kind", "iri,bnode", cond="not s.is_var"),
    Constraint("predicate is an IRI", "cell_pattern", "cell", "pattern", "p", ABSOLUTE),
    Constraint("literal has a datatype", "cell_pattern", "cell", "pattern", "o.term.dt", ABSOLUTE, cond="not o.is_var and o.term.kind = 'lit'"),
    Constraint("typing variable", "cell_typing", "cell", "required", "var"),
    Constraint("typing datatype", "cell_typing", "cell", "pattern", "datatype", ABSOLUTE),
    Constraint("filter variable", "cell_filter", "cell", "required", "var"),
    Constraint("filter datatype", "cell_filter", "cell", "pattern", "datatype", ABSOLUTE),
    Constraint("function name", "cell_function", "cell", "required", "fname"),
    Constraint("function result", "cell_function", "cell", "required", "ret"),
    Constraint("parameter is a variable or a value", "cell_function_param", "cell", "expression", arg="(var is null) <> (val is null)"),
    Constraint("parameter position", "cell_function_param", "cell", "required", "pos"),
    Constraint("integer parameter", "cell_function_param", "cell", "datatype", "val", "decimal(38,0)", cond="datatype like '%#integer'"),
]


def constraint_table(spark: SparkSession, constraints: list[Constraint]) -> DataFrame:
    return spark.createDataFrame([astuple(c) for c in constraints], CONSTRAINT_DDL)


def read_constraints(table: DataFrame) -> list[Constraint]:
    """Constraints held in a table. They become the plan, so they are read on the driver, a few rows."""
    return [Constraint(**r.asDict()) for r in table.orderBy("rule").toLocalIterator()]


def _checked(constraints: list[Constraint], tables: dict[str, DataFrame]) -> None:
    rules = [c.rule for c in constraints]
    for c in constraints:
        if c.kind not in KINDS or c.per not in OWNERS or c.tbl not in tables:
            raise ValueError(f"constraint {c.rule}: unknown kind, owner or table: {c.kind}, {c.per}, {c.tbl}")
        if c.per == "cell" and c.tbl in NO_OWN_CELL:
            raise ValueError(f"constraint {c.rule}: {c.tbl} belongs to an alignment")
        if c.kind not in ("count", "expression") and not c.col:
            raise ValueError(f"constraint {c.rule}: no column")
        if c.kind in ("values", "pattern", "datatype", "expression") and c.arg is None:
            raise ValueError(f"constraint {c.rule}: no argument")
        if rules.count(c.rule) > 1:
            raise ValueError(f"constraint {c.rule}: given twice")


def _bad(c: Constraint) -> Column:
    """Whether a row counts for a constraint: as a violation, or for ``count`` as a row."""
    if c.kind == "count":
        found = F.lit(True)
    elif c.kind == "expression":
        found = ~F.coalesce(F.expr(c.arg), F.lit(False))
    else:
        value = F.col(c.col).cast("string")
        given = F.coalesce(value, F.lit("")) != ""
        found = {
            "required": lambda: ~given,
            "values": lambda: given & ~value.isin(*c.arg.split(",")),
            "pattern": lambda: given & ~value.rlike(c.arg),
            "datatype": lambda: given & value.try_cast(c.arg).isNull(),
        }[c.kind]()
    return found & F.coalesce(F.expr(c.cond), F.lit(False)) if c.cond else found


def violations(tables: dict[str, DataFrame], constraints: list[Constraint] | None = None) -> DataFrame:
    """``name, version, cell_id, rule, n``: violated constraints of each owner (``cell_id`` is null for a rule set
    as a whole), with the number of violating rows, or of all rows for ``count``."""
    constraints = CONFORMING if constraints is None else constraints
    tables = dict(tables)
    if "cell_function" in tables:
        tables["cell_function_param"] = tables["cell_function"].select("name", "version", "cell_id", F.inline("params"))
    _checked(constraints, tables)

    counts = {per: [c for c in constraints if c.kind == "count" and c.per == per] for per in OWNERS}
    single = [c for c in constraints if c.kind != "count"]
    # one row of an owner holds the sums of all its counts, one row more those of each rule that rows violate
    width = max(1, *[len(m) for m in counts.values()])
    # the tables that make an owner known, besides those with a constraint
    used = [t for t in tables if t in ("alignment", "cell") or any(c.tbl == t for c in constraints)]

    def of(tbl: str) -> DataFrame:
        def row(per: str, at: int, sums: list[Column]) -> Column:
            cell = F.col("cell_id") if per == "cell" else F.lit(None).cast("string")
            sums = sums + [F.lit(0)] * (width - len(sums))
            return F.struct(F.lit(per == "cell").alias("is_cell"), cell.alias("cell_id"), F.lit(at).alias("at"), *[x.alias(f"c{k}") for k, x in enumerate(sums)])

        rows = [F.when(_bad(c), row(c.per, i, [F.lit(1)])) for i, c in enumerate(single) if c.tbl == tbl]
        # a function's parameters name no owner that the function does not
        implied = tbl == "cell_function_param" and "cell_function" in used
        for per in OWNERS:
            own = [F.when(_bad(c), 1).otherwise(0) if c.tbl == tbl else F.lit(0) for c in counts[per]]
            if own and (per == "alignment" or tbl not in NO_OWN_CELL) and not (implied and all(c.tbl != tbl for c in counts[per])):
                rows.append(row(per, -1, own))
        if not rows:
            return None
        return tables[tbl].select("name", "version", F.inline(F.array_compact(F.array(*rows))))

    every = [r for t in used if (r := of(t)) is not None]
    if not every:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("cell_id", "string"), ("rule", "string"), ("n", "bigint"))]
        return tables["alignment"].select("name", "version", *none).limit(0)
    sums = reduce(DataFrame.unionByName, every).groupBy("name", "version", "is_cell", "cell_id", "at").agg(
        *[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])

    def finding(per: str, k: int, c: Constraint) -> Column:
        n = F.col(f"c{k}")
        wrong = (n < (c.low or 0)) | (n > c.high if c.high is not None else F.lit(False))
        own = (F.col("at") < 0) & (F.col("is_cell") == F.lit(per == "cell"))
        return F.when(own & wrong, F.struct(F.lit(c.rule).alias("rule"), n.alias("n")))

    rules = F.array(*[F.lit(c.rule) for c in single]) if single else F.array(F.lit(None).cast("string"))
    violated = F.when(F.col("at") >= 0, F.struct(F.get(rules, F.col("at")).alias("rule"), F.col("c0").alias("n")))
    found = F.array_compact(F.array(violated, *[finding(per, k, c) for per in OWNERS for k, c in enumerate(counts[per])]))
    return sums.select("name", "version", "cell_id", F.inline(found))

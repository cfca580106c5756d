"""Quality checks of rule sets and channels, as one report ``name, version, cell_id, rule, detail``.

All checks are joins and aggregations over the rule tables, one row per finding: nothing is
gathered per rule set, so a rule set of any size is checked like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom import vocab as V

KEY = ["name", "version"]
CELL = [*KEY, "cell_id"]
CHANNEL_TYPES = ("MM", "KK")
#: How a cell mentions a variable.
BOUND, IN_ENTITY2, IN_PARAM = 1, 2, 4


def normal_id(c: Column) -> Column:
    """One normalisation for cell ids and step references."""
    return F.when(c.startswith(V.SRIPAS), F.substring(c, F.lit(len(V.SRIPAS) + 1), F.length(c))).otherwise(c)


def _finding(df: DataFrame, rule: str, detail: Column | str, cell: bool = True) -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    cell_id = F.col("cell_id") if cell else F.lit("")
    return df.select(*KEY, cell_id.alias("cell_id"), F.lit(rule).alias("rule"), d.alias("detail"))


def _marker(value: Column) -> Column:
    name = F.substring(value, F.lit(len(V.SRIPAS) + 1), F.length(value))
    return F.when(value.startswith(V.SRIPAS) & (name != ""), name)


def var_name(value: Column) -> Column:
    return F.coalesce(_marker(value), F.ltrim(value, F.lit("?")))


def _slot_var(slot: str) -> Column:
    term = F.col(slot)["term"]
    return F.when(F.col(slot)["is_var"], term["value"]).when(term["kind"] == "iri", _marker(term["value"]))


def pattern_variables(cell_pattern: DataFrame, side: int) -> DataFrame:
    """``name, version, cell_id, var`` of one entity, distinct."""
    found = F.array(_slot_var("s"), _marker(F.col("p")), _slot_var("o"))
    return cell_pattern.where(F.col("side") == side).select(*CELL, F.explode(found).alias("var")).where("var is not null").distinct()


def return_variables(cell_function: DataFrame) -> DataFrame:
    return cell_function.select(*CELL, var_name(F.col("ret")).alias("var")).distinct()


def param_variables(cell_function: DataFrame) -> DataFrame:
    params = cell_function.select(*CELL, F.explode("params").alias("prm")).where("prm.var is not null")
    return params.select(*CELL, var_name(F.col("prm.var")).alias("var")).distinct()


def bound_variables(tables: dict[str, DataFrame]) -> DataFrame:
    return pattern_variables(tables["cell_pattern"], 1).unionByName(return_variables(tables["cell_function"])).distinct()


def _cell_counts(cell: DataFrame) -> DataFrame:
    return cell.groupBy(*KEY, normal_id(F.col("cell_id")).alias("cell_id")).agg(F.count("*").alias("n"))


def duplicate_cells(cell: DataFrame) -> DataFrame:
    return _finding(_cell_counts(cell).where("n > 1"), "cell id not unique", F.col("n").cast("string"))


def missing_step_cells(steps: DataFrame, cell: DataFrame) -> DataFrame:
    # counted as for duplicates, so that one shuffle serves both
    ids = _cell_counts(cell).where("n > 0")
    bad = steps.withColumn("cell_id", normal_id(F.col("cell_id"))).join(ids, CELL, "left_anti")
    return _finding(bad, "step names a missing cell", F.col("ordinal").cast("string"))


def unbound_variables(tables: dict[str, DataFrame]) -> DataFrame:
    """Variables that entity 2 or a function parameter reads and nothing binds. Every mention of a variable in a
    cell is one flagged row, and one grouped pass with map-side combine tells which are read only."""
    found = F.array(_slot_var("s"), _marker(F.col("p")), _slot_var("o"))
    side = F.when(F.col("side") == 1, BOUND).when(F.col("side") == 2, IN_ENTITY2)
    patterns = tables["cell_pattern"].select(*CELL, F.explode(found).alias("var"), side.alias("flag")).where("var is not null and flag is not null")
    calls = tables["cell_function"]
    ret = calls.select(*CELL, var_name(F.col("ret")).alias("var"), F.lit(BOUND).alias("flag"))
    params = calls.select(*CELL, F.explode("params").alias("prm")).where("prm.var is not null")
    params = params.select(*CELL, var_name(F.col("prm.var")).alias("var"), F.lit(IN_PARAM).alias("flag"))
    mentions = patterns.unionByName(ret).unionByName(params).groupBy(*CELL, "var").agg(F.bit_or("flag").alias("uses"))
    # A cell without a complete name is no other's equal: nothing binds its variables.
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*CELL, "var"]])
    uses = F.col("uses")
    rules = F.array(
        F.when(uses.bitwiseAND(IN_ENTITY2) != 0, "unbound variable in entity 2"),
        F.when(uses.bitwiseAND(IN_PARAM) != 0, "unbound function parameter"),
    )
    bad = mentions.where((uses.bitwiseAND(BOUND) == 0) | ~named)
    return bad.select(*CELL, F.explode(rules).alias("rule"), F.col("var").alias("detail")).where("rule is not null")


def unbound_entity2(tables: dict[str, DataFrame]) -> DataFrame:
    return unbound_variables(tables).where(F.col("rule") == "unbound variable in entity 2")


def unbound_params(tables: dict[str, DataFrame]) -> DataFrame:
    return unbound_variables(tables).where(F.col("rule") == "unbound function parameter")


def step_order(steps: DataFrame) -> DataFrame:
    """Steps run in document order; warn where a step's order attribute is below the previous
    step's. Ordinals are consecutive, so the previous step is found by an equi-join and no rule set
    has to be sorted in one task."""
    before = steps.select(*KEY, (F.col("ordinal") + 1).alias("ordinal"), F.col("order_attr").alias("before"))
    seen = steps.join(before, [*KEY, "ordinal"]).where("order_attr < before")
    return _finding(seen, "order attribute disagrees with document order", F.col("order_attr").cast("string"))


def malformed_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """Entities must hold valid triples, and their markup must have been readable."""
    s, o = F.col("s"), F.col("o")

    def absolute(c: Column) -> Column:
        return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")

    problem = (
        F.when(~s["is_var"] & (s["term"]["kind"] == "lit"), "literal subject")
        .when(~absolute(F.col("p")), "predicate is not an IRI")
        .when(~o["is_var"] & (o["term"]["kind"] == "lit") & ~absolute(o["term"]["dt"]), "datatype is not an IRI")
    )
    bad = tables["cell_pattern"].withColumn("problem", problem).where("problem is not null")
    unread = tables["cell"].where("error is not null")
    return _finding(bad, "malformed entity", F.col("problem")).unionByName(_finding(unread, "malformed entity", F.col("error")))


def structure(tables: dict[str, DataFrame]) -> DataFrame:
    """Required parts of a rule set: one pass over counts per rule set and per cell."""
    tagged = reduce(
        DataFrame.unionByName,
        [
            tables["alignment"].select(*KEY, F.lit(1).alias("h"), F.lit(0).alias("st"), F.lit(0).alias("c"),
                                       (F.col("source_onto") != "").cast("int").alias("o1"),
                                       (F.col("target_onto") != "").cast("int").alias("o2")),
            tables["alignment_step"].select(*KEY, F.lit(0).alias("h"), F.lit(1).alias("st"), F.lit(0).alias("c"), F.lit(0).alias("o1"), F.lit(0).alias("o2")),
            tables["cell"].select(*KEY, F.lit(0).alias("h"), F.lit(0).alias("st"), F.lit(1).alias("c"), F.lit(0).alias("o1"), F.lit(0).alias("o2")),
        ],
    )
    counts = tagged.groupBy(*KEY).agg(*[F.sum(x).alias(x) for x in ("h", "st", "c", "o1", "o2")])
    checks = F.array(
        F.when(F.col("h") == 0, "no header"),
        F.when(F.col("h") > 1, "more than one header"),
        F.when((F.col("h") > 0) & (F.col("o1") == 0), "no source ontology"),
        F.when((F.col("h") > 0) & (F.col("o2") == 0), "no target ontology"),
        F.when(F.col("st") == 0, "no steps"),
        F.when(F.col("c") == 0, "no cells"),
    )
    header = counts.select(*KEY, F.explode(checks).alias("detail")).where("detail is not null")
    header = _finding(header, "structure", F.col("detail"), cell=False)

    sides = tables["cell_pattern"].groupBy(*CELL).agg(F.max((F.col("side") == 1).cast("int")).alias("e1"), F.max((F.col("side") == 2).cast("int")).alias("e2"))
    cells = tables["cell"].join(sides, CELL, "left").select(
        *CELL,
        F.explode(F.array(
            F.when(F.coalesce("e1", F.lit(0)) == 0, "entity 1 is empty"),
            F.when(F.coalesce("e2", F.lit(0)) == 0, "entity 2 is empty"),
            F.when(F.coalesce("relation", F.lit("")) == "", "no relation"),
            F.when(F.col("cell_id") == "", "no cell id"),
        )).alias("detail"),
    ).where("detail is not null")
    return header.unionByName(_finding(cells, "structure", F.col("detail")))


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """All checks; a rule set without a row is valid."""
    return reduce(
        DataFrame.unionByName,
        [
            duplicate_cells(tables["cell"]),
            missing_step_cells(tables["alignment_step"], tables["cell"]),
            unbound_variables(tables),
            step_order(tables["alignment_step"]),
            malformed_entities(tables),
            structure(tables),
        ],
    )


def valid_alignments(tables: dict[str, DataFrame], report: DataFrame) -> DataFrame:
    return tables["alignment"].join(report.select(*KEY).distinct(), KEY, "left_anti")


def check_channels(channels: DataFrame, alignments: DataFrame) -> DataFrame:
    """``id, rule, detail`` per channel: known type, known alignments, parallelism of at least one."""
    unknown = []
    for side in ("inp", "out"):
        refs = channels.select("id", F.col(f"{side}_name").alias("name"), F.col(f"{side}_version").alias("version"))
        bad = refs.where("name <> '' or version <> ''").join(alignments.select(*KEY).distinct(), KEY, "left_anti")
        unknown.append(bad.select("id", F.lit("unknown alignment").alias("rule"), F.concat_ws(":", "name", "version").alias("detail")))
    kind = channels.where(~F.col("chan_type").isin(*CHANNEL_TYPES)).select("id", F.lit("channel type").alias("rule"), F.col("chan_type").alias("detail"))
    par = channels.where("parallelism < 1").select("id", F.lit("parallelism").alias("rule"), F.col("parallelism").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [*unknown, kind, par])

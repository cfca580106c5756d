"""Nested form: cells over messages that carry their graph as an array of triples.

Everything is row-local, so a program over any number of messages is one narrow projection: no
shuffle and, in a stream, no state. The loops are nested over one message, which is right while a
message is small; :mod:`quadloom.operators.translate` sends large ones to the relational form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.operators import bindings as B
from quadloom.plans.rules import Bind, CellPlan, Group, Pattern, Program
from quadloom.terms import barrier, except_triples, let, same_term, triple


def _names(variables) -> dict[str, str]:
    return {v: f"v{i}" for i, v in enumerate(sorted(variables))}


def _solutions(triples: Column, group: Group, names: dict[str, str]) -> Column:
    """Array of solutions of the group's patterns."""
    if not group.patterns:
        return F.array(F.struct(F.lit(True).alias("any")))
    # Constant slots are tested once per triple, not once per partial solution.
    def candidate(pat: Pattern) -> Column:
        return F.filter(triples, lambda t: B.matches_constants(pat, t["s"], t["p"], t["o"]))

    candidates = F.struct(*[candidate(q).alias(f"c{i}") for i, q in enumerate(group.patterns)])

    def level(found: Column, i: int, env: dict[str, Column]) -> Column:
        pat = group.patterns[i]

        def joined(t: Column) -> Column:
            cond = F.lit(True)
            for v, col in B.slot_values(pat, t["s"], t["p"], t["o"]).items():
                if v in env:
                    cond = cond & same_term(col, env[v])
            return cond

        rows = found[f"c{i}"]
        if any(v in env for v in pat.variables):
            rows = F.filter(rows, joined)

        def extend(t: Column) -> Column:
            inner = {**B.slot_values(pat, t["s"], t["p"], t["o"]), **env}
            if i + 1 < len(group.patterns):
                return level(found, i + 1, inner)
            fields = [inner[v].alias(c) for v, c in names.items()]
            return F.struct(*fields) if fields else F.struct(F.lit(True).alias("any"))

        rows = F.transform(rows, extend)
        return F.flatten(rows) if i + 1 < len(group.patterns) else rows

    return let(candidates, lambda found: level(found, 0, {}))


def solutions(triples: Column, group: Group, msg_id: Column, scope: tuple[int, int]) -> tuple[Column, dict[str, str]]:
    """Solutions of a group with filters applied and computed variables added one after another,
    so that no expression is repeated for a later function that reads it."""
    names = _names(group.variables)
    rows = _solutions(triples, group, names)
    for var, dt in group.filters:
        rows = _filtered(rows, names[var], dt)
    for i, bind in enumerate(group.binds):
        rows = _extended(rows, bind, dict(names), f"f{i}")
        names[bind.out] = f"f{i}"
    labels = {f"n{i}": x for i, x in enumerate(B.fresh_names(group))}
    if labels:
        rows = _labelled(rows, labels, group, dict(names), msg_id, scope)
    return rows, {**names, **{B.FRESH + x: c for c, x in labels.items()}}


def _filtered(rows: Column, field: str, datatype: str) -> Column:
    return F.filter(rows, lambda b: B.has_datatype(b[field], datatype))


def _extended(rows: Column, bind: Bind, names: dict[str, str], field: str) -> Column:
    def extend(b: Column) -> Column:
        return b.withField(field, B.bind_value(bind, lambda v: b[names[v]] if v in names else None))

    return F.transform(rows, extend)


def _labelled(rows: Column, labels: dict[str, str], group: Group, names: dict[str, str], msg_id: Column, scope) -> Column:
    def extend(b: Column) -> Column:
        env = lambda v: b[names[v]] if v in names else None
        for field, label in labels.items():
            b = b.withField(field, B.fresh_label(label, group, env, msg_id, scope))
        return b

    return F.transform(rows, extend)


def _instantiate(rows: Column, names: dict[str, str], patterns, group: Group, msg_id: Column, scope) -> Column | None:
    if not patterns:
        return None

    def one(b: Column) -> Column:
        env = lambda v: b[names[v]] if v in names else None
        out = []
        for pat in patterns:
            s, p, o, valid = B.template(pat, group, env, msg_id, scope)
            out.append(F.when(valid, triple(s, p, o)))
        return F.array(*out)

    return F.filter(F.flatten(F.transform(rows, one)), lambda t: t.isNotNull())


def apply_cell(
    msgs: DataFrame, cell: CellPlan, scope: tuple[int, int] = (0, 0), guard: Column | None = None
) -> DataFrame:
    """One cell over messages ``msg_id, triples, ...``; all other columns pass through. With
    ``guard``, rows where it does not hold are left alone, and cost nothing."""
    work, parts = msgs, []
    for i, group in enumerate(cell.groups):
        rows, names = solutions(F.col("triples"), group, F.col("msg_id"), scope)
        work = work.withColumn(f"_rows{i}", rows if guard is None else F.when(guard, rows))
        parts.append((F.col(f"_rows{i}"), names, group))
    deleted, inserted = [], []
    for rows, names, group in parts:
        for target, patterns in ((deleted, group.delete), (inserted, group.insert)):
            made = _instantiate(rows, names, patterns, group, F.col("msg_id"), scope)
            if made is not None:
                target.append(made)
    if not deleted and not inserted:
        return msgs
    new = F.col("triples")
    if deleted:
        new = except_triples(new, _concat(deleted))
    if inserted:
        made = _concat(inserted)
        new = let(new, lambda kept: F.concat(kept, except_triples(made, kept)))
    # A rule holds as a whole: every group needs a solution.
    fires = reduce(lambda a, b: a & b, [F.size(rows) > 0 for rows, _, _ in parts])
    if guard is not None:
        fires = guard & fires
    work = work.withColumn("triples", F.when(fires, new).otherwise(F.col("triples")))
    return work.drop(*[f"_rows{i}" for i in range(len(parts))])


def _concat(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def apply_program(msgs: DataFrame, program: Program, guard: Column | None = None) -> DataFrame:
    """Apply compiled steps in order to nested messages."""
    out = msgs
    for step in program.active:
        out = apply_cell(out, step.plan, (step.position, step.ordinal), guard)
    return barrier(out, "triples") if program.active else out

"""Relational form: cells over long quads, for batches and for graphs of any size.

Matching is a chain of equi-joins on ``(msg_id, shared variables)``. The update is one aggregation:
kept, deleted and inserted triples are unioned with a flag and reduced per triple, which is delete,
insert and set semantics in a single shuffle with map-side combine. Its key is the whole triple, so
one huge message spreads over all tasks.

Where each triple falls under one pattern at most and one join tells whether it is part of a solution,
the join itself gives what stays: triples that are deleted are not written again, neither as kept nor
as deleted. Two patterns meet message by message, so that the result is a set without a second shuffle;
messages with very many triples are counted before and take the general way.

Only triples whose predicate a cell mentions take part in it; all others bypass the cell untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.operators import bindings as B
from quadloom.plans.lineage import cut_lineage
from quadloom.plans.rules import CellPlan, Group, Pattern, Program, Step, order_patterns

KEY = ["msg_id", "s", "p", "o"]
KEPT, DELETED, INSERTED = 1, 2, 4
#: Messages are counted by this many buckets; a bucket of more rows than that may hold one huge message.
BUCKETS = 1 << 16
HOT_ROWS = 250_000
#: Most rows of whole messages that a task takes, more or less, and rows that are not worth a task.
ROWS_A_TASK, FEW_ROWS = 500_000, 10_000


def scan_pattern(triples: DataFrame, pat: Pattern, names: dict[str, str]) -> DataFrame:
    """Triples matching one pattern, as ``msg_id`` plus one term column per variable."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    out = [v.alias(names[k]) for k, v in B.slot_values(pat, s, p, o).items()]
    return triples.where(B.matches_constants(pat, s, p, o)).select("msg_id", *out)


def _names(variables) -> dict[str, str]:
    """Column per variable. Positional, as variable names are free text."""
    return {v: f"v{i}" for i, v in enumerate(sorted(variables))}


def _match(triples: DataFrame, patterns: tuple[Pattern, ...], names: dict[str, str]) -> DataFrame:
    acc, bound = None, set()
    for pat in patterns:
        side = scan_pattern(triples, pat, names)
        if acc is None:
            acc = side
        elif pat.variables <= bound or not pat.variables:
            on = ["msg_id", *sorted(names[v] for v in pat.variables)]
            acc = acc.join(side, on, "left_semi")
        else:
            on = ["msg_id", *sorted(names[v] for v in pat.variables & bound)]
            acc = acc.join(side, on)
        bound |= pat.variables
    return acc


def match_bgp(triples: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...]) -> DataFrame:
    """Solutions of a graph pattern per message: ``msg_id`` and one term column per variable."""
    variables = set().union(*[p.variables for p in patterns])
    names = _names(variables)
    out = _match(triples, tuple(order_patterns(patterns)), names)
    return out.select("msg_id", *[F.col(names[v]).alias(v) for v in sorted(variables)])


def typed_filter(bindings: DataFrame, var: str, datatype: str) -> DataFrame:
    return bindings.where(B.has_datatype(F.col(f"`{var}`"), datatype))


def retype(bindings: DataFrame, var: str, datatype: str) -> DataFrame:
    """Add ``<var>_typed``: the lexical form of ``var`` under another datatype."""
    from quadloom.plans.rules import TYPED_SUFFIX, Bind, variable

    bind = Bind(var + TYPED_SUFFIX, (variable(var),), datatype=datatype)
    return bindings.withColumn(bind.out, B.bind_value(bind, lambda v: F.col(f"`{v}`")))


def bind_functions(bindings: DataFrame, binds) -> DataFrame:
    """Add computed variables in order; later ones may read earlier ones."""
    for b in binds:
        known = set(bindings.columns)
        env = lambda v: F.col(f"`{v}`") if v in known else None
        bindings = bindings.withColumn(b.out, B.bind_value(b, env))
    return bindings


def solve(
    triples: DataFrame, group: Group, msgs: DataFrame | None, scope: tuple[int, int] = (0, 0)
) -> tuple[DataFrame, dict[str, str]]:
    """Solutions of a group, computed variables and labels of fresh nodes included."""
    names = _names(group.variables)
    if group.patterns:
        out = _match(triples, group.patterns, names)
    else:
        out = msgs.select("msg_id")
    for var, dt in group.filters:
        out = out.where(B.has_datatype(F.col(names[var]), dt))
    return _computed(out, names, group, scope)


def _computed(
    out: DataFrame, names: dict[str, str], group: Group, scope: tuple[int, int]
) -> tuple[DataFrame, dict[str, str]]:
    """Solutions with computed variables and labels of fresh nodes."""
    for i, b in enumerate(group.binds):
        env = lambda v: F.col(names[v]) if v in names else None
        value = B.bind_value(b, env)
        names = {**names, b.out: f"f{i}"}
        out = out.withColumn(f"f{i}", value)
    env = lambda v: F.col(names[v]) if v in names else None
    labels = {f"n{i}": x for i, x in enumerate(B.fresh_names(group))}
    made = {c: B.fresh_label(x, group, env, F.col("msg_id"), scope) for c, x in labels.items()}
    return out.withColumns(made) if made else out, {**names, **{B.FRESH + x: c for c, x in labels.items()}}


def _changes(solutions: DataFrame, names: dict[str, str], group: Group, scope: tuple[int, int]) -> DataFrame | None:
    """Deleted and inserted triples of every solution, in one pass over the solutions."""
    env = lambda v: F.col(names[v]) if v in names else None
    rows = []
    for flag, patterns in ((DELETED, group.delete), (INSERTED, group.insert)):
        for pat in patterns:
            s, p, o, valid = B.template(pat, group, env, F.col("msg_id"), scope)
            row = F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(flag).alias("flag"))
            rows.append(F.when(valid, row))
    if not rows:
        return None
    if len(rows) == 1:
        return solutions.select("msg_id", rows[0].alias("r")).where("r is not null").select("msg_id", "r.*")
    return (
        solutions.select("msg_id", F.explode(F.array(*rows)).alias("r"))
        .where("r is not null")
        .select("msg_id", "r.*")
    )


def cell_changes(triples: DataFrame, cell: CellPlan, scope: tuple[int, int], msgs: DataFrame | None = None) -> DataFrame | None:
    """``msg_id, s, p, o, flag`` of everything the cell deletes or inserts."""
    solved = [(g, *solve(triples, g, msgs, scope)) for g in cell.groups]
    parts = []
    for i, (g, rows, names) in enumerate(solved):
        for j, (_, other, _) in enumerate(solved):
            if i != j:
                rows = rows.join(other.select("msg_id").distinct(), "msg_id", "left_semi")
        part = _changes(rows, names, g, scope)
        if part is not None:
            parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else None


def _by_join(cell: CellPlan) -> bool:
    """Whether each triple falls under one pattern at most, and one join shows that it is part of a solution."""
    patterns = [q for g in cell.groups for q in g.patterns]
    sizes = [len(g.patterns) for g in cell.groups]
    return (
        (sizes == [2] or set(sizes) == {1})
        and all(q.p.term for q in patterns)
        and len({q.p.term.value for q in patterns}) == len(patterns)
        and all(set(g.delete) == set(g.patterns) for g in cell.groups)
    )


def _matching(pat: Pattern, group: Group) -> Column:
    """Triples one pattern of a group matches, filters on its variables included."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    cond = B.matches_constants(pat, s, p, o)
    values = B.slot_values(pat, s, p, o)
    for var, dt in group.filters:
        if var in values:
            cond = cond & B.has_datatype(values[var], dt)
    return F.coalesce(cond, F.lit(False))


def _deletable(pat: Pattern) -> Column:
    """Whether a triple that the pattern matches is the one its template gives."""
    cond = F.lit(True)
    for x, col in ((pat.s, F.col("s")), (pat.o, F.col("o"))):
        cond = cond & (col.isNotNull() if x.var else col.eqNullSafe(B.const(x.term)))
    if pat.s.var:
        cond = cond & (F.col("s")["kind"] != "lit")
    return F.coalesce(cond, F.lit(False))


def _sizes(triples: DataFrame) -> tuple[int, list[int]]:
    """Rows in all, and the buckets of messages with very many of them. Summed before they are shuffled."""
    n = F.count("*").alias("n")
    sums = triples.groupBy(_bucket("msg_id").alias("b")).agg(n)
    found = sums.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > HOT_ROWS, F.col("b"))).alias("hot")).first()
    return found["n"] or 0, found["hot"]


def _bucket(*on) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(BUCKETS))


def _update_by_join(triples: DataFrame, cell: CellPlan, scope: tuple[int, int]) -> DataFrame:
    """Triples after the update, as a set."""
    owned = [(g, q) for g in cell.groups for q in g.patterns]
    if len(cell.groups) == 1 and len(owned) == 2:
        rows, hot = _sizes(triples)
        if not hot:
            return _update_pairs(triples, cell, scope, rows)
        large = _bucket("msg_id").isin(*hot)
        inside = triples.where(large)
        # a message is on one side only, so the two sets share no triple
        return _update_pairs(triples.where(~large), cell, scope, rows).unionByName(merge_changes(inside, cell_changes(inside, cell, scope)))
    names = [_names(g.variables) for g in cell.groups]

    def side(rows: DataFrame, i: int) -> DataFrame:
        g, q = owned[i]
        own = names[cell.groups.index(g)]
        out = [v.alias(own[k]) for k, v in B.slot_values(q, F.col("s"), F.col("p"), F.col("o")).items()]
        return rows.where(_matching(q, g)).select("msg_id", *out, _deletable(q).alias(f"m{i}"))

    parts = []
    sides = [side(triples, i) for i in range(len(owned))]
    for i, (g, q) in enumerate(owned):
        rows, solved = sides[i], F.lit(True)
        for j, other in enumerate(sides):
            if i != j:
                rows = rows.join(other.select("msg_id").distinct().withColumn(f"h{j}", F.lit(True)), "msg_id", "left")
                solved = solved & F.col(f"h{j}").isNotNull()
        stays = {q: ~solved & F.col(f"m{i}")} if len(owned) > 1 else {}
        if g.insert or stays:
            parts.append(_after(rows, names[i], g, scope, solved, stays))
    return reduce(DataFrame.unionByName, [triples.where(~_gone(owned)).select(*KEY), *parts]).dropDuplicates()


def _gone(owned: list[tuple[Group, Pattern]]) -> Column:
    """Triples that are written again only if they stay."""
    return reduce(lambda x, y: x | y, [_matching(q, g) & _deletable(q) for g, q in owned])


def _update_pairs(triples: DataFrame, cell: CellPlan, scope: tuple[int, int], n_rows: int) -> DataFrame:
    """The set of triples after a cell of one group of two patterns, moved once.

    The triples of a message go to one task, where those with equal shared variables are gathered: pairs are
    solutions, and what meets nothing stays. Solutions are compared there as well, as they keep their message.
    Messages with very many triples are not for this."""
    (g, a), (_, b) = owned = [(g, q) for g in cell.groups for q in g.patterns]
    names = _names(g.variables)
    shared = sorted(a.variables & b.variables)
    keys = [names[v] for v in shared]
    own = [[v for v in sorted(q.variables) if v not in shared] for q in (a, b)]

    def with_values(q: Pattern, i: int) -> DataFrame:
        values = B.slot_values(q, F.col("s"), F.col("p"), F.col("o"))
        mine = F.struct(*[values[v].alias(names[v]) for v in own[i]], _deletable(q).alias(f"m{i}"))
        found = triples.where(_matching(q, g)).select("msg_id", *[values[v].alias(names[v]) for v in shared], mine.alias(f"r{i}"))
        # as in a join, nothing meets by an absent key
        absent = reduce(Column.__or__, [F.col(c).isNull() for c in ("msg_id", *keys)])
        return found.withColumn("alone", F.when(absent, i))

    kept = triples.where(~_gone(owned)).select("msg_id", F.struct("s", "p", "o").alias("r2"), F.lit(2).alias("alone"))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [with_values(a, 0), with_values(b, 1), kept])
    cores = triples.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, -(-n_rows // FEW_ROWS)), -(-n_rows // ROWS_A_TASK), 1)
    lists = rows.repartition(tasks, "msg_id").groupBy("msg_id", *keys, "alone").agg(*[F.collect_list(f"r{i}").alias(f"r{i}") for i in range(3)])
    # one after another, so that the pairs of a key are never held
    for i in range(3):
        lists = lists.withColumn(f"r{i}", F.explode_outer(f"r{i}"))
    found = lists.select("msg_id", *keys, "r0.*", "r1.*", "r2")
    solved = F.col("m0").isNotNull() & F.col("m1").isNotNull()
    stays = {a: F.col("m0") & F.col("m1").isNull(), b: F.col("m1") & F.col("m0").isNull()}
    return _after(found, names, g, scope, solved, stays, F.col("r2")).dropDuplicates()


def _after(rows: DataFrame, names: dict[str, str], group: Group, scope: tuple[int, int], solved: Column, stays: dict[Pattern, Column], other: Column | None = None) -> DataFrame:
    """Inserted triples of the rows that are solutions, the matched triples that stay, and ``other`` triples of the rows."""
    rows, names = _computed(rows, names, group, scope)
    env = lambda v: F.col(names[v]) if v in names else None
    made = [(pat, solved) for pat in group.insert] + list(stays.items())
    out = [] if other is None else [other]
    for pat, cond in made:
        s, p, o, valid = B.template(pat, group, env, F.col("msg_id"), scope)
        out.append(F.when(cond & valid, F.struct(s.alias("s"), p.alias("p"), o.alias("o"))))
    return rows.select("msg_id", F.explode(F.array(*out)).alias("r")).where("r is not null").select("msg_id", "r.*")


def update(triples: DataFrame, cell: CellPlan, scope: tuple[int, int], msgs: DataFrame | None = None) -> DataFrame | None:
    """Triples ``msg_id, s, p, o`` after one cell, as a set; ``None`` for a cell that changes nothing."""
    if _by_join(cell) and not triples.isStreaming:
        return _update_by_join(triples, cell, scope)
    changes = cell_changes(triples, cell, scope, msgs)
    return None if changes is None else merge_changes(triples, changes)


def merge_changes(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply all deletes, then all inserts."""
    rows = triples.select(*KEY, F.lit(KEPT).alias("flag")).unionByName(changes.select(*KEY, "flag"))
    state = F.bit_or("flag").alias("state")
    kept = (F.col("state").bitwiseAND(INSERTED) != 0) | (F.col("state") == KEPT)
    return rows.groupBy(*KEY).agg(state).where(kept).select(*KEY)


def delete_matched(triples: DataFrame, matched: DataFrame) -> DataFrame:
    """Graph difference."""
    return triples.join(matched.select(*KEY), KEY, "left_anti")


def union_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Graph union with set semantics."""
    return a.unionByName(b).dropDuplicates()


def apply_cell(triples: DataFrame, cell: CellPlan, scope: tuple[int, int] = (0, 0), msgs: DataFrame | None = None) -> DataFrame:
    """One cell as one atomic update of payload triples ``msg_id, s, p, o``.

    ``msgs`` lists the messages a rule without a pattern applies to; without it, those that have
    at least one triple."""
    triples = triples.select(*KEY)
    if cell.unconditional and msgs is None:
        msgs = triples.select("msg_id").distinct()
    touched = cell.predicates
    inside = triples if touched is None else triples.where(F.col("p").isin(*sorted(touched)))
    merged = update(inside, cell, scope, msgs)
    if merged is None:
        return triples
    if touched is None:
        return merged
    return triples.where(~F.col("p").isin(*sorted(touched))).unionByName(merged)


@dataclass
class _State:
    """A graph split by predicate: ``owner`` names the fragment holding a predicate's triples now,
    ``base`` holds all others. Fragments that a later step reads are cut from their lineage, so the
    plan stays linear in the number of steps and untouched predicates are never rewritten."""

    base: DataFrame
    fragments: list[DataFrame] = field(default_factory=list)
    owner: dict[str, int] = field(default_factory=dict)

    def select(self, preds: frozenset[str]) -> DataFrame:
        parts = []
        own = sorted(p for p in preds if p not in self.owner)
        if own:
            parts.append(self.base.where(F.col("p").isin(*own)))
        for i in sorted({self.owner[p] for p in preds if p in self.owner}):
            mine = sorted(p for p in preds if self.owner.get(p) == i)
            parts.append(self.fragments[i].where(F.col("p").isin(*mine)))
        return reduce(DataFrame.unionByName, parts)

    def whole(self) -> DataFrame:
        out = self.base
        if self.owner:
            out = out.where(~F.col("p").isin(*sorted(self.owner)))
        for i, frag in enumerate(self.fragments):
            mine = sorted(p for p, k in self.owner.items() if k == i)
            if mine:
                out = out.unionByName(frag.where(F.col("p").isin(*mine)))
        return out

    def replace(self, preds: frozenset[str], new: DataFrame) -> None:
        self.fragments.append(new)
        self.owner.update({p: len(self.fragments) - 1 for p in preds})


def _reads_later(steps: tuple[Step, ...], i: int, preds: frozenset[str] | None) -> bool:
    for later in steps[i + 1:]:
        other = later.plan.predicates
        if preds is None or other is None or preds & other:
            return True
    return False


def apply_program(triples: DataFrame, program: Program, msgs: DataFrame | None = None, cut=cut_lineage) -> DataFrame:
    """Apply compiled steps in order. ``cut`` truncates lineage between dependent steps."""
    steps = program.active
    state = _State(triples.select(*KEY))
    if msgs is None and any(s.plan.unconditional for s in steps):
        msgs = triples.select("msg_id").distinct()
    for i, step in enumerate(steps):
        preds = step.plan.predicates
        if preds is not None and not preds:
            continue
        inside = state.whole() if preds is None else state.select(preds)
        merged = update(inside, step.plan, (step.position, step.ordinal), msgs)
        if merged is None:
            continue
        if _reads_later(steps, i, preds):
            merged = cut(merged)
        if preds is None:
            state = _State(merged)
        else:
            state.replace(preds, merged)
    return state.whole()


def count_by_step(triples: DataFrame, program: Program, msgs: DataFrame | None = None, cut=cut_lineage) -> DataFrame:
    """Effect report: triples each step really deleted and inserted, per message."""
    reports = []
    current = triples.select(*KEY)
    for step in program.active:
        after = cut(apply_program(current, Program((step,)), msgs, cut))
        reports.append(
            effect_report(current, after).select(
                "msg_id",
                F.lit(step.position).alias("alignment_pos"),
                F.lit(step.ordinal).alias("step"),
                F.lit(step.cell_id).alias("cell_id"),
                "deleted",
                "inserted",
            )
        )
        current = after
    return reduce(DataFrame.unionByName, reports)


def effect_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Messages whose graph changed, with the number of deleted and inserted triples."""
    rows = before.select(*KEY, F.lit(1).alias("side")).unionByName(after.select(*KEY, F.lit(2).alias("side")))
    per_triple = rows.groupBy(*KEY).agg(F.bit_or("side").alias("side")).where("side <> 3")
    return per_triple.groupBy("msg_id").agg(
        F.count_if(F.col("side") == 1).alias("deleted"), F.count_if(F.col("side") == 2).alias("inserted")
    )


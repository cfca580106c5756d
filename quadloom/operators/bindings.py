"""Column expressions shared by the relational and the nested form of a cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from quadloom.functions import registry
from quadloom.plans.rules import Bind, Group, Pattern, Slot, Term
from quadloom.terms import TERM, checked, iri, literal, make_term

#: Names of precomputed blank node labels among the variables of a solution.
FRESH = "_:fresh:"
Env = Callable[[str], "Column | None"]


def const(t: Term) -> Column:
    return make_term(t.kind, t.value, t.dt, t.lang)


def unbound() -> Column:
    return F.lit(None).cast(TERM)


def bind_value(bind: Bind, env: Env) -> Column:
    """Value of one computed variable; NULL when the computation is an error."""
    args = []
    for a in bind.args:
        col = env(a.var) if a.var else const(a.term)
        args.append(unbound() if col is None else col)
    if bind.function is None:
        lexical = registry.str_of(args[0])
        return checked(lexical, literal(lexical, bind.datatype))
    at = registry.pattern_argument(bind.function)
    if at is not None and at < len(args) and bind.args[at].var:
        args[at] = registry.safe_pattern(args[at])
    return registry.call(bind.function, args)


def has_datatype(value: Column, datatype: str) -> Column:
    """``datatype(v) = <T>``; an error (not a literal) is NULL and drops the row."""
    return registry.datatype_of(value) == datatype


def fresh_label(label: str, group: Group, env: Env, msg_id: Column, scope: tuple[int, int]) -> Column:
    """Blank node of one solution, the same on every run: solutions over all variables of a set
    graph are distinct, so hashing them is as good as a counter, and retries repeat it."""
    parts = [msg_id, F.lit(str(scope[0])), F.lit(str(scope[1])), F.lit(label)]
    for v in group.variables:
        col = env(v)
        parts += [F.coalesce(col[f], F.lit("")) for f in ("kind", "value", "dt", "lang")]
    return F.concat(F.lit("b"), F.md5(F.concat_ws("\u0001", *parts)))


def fresh_names(group: Group) -> list[str]:
    """Blank nodes the templates of a group mention, each once."""
    return sorted({x.fresh for q in group.insert for x in q.slots if x.fresh is not None})


def template(pat: Pattern, group: Group, env: Env, msg_id: Column, scope: tuple[int, int]):
    """``(s, p, o)`` of an instantiated template, and whether it is a valid triple.

    A template with an unbound variable, a literal subject or a predicate that is not an IRI gives
    no triple."""

    def slot(x: Slot) -> Column:
        if x.fresh is not None:
            known = env(FRESH + x.fresh)
            return make_term("bnode", fresh_label(x.fresh, group, env, msg_id, scope) if known is None else known)
        if x.var:
            col = env(x.var)
            return unbound() if col is None else col
        return const(x.term)

    s, o = slot(pat.s), slot(pat.o)
    valid = F.lit(True)
    if pat.s.var:
        valid = valid & s.isNotNull() & (s["kind"] != "lit")
    if pat.o.var:
        valid = valid & o.isNotNull()
    if pat.p.var:
        pv = slot(pat.p)
        p = F.when(pv["kind"] == "iri", pv["value"])
        valid = valid & F.coalesce(pv["kind"] == "iri", F.lit(False))
    else:
        p = F.lit(pat.p.term.value)
    return s, p, o, valid


def slot_values(pat: Pattern, s: Column, p: Column, o: Column) -> dict[str, Column]:
    """Variables a triple binds under a pattern."""
    out: dict[str, Column] = {}
    for x, col in ((pat.s, s), (pat.p, iri(p)), (pat.o, o)):
        if x.var:
            out.setdefault(x.var, col)
    return out


def matches_constants(pat: Pattern, s: Column, p: Column, o: Column) -> Column:
    """Constant slots and repeated variables of one pattern."""
    cond = F.lit(True)
    if pat.p.term:
        cond = cond & (p == pat.p.term.value)
    for x, col in ((pat.s, s), (pat.o, o)):
        if x.term:
            cond = cond & (col["value"] == x.term.value) & (col["kind"] == x.term.kind)
            if x.term.kind == "lit":
                cond = cond & (col["dt"] == x.term.dt) & (col["lang"] == x.term.lang)
    if pat.s.var and pat.s.var == pat.o.var:
        cond = cond & (s == o)
    if pat.p.var and pat.p.var in (pat.s.var, pat.o.var):
        other = s if pat.p.var == pat.s.var else o
        cond = cond & (other["kind"] == "iri") & (other["value"] == p)
    return cond

"""Rule sets used by the queries, tests and the bench."""

from __future__ import annotations

from quadloom import vocab as V
from quadloom.lift import SRC as S
from quadloom.plans.rules import Alignment, Cell, FunctionCall, Param, RuleBook, pattern as t, text

D = "http://example.org/dst#"

#: Observation node to a fresh reading node, for whole-number k only; the value is scaled.
READING = Cell(
    "reading",
    (t("?e", S + "observation", "?o"), t("?o", S + "value", "?v"), t("?o", S + "k", "?k")),
    (t("?e", D + "reading", "_:r"), t("_:r", D + "scaled", "?w"), t("_:r", D + "k", "?k")),
    filters=(("k", V.INTEGER),),
    functions=(FunctionCall("*", (Param(1, var="v"), Param(2, val="1.5")), "w"),),
)
#: Renames a predicate.
USER = Cell("user", (t("?e", S + "user", "?u"),), (t("?e", D + "actor", "?u"),))
#: Depends on the output of READING.
MARK = Cell(
    "mark",
    (t("?e", D + "reading", "?r"), t("?r", D + "scaled", "?w")),
    (t("?e", D + "reading", "?r"), t("?r", D + "amount", "?x")),
    functions=(FunctionCall("+", (Param(1, var="w"), Param(2, val="10")), "x"),),
)
#: Output side: prefixes the class with the actor.
LABEL = Cell(
    "label",
    (t("?e", D + "actor", "?u"), t("?e", V.RDF_TYPE, "?c")),
    (t("?e", D + "actor", "?u"), t("?e", D + "label", "?l")),
    functions=(
        FunctionCall("STR", (Param(1, var="c"),), "cs"),
        FunctionCall("STRAFTER", (Param(1, var="cs"), Param(2, val="#")), "cn"),
        FunctionCall("UCASE", (Param(1, var="cn"),), "l"),
    ),
)
MALFORMED = Cell("malformed", (t("?e", S + "user", "?u"),), (t("?e", D + "x", "?y"),), functions=(FunctionCall("NO_SUCH_FUNCTION", (Param(1, var="u"),), "y"),))

READINGS = Alignment("readings", "1", ("reading", "user", "mark"), {c.cell_id: c for c in (MARK, READING, USER)})
LABELS = Alignment("labels", "2", ("label",), {"label": LABEL})
BROKEN = Alignment("broken", "1", ("user", "malformed", "reading"), {c.cell_id: c for c in (USER, MALFORMED, READING)})
BOOK = RuleBook([READINGS, LABELS, BROKEN])

# --- single cells, one per rule of the update semantics ---------------------------------------

CELLS: dict[str, Cell] = {
    # Two unrelated parts, one insert needing both: their product inside a message.
    "cross_part_insert": Cell(
        "cross", (t("?o", S + "status", "?s"), t("?l", S + "part", "?p")), (t("?l", D + "status", "?s"), t("?l", S + "part", "?p"))
    ),
    # Two unrelated parts whose outputs do not mix: no product is formed.
    "independent_parts": Cell(
        "independent", (t("?o", S + "status", "?s"), t("?l", S + "part", "?p")), (t("?o", D + "state", "?s"), t("?l", D + "item", "?p"))
    ),
    "unconditional_insert": Cell("always", (), (t(D + "batch", D + "kind", text("events")), t("_:n", D + "by", D + "batch"))),
    "delete_only": Cell("drop", (t("?e", S + "user", "?u"), t("?e", S + "observation", "?o")), ()),
    "literal_constant": Cell(
        "final", (t("?o", S + "status", text("F")), t("?o", S + "customer", "?c")), (t("?o", D + "closed_for", "?c"),)
    ),
    "typing": Cell(
        "typing", (t("?o", S + "k", "?k"),), (t("?o", D + "k", "?k"), t("?o", D + "next", "?n")),
        typings=(("k", V.INTEGER),), functions=(FunctionCall("+", (Param(1, var="k"), Param(2, val="1")), "n"),),
    ),
    # A blank node named by its marker class; the marker triple itself matches nothing.
    "marker_class": Cell(
        "marker",
        (
            t("_:a", V.RDF_TYPE, V.SRIPAS + "node_o"), t("_:a", S + "value", V.SRIPAS + "node_v"),
            t(V.SRIPAS + "node_e", S + "observation", "_:a"),
        ),
        (t(V.SRIPAS + "node_e", D + "value", V.SRIPAS + "node_v"),),
    ),
    "fresh_nodes": Cell(
        "fresh", (t("?l", S + "quantity", "?q"), t("?o", S + "line", "?l")),
        (t("?o", D + "line", "_:n"), t("_:n", D + "amount", "_:m"), t("_:m", D + "number", "?q")),
    ),
    # Division by zero: the delete happens, the insert with the unbound result does not.
    "unbound_insert": Cell(
        "ratio", (t("?l", S + "price", "?p"), t("?l", S + "discount", "?d")), (t("?l", D + "price", "?p"), t("?l", D + "ratio", "?r")),
        functions=(
            FunctionCall("*", (Param(1, var="d"), Param(2, val="0")), "z"),
            FunctionCall("/", (Param(1, var="p"), Param(2, var="z")), "r"),
        ),
    ),
    "delete_and_reinsert": Cell("same", (t("?e", S + "user", "?u"),), (t("?e", S + "user", "?u"), t("?u", D + "did", "?e"))),
}

REPEATED = Cell("loop", (t("?x", S + "pairs", "?x"),), (t("?x", D + "loop", text("true", V.BOOLEAN)),))
DROP_ALL = Cell(
    "drop_all",
    (
        t("?e", S + "observation", "?o"), t("?e", V.RDF_TYPE, "?c"), t("?e", S + "user", "?u"),
        t("?o", S + "value", "?v"), t("?o", S + "k", "?k"),
    ),
)

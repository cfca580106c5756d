"""Numeric behaviour of literals.

Literals keep their lexical form. Arithmetic parses the operands once per numeric family and picks
the family by promotion: integer < decimal < float < double. Every parse and every operation is a
``try_`` variant, so an error is NULL (an unbound variable), never a failed query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quadloom import vocab as V
from quadloom.terms import checked, let, literal

INT, DEC, FLT, DBL = 1, 2, 3, 4
INT_T = "decimal(38,0)"
# Operands of a division, and its results.
DEC_T = "decimal(18,6)"
WIDE_T = "decimal(38,12)"
DECIMAL_FORM = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"


def rank(t: Column) -> Column:
    return (
        F.when(t["kind"] != "lit", F.lit(None).cast("int"))
        .when(t["dt"].isin(*V.INTEGER_TYPES), F.lit(INT))
        .when(t["dt"] == V.DECIMAL, F.lit(DEC))
        .when(t["dt"] == V.FLOAT, F.lit(FLT))
        .when(t["dt"] == V.DOUBLE, F.lit(DBL))
    )


def as_int(t: Column) -> Column:
    """Whole number of an integer literal; NULL when the lexical form is not an integer."""
    return F.when(t["value"].rlike(r"^\s*[+-]?\d+\s*$"), F.trim(t["value"]).try_cast(INT_T))


def as_dec(t: Column) -> Column:
    """Decimal of at most 12 whole and 6 fraction digits; NULL beyond, never rounded."""
    fits = t["value"].rlike(DECIMAL_FORM) & ~t["value"].rlike(r"\.\d{6}\d*[1-9]")
    return F.when(fits, F.trim(t["value"]).try_cast(DEC_T))


def exact(t: Column) -> Column:
    """A decimal literal as a whole number ``n`` and the count ``scale`` of its fraction digits: all
    digits are kept. ``n`` is NULL when there are more than 38."""

    def digits(v: Column) -> Column:
        sign, whole = F.regexp_extract(v, "^[+-]?", 0), F.ltrim(F.substring_index(v, ".", 1), F.lit("+-"))
        frac = F.when(v.contains("."), F.rtrim(F.substring_index(v, ".", -1), F.lit("0"))).otherwise(F.lit(""))
        return let(frac, lambda f: F.struct(F.concat(sign, F.lit("0"), whole, f).try_cast(INT_T).alias("n"), F.length(f).alias("scale")))

    return let(F.when(t["value"].rlike(DECIMAL_FORM), F.regexp_replace(t["value"], r"\s", "")), digits)


def exact_text(d: Column) -> Column:
    """Canonical text of such a number; NULL when ``n`` is."""

    def text(x: Column) -> Column:
        plain = F.abs(x["n"]).cast("string")
        padded = F.concat(F.repeat(F.lit("0"), F.greatest(x["scale"] + 1 - F.length(plain), F.lit(0))), plain)
        sign = F.when(x["n"] < 0, F.lit("-")).otherwise(F.lit(""))
        return let(padded, lambda q: F.concat(
            sign, F.substring(q, F.lit(1), F.length(q) - x["scale"]), F.lit("."),
            F.regexp_replace(F.rtrim(F.substring(q, F.length(q) - x["scale"] + 1, x["scale"]), F.lit("0")), "^$", "0"),
        ))

    return let(d, text)


#: Plain forms, and the digits that such operands have in all at most: then no result is past 38.
PLAIN_DEC = r"^-?[0-9]+(\.[0-9]+)?\z"
PLAIN_INT = r"^-?[0-9]+\z"
PLAIN_DIVIDED = r"^-?[0-9]{1,12}(\.[0-9]{1,6})?\z"
PLAIN_DIGITS = 36


def plain(*args: Column, form: str = PLAIN_DEC) -> Column:
    """Whether all operands are written plainly and short enough for ``plain_number``."""
    short = reduce(lambda a, b: a + b, [F.length(a["value"]) for a in args]) <= PLAIN_DIGITS
    return reduce(lambda a, b: a & b, [short, *[a["value"].rlike(form) for a in args]])


def plain_number(t: Column) -> tuple[Column, Column]:
    """Digits and scale of a plain operand, as ``exact`` gives them. Without lambdas, so that it is compiled
    where it is not inside one; operands are named few times."""
    v = t["value"]
    return F.replace(v, F.lit("."), F.lit("")), F.greatest(F.length(v) - F.length(F.substring_index(v, ".", 1)) - 1, F.lit(0))


def plain_text(n: Column, scale: Column) -> Column:
    """Canonical text of a number of at most 38 digits and scale."""
    padded = F.overlay(F.lpad(F.abs(n).cast("string"), 39, "0"), F.lit("."), F.lit(40) - scale, F.lit(0))
    # "#" marks the ends, where a point gets its digit
    marked = F.concat(F.lit("#"), F.trim(padded, F.lit("0")), F.lit("#"))
    whole = F.replace(F.replace(marked, F.lit("#."), F.lit("0.")), F.lit(".#"), F.lit(".0"))
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), F.trim(whole, F.lit("#")))


def canonical(t: Column) -> Column:
    """Canonical text of a plain operand."""
    digits, scale = plain_number(t)
    return plain_text(digits.try_cast(INT_T), scale)


def plain_result(op: str, args: tuple[Column, ...]) -> Column:
    """Sum, difference or product of plain operands, as text."""
    numbers = [plain_number(a) for a in args]
    if op == "*":
        scale, raised = reduce(lambda a, b: a + b, [s for _, s in numbers]), [d for d, _ in numbers]
    else:
        scale = F.greatest(*[s for _, s in numbers])
        raised = [F.concat(d, F.repeat(F.lit("0"), scale - s)) for d, s in numbers]
    return plain_text(reduce(_TRY[op], [d.try_cast(INT_T) for d in raised]).try_cast(INT_T), scale)


def _exactly(op: str):
    """Sum, difference or product of two exact numbers; past 38 digits ``n`` is NULL."""

    def raised(a: Column, scale: Column) -> Column:
        power = F.concat(F.lit("1"), F.repeat(F.lit("0"), scale - a["scale"])).try_cast(INT_T)
        return F.try_multiply(a["n"], power).try_cast(INT_T)

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        if op == "*":
            return F.struct(F.try_multiply(a["n"], b["n"]).try_cast(INT_T).alias("n"), (a["scale"] + b["scale"]).alias("scale"))
        scale = F.greatest(a["scale"], b["scale"])
        return F.struct(_TRY[op](raised(a, scale), raised(b, scale)).try_cast(INT_T).alias("n"), scale.alias("scale"))

    return lambda a, b: let(F.struct(a.alias("a"), b.alias("b")), of)


def as_dbl(t: Column) -> Column:
    v = F.trim(t["value"])
    number = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    return (
        F.when(v.isin("INF", "+INF"), F.lit(float("inf")))
        .when(v == "-INF", F.lit(float("-inf")))
        .when(v == "NaN", F.lit(float("nan")))
        .when(v.rlike(number), v.try_cast("double"))
    )


def int_text(c: Column) -> Column:
    return c.cast("string")


def dec_text(c: Column) -> Column:
    """Canonical decimal: no trailing zeros, at least one digit after the point."""
    return F.regexp_replace(F.rtrim(c.cast(WIDE_T).cast("string"), F.lit("0")), r"\.$", ".0")


def dbl_text(c: Column) -> Column:
    """Shortest form of a double, always with an exponent."""

    def text(x: Column) -> Column:
        short = F.replace(x.cast("string"), F.lit("E"), F.lit("e"))
        return (
            F.when(F.isnan(x), "NaN")
            .when(x == float("inf"), "INF")
            .when(x == float("-inf"), "-INF")
            .otherwise(F.regexp_replace(short, r"^([^e]+)$", "$1e0"))
        )

    return let(c, text)


def _literal(value: Column, dt: str) -> Column:
    return let(value, lambda v: checked(v, literal(v, dt)))


def number(family: Column, i: Column, d: Column, x: Column) -> Column:
    """Literal of a numeric family; ``d`` is the text of a decimal. Only the branch of the family is
    evaluated. A decimal outside the exact range falls back to the double result."""

    def pick(r: Column) -> Column:
        return (
            F.when(r == INT, _literal(int_text(i), V.INTEGER))
            .when(r == DEC, _literal(F.coalesce(d, dec_text(x.try_cast(WIDE_T))), V.DECIMAL))
            .when(r == FLT, _literal(dbl_text(x), V.FLOAT))
            .when(r == DBL, _literal(dbl_text(x), V.DOUBLE))
        )

    return let(family, pick)


_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}
_IEEE = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def infix(op: str):
    """Left-associative n-ary arithmetic. Whole numbers divide as decimals. Plain exact operands take a short
    way; all others, with their arguments evaluated once, the general one."""

    def build(*args: Column) -> Column:
        if len(args) == 1:
            return F.when(rank(args[0]).isNotNull(), args[0])
        every = lambda test: reduce(lambda a, b: a & b, [test(a) for a in args])
        lit = every(lambda a: a["kind"] == "lit")
        whole = lit & every(lambda a: a["dt"].isin(*V.INTEGER_TYPES))
        exactly = lit & every(lambda a: a["dt"].isin(V.DECIMAL, *V.INTEGER_TYPES))
        once = let(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)]), lambda x: general(*[x[f"a{i}"] for i in range(len(args))]))
        rest = F.when(every(lambda a: rank(a).isNotNull()), once)
        if op == "/":
            if len(args) > 2:
                return rest
            quotient = _divided(*[a["value"].try_cast(DEC_T) for a in args])
            fast = checked(quotient, literal(dec_text(quotient), V.DECIMAL))
            return F.when(exactly & plain(*args, form=PLAIN_DIVIDED), fast).otherwise(rest)
        if len(args) > 9:  # carries
            return rest
        ints = reduce(_TRY[op], [a["value"].try_cast(INT_T) for a in args]).cast("string")
        return (
            F.when(exactly & ~whole & plain(*args), literal(plain_result(op, args), V.DECIMAL))
            .when(whole & plain(*args, form=PLAIN_INT), literal(ints, V.INTEGER))
            .otherwise(rest)
        )

    def general(*args: Column) -> Column:
        ranks = F.array(*[rank(a) for a in args])
        lowest = F.lit(DEC if op == "/" else INT)
        family = let(ranks, lambda r: F.when(~F.exists(r, lambda x: x.isNull()), F.greatest(F.array_max(r), lowest)))
        ints = F.lit(None).cast(INT_T)
        if op != "/":
            ints = reduce(_TRY[op], [as_int(a) for a in args]).try_cast(INT_T)
        doubles = [as_dbl(a) for a in args]
        if op == "/":
            # Division by zero: an error for exact numbers, infinity or NaN for floating point.
            zero = reduce(lambda a, b: a | b, [F.coalesce(as_dbl(a) == 0, F.lit(False)) for a in args[1:]])
            dec = reduce(_divided, [as_dec(a) for a in args])
            quotient = F.coalesce(dec, F.when(~zero, reduce(_ieee_divide, doubles).try_cast(WIDE_T)))
            return number(family, ints, dec_text(quotient), F.when((family > DEC), reduce(_ieee_divide, doubles)))
        return number(family, ints, exact_text(reduce(_exactly(op), [exact(a) for a in args])), reduce(_IEEE[op], doubles))

    return build


def _divided(a: Column, b: Column) -> Column:
    return F.try_divide(a, b).try_cast(WIDE_T)


def _ieee_divide(a: Column, b: Column) -> Column:
    return (
        F.when(b != 0, a / F.nullif(b, F.lit(0.0)))
        .when((a == 0) | F.isnan(a), F.when(a.isNotNull() & b.isNotNull(), F.lit(float("nan"))))
        .when(a > 0, F.lit(float("inf")))
        .when(a < 0, F.lit(float("-inf")))
    )


def rounding(on_int, on_dec, on_dbl):
    """Unary function that keeps the family of its argument; ``on_dec`` takes and gives text."""

    def general(t: Column) -> Column:
        r = rank(t)
        return number(r, on_int(as_int(t)), let(exact_text(exact(t)), on_dec), on_dbl(as_dbl(t)))

    def build(t: Column) -> Column:
        text = on_dec(canonical(t))
        fast = (t["kind"] == "lit") & (t["dt"] == V.DECIMAL) & plain(t)
        return F.when(fast, literal(text, V.DECIMAL)).otherwise(let(t, general))

    return build


def whole_part(text: Column) -> Column:
    """Whole number of a canonical decimal, cut towards zero."""
    return F.substring_index(text, ".", 1).try_cast(INT_T)


def to_whole(kind: str):
    """``floor``, ``ceil`` or ``round`` (halves upwards) of a canonical decimal, as text."""

    def of(text: Column) -> Column:
        frac, below = F.substring_index(text, ".", -1), text.startswith("-")
        step = {
            "floor": F.when(below & (frac != "0"), -1),
            "ceil": F.when(~below & (frac != "0"), 1),
            # fractions without trailing zeros compare as text
            "round": F.when(below & (frac > "5"), -1).when(~below & (frac >= "5"), 1),
        }[kind]
        return F.concat(F.try_add(whole_part(text), F.coalesce(step, F.lit(0))).try_cast(INT_T).cast("string"), F.lit(".0"))

    return of


def parses(t: Column) -> Column:
    """Is the literal a well-formed number of its own datatype?"""
    r = rank(t)
    return F.coalesce(
        F.when(r == INT, as_int(t).isNotNull())
        .when(r == DEC, t["value"].rlike(DECIMAL_FORM))
        .when(r.isNotNull(), as_dbl(t).isNotNull()),
        F.lit(False),
    )

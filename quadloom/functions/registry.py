"""Registry of rule functions: ``name -> (builder, arity)``.

A builder takes term structs and returns a term struct, NULL meaning "error, leave unbound".
Native Column builders keep the work in the JVM; a pandas UDF over term fields fits the same slot.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, functions as F

from quadloom import vocab as V
from quadloom.functions import numbers as N
from quadloom.terms import bnode, checked, iri, let, literal, make_term, same_term


@dataclass(frozen=True)
class Function:
    build: Callable[..., Column]
    low: int
    high: int | None


_FUNCTIONS: dict[str, Function] = {}


#: Namespaces whose functions are the ones known by local name here. Fixed values.
KNOWN_NAMESPACES = (V.SRIPAS, "http://www.w3.org/2005/xpath-functions#", "http://www.w3.org/ns/sparql#")


#: Functions of rule libraries, which have no namespace that is fixed.
ANY_NAMESPACE = ("UNIXEPOCHTOUTC",)


def _key(name: str, given: bool = False) -> str:
    """Lookup key: an IRI stands for itself, unless its namespace is a known one or, while it is looked up
    and not registered, it names a library's function; everything else goes by its local name, whatever
    its case or prefix."""
    full = V.expand(name.strip("<>"))
    if full in ("+", "-", "*", "/"):
        return full
    local = re.split(r"[#/:.]", full)[-1].upper()
    if "://" in full and not full.startswith(KNOWN_NAMESPACES):
        return local if not given and full not in _FUNCTIONS and local in ANY_NAMESPACE else full
    return local


def register_function(name: str, builder: Callable[..., Column], arity: int | tuple[int, int | None]) -> None:
    low, high = (arity, arity) if isinstance(arity, int) else arity
    _FUNCTIONS[_key(name, given=True)] = Function(builder, low, high)


def check(name: str, n_args: int) -> None:
    fn = _FUNCTIONS.get(_key(name))
    if fn is None:
        raise ValueError(f"unknown function: {name}")
    if n_args < fn.low or (fn.high is not None and n_args > fn.high):
        raise ValueError(f"{name} does not take {n_args} arguments")


def pattern_argument(name: str) -> int | None:
    """Which argument of a function is a regular expression."""
    return 1 if _key(name) in ("REGEX", "REPLACE") else None


def check_pattern(pattern: str) -> None:
    """A constant pattern is tried once, on the driver; without a session it is not tried."""
    sc = SparkContext._active_spark_context
    if sc is None:
        return
    try:
        sc._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as exc:
        raise ValueError(f"malformed regular expression: {pattern}") from exc


def safe_pattern(t: Column) -> Column:
    """A pattern that comes from data; NULL when it is malformed."""
    valid = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), t["value"])
    return F.when(t["value"].isNotNull() & valid.isNotNull(), t)


def call(name: str, args: list[Column]) -> Column:
    check(name, len(args))
    return _FUNCTIONS[_key(name)].build(*args)


def names() -> list[str]:
    return sorted(_FUNCTIONS)


def number_token(term):
    """Datatype of an untyped numeric constant in arithmetic; other constants are kept."""
    for dt, form in (
        (V.INTEGER, r"[+-]?\d+"),
        (V.DECIMAL, r"[+-]?\d*\.\d+"),
        (V.DOUBLE, r"[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+"),
    ):
        if re.fullmatch(form, term.value.strip()):
            return type(term)("lit", term.value.strip(), dt)
    return term


# --- helpers ---------------------------------------------------------------------------------


def is_string(t: Column) -> Column:
    return (t["kind"] == "lit") & t["dt"].isin(V.STRING, V.LANG_STRING)


def string(t: Column) -> Column:
    """Text of a string literal, NULL for any other term."""
    return F.when(is_string(t), t["value"])


def plain(value: Column) -> Column:
    return checked(value, literal(value))


def boolean(value: Column) -> Column:
    return checked(value, literal(value.cast("string"), V.BOOLEAN))


def integer(value: Column) -> Column:
    return checked(value, literal(value.cast("string"), V.INTEGER))


def like(t: Column, value: Column) -> Column:
    """String literal with the language of ``t``."""
    return checked(value, make_term("lit", value, t["dt"], t["lang"]))


def truth(t: Column) -> Column:
    """Effective boolean value."""
    num = N.as_dbl(t)
    return (
        F.when((t["kind"] == "lit") & (t["dt"] == V.BOOLEAN), F.coalesce(t["value"].isin("true", "1"), F.lit(False)))
        .when(is_string(t), F.length(t["value"]) > 0)
        .when(N.rank(t).isNotNull(), F.coalesce(N.parses(t) & (num != 0) & ~F.isnan(num), F.lit(False)))
    )


def str_of(t: Column) -> Column:
    return F.when(t["kind"] != "bnode", t["value"])


def datatype_of(t: Column) -> Column:
    return F.when(t["kind"] == "lit", F.when(t["lang"] != "", F.lit(V.LANG_STRING)).otherwise(t["dt"]))


# --- strings ---------------------------------------------------------------------------------


def _concat(*args: Column) -> Column:
    if not args:
        return literal("")
    value = F.concat(*[string(a) for a in args])
    same = F.lit(True)
    for a in args[1:]:
        same = same & (a["lang"] == args[0]["lang"])
    lang = F.when(same, args[0]["lang"]).otherwise(F.lit(""))
    dt = F.when(lang != "", F.lit(V.LANG_STRING)).otherwise(F.lit(V.STRING))
    return checked(value, make_term("lit", value, dt, lang))


def _substr(t: Column, start: Column, length: Column | None = None) -> Column:
    s = string(t)
    first = F.floor(_double(start) + 0.5).cast("bigint")
    if length is None:
        # Positions before the first character only shift the start.
        return like(t, F.when(first.isNotNull(), F.substring(s, _position(first), F.length(s))))
    end = first + F.floor(_double(length) + 0.5).cast("bigint")
    begin = F.greatest(first, F.lit(1))
    size = F.greatest(F.least(end, (F.length(s) + 1).cast("bigint")) - begin, F.lit(0))
    return like(t, F.when(end.isNotNull(), F.substring(s, _position(first), size.cast("int"))))


def _position(first: Column) -> Column:
    return F.least(F.greatest(first, F.lit(1)), F.lit(2**31 - 1)).cast("int")


def _double(t: Column) -> Column:
    return F.when(N.parses(t), N.as_dbl(t))


def _compatible(a: Column, b: Column) -> Column:
    """Argument compatibility of two-string functions: the second has no language or the same."""
    return is_string(a) & is_string(b) & ((b["lang"] == "") | (a["lang"] == b["lang"]))


def _two_strings(build: Callable[[Column, Column], Column]):
    return lambda a, b: boolean(F.when(_compatible(a, b), build(a["value"], b["value"])))


def _str_before(a: Column, b: Column) -> Column:
    at = F.instr(a["value"], b["value"])
    hit = F.when(_compatible(a, b), (at > 0) | (b["value"] == ""))
    cut = F.when(b["value"] == "", F.lit("")).otherwise(F.substring(a["value"], F.lit(1), at - 1))
    return F.when(hit, like(a, cut)).when(~hit, literal(""))


def _str_after(a: Column, b: Column) -> Column:
    at = F.instr(a["value"], b["value"])
    hit = F.when(_compatible(a, b), (at > 0) | (b["value"] == ""))
    cut = F.when(b["value"] == "", a["value"]).otherwise(
        F.substring(a["value"], at + F.length(b["value"]), F.length(a["value"]))
    )
    return F.when(hit, like(a, cut)).when(~hit, literal(""))


def _with_flags(regex: Column, flags: Column | None) -> Column:
    if flags is None:
        return regex
    f = string(flags)
    # The flag "q" takes the pattern as plain text.
    inline = F.regexp_replace(f, "[^imsx]", "")
    quoted = F.when(f.contains("q"), F.concat(F.lit("\\Q"), regex, F.lit("\\E"))).otherwise(regex)
    return F.when(inline == "", quoted).otherwise(F.concat(F.lit("(?"), inline, F.lit(")"), quoted))


def _regex(t: Column, regex: Column, flags: Column | None = None) -> Column:
    return boolean(F.regexp_like(string(t), _with_flags(string(regex), flags)))


def _replace(t: Column, regex: Column, new: Column, flags: Column | None = None) -> Column:
    return like(t, F.regexp_replace(string(t), _with_flags(string(regex), flags), string(new)))


def _encode_for_uri(t: Column) -> Column:
    # Form encoding differs from percent encoding in exactly these three characters.
    form = F.url_encode(string(t))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return plain(form)


# --- dates -----------------------------------------------------------------------------------

# Components come from the lexical form: they are local to its zone.
DATETIME_FORM = r"^(-?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$"


def _part(index: int, dtype: str = "int"):
    def build(t: Column) -> Column:
        ok = (t["kind"] == "lit") & (t["dt"] == V.DATETIME) & t["value"].rlike(DATETIME_FORM)
        return F.when(ok, F.regexp_extract(t["value"], DATETIME_FORM, index)).try_cast(dtype)

    return build


def _seconds(t: Column) -> Column:
    value = F.regexp_replace(_part(6, "string")(t), r"^0(?=\d)", "")
    s = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return checked(value, literal(s, V.DECIMAL))


def _tz(t: Column) -> Column:
    return plain(_part(7, "string")(t))


def _timezone(t: Column) -> Column:
    zone = F.when(_part(7, "string")(t) != "", _part(7, "string")(t))
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.substring(zone, 5, 2).try_cast("int")
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit("-")).otherwise(F.lit(""))
    body = F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")),
    )
    text = F.when((zone == "Z") | (body == ""), F.lit("PT0S")).otherwise(F.concat(sign, F.lit("PT"), body))
    text = F.when(zone.isNotNull(), text)
    return checked(text, literal(text, V.DAY_TIME_DURATION))


def _now() -> Column:
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return literal(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), V.DATETIME)


def _unix_epoch_to_utc(t: Column) -> Column:
    seconds = F.when((t["kind"] == "lit") & t["dt"].isin(*V.INTEGER_TYPES), N.as_int(t).try_cast("bigint"))
    # Years 0001 to 9999; anything else is an error of the function.
    seconds = F.when(seconds.between(-62135596800, 253402300799), seconds)
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return plain(F.date_format(utc, "yyyy:MM:dd HH:mm:ss"))


# --- terms, conditions, casts ----------------------------------------------------------------


def _iri(t: Column) -> Column:
    value = F.when((t["kind"] == "iri") | is_string(t), t["value"])
    return checked(value, iri(value))


def _bnode(label: Column | None = None) -> Column:
    if label is None:
        return bnode(F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    value = string(label)
    return checked(value, bnode(F.concat(F.lit("b"), F.md5(value))))


def _strdt(t: Column, dt: Column) -> Column:
    value = F.when((t["kind"] == "lit") & (t["dt"] == V.STRING), t["value"])
    ok = value.isNotNull() & ((dt["kind"] == "iri") | is_string(dt))
    return F.when(ok, literal(t["value"], dt["value"]))


def _strlang(t: Column, tag: Column) -> Column:
    ok = (t["kind"] == "lit") & (t["dt"] == V.STRING) & is_string(tag)
    return F.when(ok, literal(t["value"], V.LANG_STRING, F.lower(tag["value"])))


def _lang_matches(tag: Column, rng: Column) -> Column:
    a, r = F.lower(string(tag)), F.lower(string(rng))
    return boolean(F.when(r == "*", a != "").otherwise((a == r) | F.startswith(a, F.concat(r, F.lit("-")))))


def _cast_integer(t: Column) -> Column:
    dbl = N.as_dbl(t)
    value = (
        F.when(_bool(t).isNotNull(), _bool(t).cast("int").cast(N.INT_T))
        .when(is_string(t) | (N.rank(t) == N.INT), N.as_int(t))
        .when(N.rank(t) == N.DEC, N.whole_part(N.exact_text(N.exact(t))))
        .when(N.rank(t).isNotNull(), F.when(dbl >= 0, F.floor(dbl)).otherwise(F.ceil(dbl)).try_cast(N.INT_T))
    )
    return integer(value)


def _bool(t: Column) -> Column:
    lex = F.lower(t["value"])
    return F.when(
        (t["kind"] == "lit") & (t["dt"] == V.BOOLEAN),
        F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False),
    )


def _castable(t: Column) -> Column:
    return is_string(t) | N.rank(t).isNotNull()


def _cast_decimal(t: Column) -> Column:
    fast = (t["kind"] == "lit") & (t["dt"] == V.DECIMAL) & N.plain(t)
    return F.when(fast, literal(N.canonical(t), V.DECIMAL)).otherwise(let(t, _cast_any_decimal))


def _cast_any_decimal(t: Column) -> Column:
    number = F.coalesce(N.exact_text(N.exact(t)), F.when(~is_string(t), N.dec_text(N.as_dbl(t).try_cast(N.WIDE_T))))
    text = F.when(_bool(t).isNotNull(), F.concat(_bool(t).cast("int").cast("string"), F.lit(".0"))).when(_castable(t), number)
    return checked(text, literal(text, V.DECIMAL))


def _cast_floating(dt: str):
    def build(t: Column) -> Column:
        value = F.when(_bool(t).isNotNull(), _bool(t).cast("int").cast("double")).when(_castable(t), N.as_dbl(t))
        text = N.dbl_text(value)
        return checked(text, literal(text, dt))

    return build


def _cast_boolean(t: Column) -> Column:
    num = N.as_dbl(t)
    lex = t["value"]
    value = (
        F.when(_bool(t).isNotNull(), _bool(t))
        .when(is_string(t), F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))
        .when(N.parses(t), (num != 0) & ~F.isnan(num))
    )
    return boolean(value)


def _cast_datetime(t: Column) -> Column:
    ok = (t["kind"] == "lit") & t["dt"].isin(V.STRING, V.DATETIME) & t["value"].rlike(DATETIME_FORM)
    return F.when(ok, literal(t["value"], V.DATETIME))


def _whole(fn):
    """Rounding of doubles; beyond 2**52 every double is whole already (and NaN, INF stay)."""
    return lambda x: F.when(F.abs(x) < float(2**52), fn(x).cast("double")).otherwise(x)


def _install() -> None:
    reg = register_function
    for op in ("+", "-", "*", "/"):
        reg(op, N.infix(op), (1, None))

    reg("STR", lambda t: plain(str_of(t)), 1)
    reg("STRDT", _strdt, 2)
    reg("STRLANG", _strlang, 2)
    reg("LANG", lambda t: plain(F.when(t["kind"] == "lit", t["lang"])), 1)
    reg("DATATYPE", lambda t: checked(datatype_of(t), iri(datatype_of(t))), 1)
    reg("LANGMATCHES", _lang_matches, 2)
    reg("unixEpochToUTC", _unix_epoch_to_utc, 1)

    reg("CONCAT", _concat, (0, None))
    reg("STRLEN", lambda t: integer(F.length(string(t))), 1)
    reg("SUBSTR", _substr, (2, 3))
    reg("UCASE", lambda t: like(t, F.upper(string(t))), 1)
    reg("LCASE", lambda t: like(t, F.lower(string(t))), 1)
    reg("STRSTARTS", _two_strings(F.startswith), 2)
    reg("STRENDS", _two_strings(F.endswith), 2)
    reg("CONTAINS", _two_strings(F.contains), 2)
    reg("STRBEFORE", _str_before, 2)
    reg("STRAFTER", _str_after, 2)
    reg("REPLACE", _replace, (3, 4))
    reg("REGEX", _regex, (2, 3))
    reg("ENCODE_FOR_URI", _encode_for_uri, 1)

    reg("ABS", N.rounding(F.abs, lambda d: F.ltrim(d, F.lit("-")), F.abs), 1)
    reg("CEIL", N.rounding(lambda i: i, N.to_whole("ceil"), _whole(F.ceil)), 1)
    reg("FLOOR", N.rounding(lambda i: i, N.to_whole("floor"), _whole(F.floor)), 1)
    reg("ROUND", N.rounding(lambda i: i, N.to_whole("round"), _whole(lambda x: F.floor(x + 0.5))), 1)
    reg("RAND", lambda: literal(N.dbl_text(F.rand()), V.DOUBLE), 0)

    reg("NOW", _now, 0)
    for name, index in (("YEAR", 1), ("MONTH", 2), ("DAY", 3), ("HOURS", 4), ("MINUTES", 5)):
        reg(name, lambda t, i=index: integer(_part(i)(t)), 1)
    reg("SECONDS", _seconds, 1)
    reg("TIMEZONE", _timezone, 1)
    reg("TZ", _tz, 1)

    reg("MD5", lambda t: plain(F.md5(string(t))), 1)
    reg("SHA1", lambda t: plain(F.sha1(string(t))), 1)
    for bits in (256, 384, 512):
        reg(f"SHA{bits}", lambda t, b=bits: plain(F.sha2(string(t), b)), 1)

    reg("IRI", _iri, 1)
    reg("URI", _iri, 1)
    reg("BNODE", _bnode, (0, 1))
    reg("ISIRI", lambda t: boolean(t["kind"] == "iri"), 1)
    reg("ISURI", lambda t: boolean(t["kind"] == "iri"), 1)
    reg("ISBLANK", lambda t: boolean(t["kind"] == "bnode"), 1)
    reg("ISLITERAL", lambda t: boolean(t["kind"] == "lit"), 1)
    reg("ISNUMERIC", lambda t: boolean(F.when(t["kind"].isNotNull(), N.parses(t))), 1)
    reg("SAMETERM", lambda a, b: boolean(same_term(a, b)), 2)
    reg("UUID", lambda: iri(F.concat(F.lit("urn:uuid:"), F.uuid())), 0)
    reg("STRUUID", lambda: literal(F.uuid()), 0)

    reg("IF", lambda c, a, b: F.when(truth(c), a).when(~truth(c), b), 3)
    reg("COALESCE", lambda *a: F.coalesce(*a), (1, None))
    reg("BOUND", lambda t: boolean(t.isNotNull()), 1)

    reg("xsd:string", lambda t: plain(str_of(t)), 1)
    reg("xsd:integer", _cast_integer, 1)
    reg("xsd:decimal", _cast_decimal, 1)
    reg("xsd:float", _cast_floating(V.FLOAT), 1)
    reg("xsd:double", _cast_floating(V.DOUBLE), 1)
    reg("xsd:boolean", _cast_boolean, 1)
    reg("xsd:dateTime", _cast_datetime, 1)


_install()

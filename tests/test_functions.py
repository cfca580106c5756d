"""Functions of rules on single values."""

import pytest

from quadloom import vocab as V
from quadloom.functions import registry as FN
from quadloom.terms import TERM_DDL
from pyspark.sql import functions as F
from tests.helpers import term

S, I, D, DBL, B, DT = V.STRING, V.INTEGER, V.DECIMAL, V.DOUBLE, V.BOOLEAN, V.DATETIME
CASES = [
    ("+", [1, 2], 3), ("/", [1, 3], ("0.333333333333", D)), ("/", [1, 0], None), ("*", [("1.5", D), 2], ("3.0", D)),
    ("+", [("1", DBL), 1], ("2.0e0", DBL)), ("/", [("1", DBL), 0], ("INF", DBL)), ("-", [("1.5", D), ("1.5", D)], ("0.0", D)),
    ("+", [("1.5", I), 1], None), ("*", [("900000000000000", D), 2], ("1800000000000000.0", D)), ("+", [("1", V.XSD + "byte"), 1], 2),
    ("*", [("0.0000001", D), 1000000], ("0.1", D)), ("+", [("0.12345678", D), 0], ("0.12345678", D)),
    ("+", [("99999999999999999999.5", D), 1], ("100000000000000000000.5", D)), ("-", [(".0", D), ("0.00000000000000000001", D)], ("-0.00000000000000000001", D)),
    ("*", [("1.0000001", D), ("1.0000001", D), ("-2", D)], ("-2.00000040000002", D)), ("/", [("0.12345678", D), 1], ("0.12345678", D)),
    ("ABS", [("-0.1234567890123456", D)], ("0.1234567890123456", D)), ("FLOOR", [("-0.00000000000000001", D)], ("-1.0", D)), ("CEIL", [("-0.5", D)], ("0.0", D)),
    ("ROUND", [("-2.5", D)], ("-2.0", D)), ("ROUND", [("-2.51", D)], ("-3.0", D)), ("ROUND", [("0.49999999999999999", D)], ("0.0", D)),
    ("xsd:integer", [("0.9999999999999", D)], 0), ("xsd:decimal", [("1.12345678901234", S)], ("1.12345678901234", D)),
    ("SECONDS", [("2020-02-03T04:05:06.123456789Z", DT)], ("6.123456789", D)), ("SECONDS", [("2020-02-03T04:05:00Z", DT)], ("0", D)),
    ("CONCAT", [("a", S), ("b", S)], ("ab", S)), ("CONCAT", [("a", V.LANG_STRING, "en"), ("b", V.LANG_STRING, "en")], ("ab", V.LANG_STRING, "en")),
    ("STRLEN", [("añb", S)], 3), ("STRLEN", [5], None), ("SUBSTR", [("hello", S), 2, 3], ("ell", S)), ("SUBSTR", [("hello", S), 0, 3], ("he", S)),
    ("SUBSTR", [("hello", S), 4], ("lo", S)), ("UCASE", [("a", V.LANG_STRING, "en")], ("A", V.LANG_STRING, "en")),
    ("STRBEFORE", [("abc", S), ("b", S)], ("a", S)), ("STRBEFORE", [("abc", S), ("z", S)], ("", S)), ("STRAFTER", [("abc", S), ("", S)], ("abc", S)),
    ("STRSTARTS", [("abc", V.LANG_STRING, "en"), ("a", V.LANG_STRING, "fr")], None), ("CONTAINS", [("abc", S), ("b", S)], True),
    ("REPLACE", [("aXbx", S), ("x", S), ("-", S), ("i", S)], ("a-b-", S)), ("REGEX", [("Abc", S), ("^a", S)], False),
    ("ENCODE_FOR_URI", [("a b*~/é", S)], ("a%20b%2A~%2F%C3%A9", S)),
    ("ABS", [-3], 3), ("CEIL", [("1.2", D)], ("2.0", D)), ("FLOOR", [("-1.2", DBL)], ("-2.0e0", DBL)), ("ROUND", [("2.5", D)], ("3.0", D)),
    ("YEAR", [("2020-02-03T04:05:06.500Z", DT)], 2020), ("SECONDS", [("2020-02-03T04:05:06.500Z", DT)], ("6.5", D)),
    ("TZ", [("2020-02-03T04:05:06-08:00", DT)], ("-08:00", S)), ("TIMEZONE", [("2020-02-03T04:05:06-08:00", DT)], ("-PT8H", V.DAY_TIME_DURATION)),
    ("TIMEZONE", [("2020-02-03T04:05:06", DT)], None), ("HOURS", [("4 o'clock", DT)], None),
    ("unixEpochToUTC", [0], ("1970:01:01 00:00:00", S)), ("unixEpochToUTC", [("x", I)], None), ("unixEpochToUTC", [("5", S)], None),
    ("http://f/lib#unixEpochToUTC", [86399], ("1970:01:01 23:59:59", S)),
    ("STR", ["http://x/a"], ("http://x/a", S)), ("STR", ["_:b"], None), ("DATATYPE", [("a", V.LANG_STRING, "en")], V.LANG_STRING), ("DATATYPE", ["http://x/a"], None),
    ("IRI", [("http://x/a", S)], "http://x/a"), ("STRDT", [("5", S), I], 5), ("STRLANG", [("a", S), ("EN", S)], ("a", V.LANG_STRING, "en")),
    ("LANGMATCHES", [("en-gb", S), ("en", S)], True), ("LANGMATCHES", [("", S), ("*", S)], False), ("ISNUMERIC", [("x", I)], False), ("SAMETERM", [1, ("1", S)], False),
    ("IF", [True, 1, 2], 1), ("IF", [("", S), 1, 2], 2), ("IF", ["http://x/a", 1, 2], None), ("COALESCE", [None, 2], 2), ("BOUND", [None], False),
    ("xsd:integer", [("-1.9", D)], -1), ("xsd:integer", [("abc", S)], None), ("xsd:decimal", [True], ("1.0", D)), ("xsd:double", [("1e2", S)], ("100.0e0", DBL)),
    ("xsd:boolean", [("0", S)], False), ("xsd:string", [5], ("5", S)), ("xsd:dateTime", [("x", S)], None),
    ("MD5", [("abc", S)], ("900150983cd24fb0d6963f7d28e17f72", S)), ("SHA1", [("abc", S)], ("a9993e364706816aba3e25717850c26c9cd0d89d", S)),
]


def test_functions(spark):
    """All cases in one job."""
    cols, want = [], []
    for i, (name, args, result) in enumerate(CASES):
        terms = []
        for a in args:
            values = term(a) if a is not None else None
            fields = [F.lit(v).alias(n) for n, v in zip(("kind", "value", "dt", "lang"), values)] if values else None
            terms.append(F.struct(*fields) if fields else F.lit(None).cast(TERM_DDL))
        cols.append(FN.call(name, terms).alias(f"c{i}"))
        want.append(None if result is None else term(result))
    row = spark.range(1).select(*cols).first()
    got = [None if v is None else tuple(v) for v in row]
    assert [(CASES[i][:2], g) for i, g in enumerate(got)] == [(CASES[i][:2], w) for i, w in enumerate(want)]


def test_registered_function_and_arity(spark):
    FN.register_function("twice", lambda x: FN.call("*", [x, FN.call("xsd:integer", [FN.literal("2")])]), 1)
    out = spark.range(1).select(FN.call("my:twice", [FN.literal("4", I)]).alias("r")).first()["r"]
    assert out["value"] == "8"
    with pytest.raises(ValueError):
        FN.check("twice", 2)
    with pytest.raises(ValueError):
        FN.check("unknown", 1)


def test_functions_of_two_namespaces(spark):
    one, two = "http://a.example/f#concat", "http://b.example/f#concat"
    with pytest.raises(ValueError, match="unknown function"):
        FN.check(one, 2)  # not the CONCAT of this library
    FN.register_function(one, lambda x: FN.call("UCASE", [x]), 1)
    FN.register_function(f"<{two}>", lambda x: FN.call("LCASE", [x]), 1)
    calls = [(one, ["aB"]), (two, ["aB"]), ("concat", ["a", "B"]), ("http://www.w3.org/2005/xpath-functions#concat", ["a", "B"])]
    row = spark.range(1).select(*[FN.call(n, [FN.literal(x) for x in args])["value"].alias(f"c{i}") for i, (n, args) in enumerate(calls)]).first()
    assert list(row) == ["AB", "ab", "aB", "aB"]


def test_random_and_time_functions_make_terms(spark):
    row = spark.range(1).select(*[FN.call(n, []).alias(n) for n in ("RAND", "NOW", "UUID", "STRUUID", "BNODE")]).first()
    assert row["RAND"]["dt"] == DBL and row["NOW"]["dt"] == DT and row["UUID"]["value"].startswith("urn:uuid:") and row["BNODE"]["kind"] == "bnode"


def test_malformed_patterns_do_not_fail_the_query(spark):
    with pytest.raises(ValueError):
        FN.check_pattern("(")
    FN.check_pattern("(a)")
    rows = spark.createDataFrame([(1, "a"), (2, "("), (3, None)], "k int, p string").select(
        "k", FN.call("REGEX", [FN.literal("abc"), FN.safe_pattern(FN.literal(F.col("p")))])["value"].alias("r"))
    assert dict(map(tuple, rows.collect())) == {1: "true", 2: None, 3: None}


def test_plain_numbers_give_what_the_general_way_gives(spark):
    """Operands from data, written plainly (one short way) and otherwise, against exact numbers."""
    from decimal import Decimal, localcontext

    plain = ["0", "-0", "7", "-7", "007", "0.5", "-0.05", "10.10", "0.00000001", "123456789012.123456", "99999999999999999999.5"]
    odd = [" 7", "+7", ".5", "5.", "1.0\n", "0" * 40 + "1.5", "x", "1.2.3", "", "--1", ".", "1.5x"]
    good = {v: Decimal(v.strip()) for v in plain + odd[:6]}
    rows = [(a, b, t, u) for a in plain + odd for b in ["3", "-0.25", "+1.5", "y"] for t in (I, D) for u in (I, D)]
    df = spark.createDataFrame(rows, "a string, b string, t string, u string")
    a, b = FN.literal(F.col("a"), F.col("t")), FN.literal(F.col("b"), F.col("u"))
    calls = {"+": [a, b], "-": [a, b], "*": [a, b], "ABS": [a], "xsd:decimal": [a]}
    got = df.select("*", *[FN.call(n, x).alias(n) for n, x in calls.items()]).collect()

    def text(x, dt):
        whole = x == x.to_integral_value()
        return (str(int(x)) if dt == I else f"{int(x)}.0" if whole else f"{x:f}".rstrip("0"), dt)

    assert len(got) == len(rows)
    with localcontext(prec=100):
        for r in got:
            x, y = good.get(r["a"]), {"3": Decimal(3), "-0.25": Decimal("-0.25"), "+1.5": Decimal("1.5")}.get(r["b"])
            both = I if r["t"] == r["u"] == I else D
            whole = both == D or not any("." in v for v in (r["a"], r["b"]))
            for n in ("+", "-", "*"):
                want = None if x is None or y is None or not whole else text({"+": x + y, "-": x - y, "*": x * y}[n], both)
                assert (r[n] and (r[n]["value"], r[n]["dt"])) == want, (n, r)
            mine = x is not None and (r["t"] == D or "." not in r["a"])
            assert (r["ABS"] and (r["ABS"]["value"], r["ABS"]["dt"])) == (text(abs(x), r["t"]) if mine else None), r
            if r["t"] == D:
                assert (r["xsd:decimal"] and r["xsd:decimal"]["value"]) == (text(x, D)[0] if x is not None else None), r


def test_lines_are_shuffled_once_before_they_are_computed(spark, tmp_path):
    import datetime

    from __spark_entry__ import queries

    day = datetime.datetime(1996, 9, 13)
    row = (1, 2, 3, 4, 17.0, 84197.04, 0.01, 0.02, "N", "O", day)
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([row, row, (2, *row[1:])], ddl).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("functions_arithmetic", "functions_exact_decimals"):
        out = queries()[name](spark, str(tmp_path))
        assert out.count() == 2
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

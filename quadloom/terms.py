"""The graph data model as Spark types: terms, triples, quads and nested messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quadloom import vocab as V

TERM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "dt", "lang")])
TRIPLE = T.StructType(
    [T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM)]
)
META = T.StructType([T.StructField("g", T.StringType()), *TRIPLE.fields])
TERM_DDL = "struct<kind:string,value:string,dt:string,lang:string>"
TRIPLE_DDL = f"struct<s:{TERM_DDL},p:string,o:{TERM_DDL}>"
META_DDL = f"struct<g:string,s:{TERM_DDL},p:string,o:{TERM_DDL}>"
QUAD_COLS = ("msg_id", "g", "s", "p", "o")


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def make_term(kind: str, value: Column | str, dt: Column | str = "", lang: Column | str = "") -> Column:
    """Term struct; absent parts are empty strings so that flattened terms still join."""
    return F.struct(
        F.lit(kind).alias("kind"),
        _text(value).alias("value"),
        _text(dt).alias("dt"),
        _text(lang).alias("lang"),
    )


def iri(value: Column | str) -> Column:
    return make_term("iri", value)


def bnode(label: Column | str) -> Column:
    return make_term("bnode", label)


def literal(value: Column | str, dt: Column | str = V.STRING, lang: Column | str = "") -> Column:
    return make_term("lit", value, dt, lang)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``: keeps nested expressions linear in size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checked(value: Column, term: Column) -> Column:
    """``term`` where ``value`` is known, NULL (an unbound variable) elsewhere."""
    return F.when(value.isNotNull(), term)


def triple(s: Column, p: Column | str, o: Column) -> Column:
    return F.struct(s.alias("s"), _text(p).alias("p"), o.alias("o"))


def same_term(a: Column, b: Column) -> Column:
    """Field-wise term equality: compares the most selective field first, inside lambdas too."""
    return (
        (a["value"] == b["value"])
        & (a["kind"] == b["kind"])
        & (a["dt"] == b["dt"])
        & (a["lang"] == b["lang"])
    )


def same_triple(a: Column, b: Column) -> Column:
    """Field-wise equality of triples, most selective fields first; absent fields equal each other."""
    fields = [("o", "value"), ("s", "value"), ("p",), *[(c, f) for c in ("o", "s") for f in ("kind", "dt", "lang")]]
    cond = F.lit(True)
    for slot, *rest in fields:
        x, y = a[slot], b[slot]
        for f in rest:
            x, y = x[f], y[f]
        cond = cond & x.eqNullSafe(y)
    return cond & (a["s"].isNull() == b["s"].isNull()) & (a["o"].isNull() == b["o"].isNull())


def _distinct(rows: Column, key) -> Column:
    """Each row once, in order. Equal rows have equal hashes of their values ``key``, so where all of these differ
    nothing is compared: Spark compares nested structs by an ordering that it builds again for each pair."""

    def distinct(all_: Column) -> Column:
        hashes = F.array_distinct(F.transform(all_, lambda t: F.xxhash64(*key(t))))
        return F.when(F.size(hashes) == F.size(all_), all_).otherwise(F.array_distinct(all_))

    return let(rows, distinct)


def distinct_triples(triples: Column) -> Column:
    return _distinct(triples, lambda t: (t["p"], t["s"]["value"], t["o"]["value"]))


def distinct_quads(quads: Column) -> Column:
    return _distinct(quads, lambda t: (t["p"], t["s"]["value"], t["o"]["value"], t["g"]))


def except_triples(triples: Column, others: Column) -> Column:
    """Distinct triples that are not among ``others``, in order: ``array_except``, comparing fields."""
    sides = F.struct(distinct_triples(triples).alias("a"), others.alias("b"))
    return let(sides, lambda x: F.filter(x["a"], lambda t: ~F.exists(x["b"], lambda u: same_triple(t, u))))


def flatten_terms(df: DataFrame, *columns: str) -> DataFrame:
    """Replace each term column ``c`` by ``c_kind, c_value, c_dt, c_lang``."""
    out = []
    for c in df.columns:
        if c in columns:
            out += [F.col(c)[f].alias(f"{c}_{f}") for f in ("kind", "value", "dt", "lang")]
        else:
            out.append(F.col(c))
    return df.select(*out)


def barrier(df: DataFrame, *columns: str) -> DataFrame:
    """Keep later filters on ``columns`` above the expressions that compute them.

    Pushed below a chain of row-local steps, a filter would repeat the whole chain once per use.
    A generator of exactly one row stops that and costs next to nothing."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*columns)))).select(*df.columns)


def to_long(msgs: DataFrame, *keep: str) -> DataFrame:
    """Nested messages to quads, with the columns ``keep`` repeated, in one pass over the rows. ``inline_outer`` keeps the plan linear in
    the number of steps: plain ``inline`` makes the optimizer copy every step into a size filter."""
    mine = F.transform(
        "triples",
        lambda t: F.struct(F.col("payload_g").alias("g"), t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o")),
    )
    quads = F.concat(mine, F.col("meta"))
    return msgs.select("msg_id", *keep, F.inline_outer(quads)).where(F.col("s").isNotNull())


def empty_meta() -> Column:
    return F.array().cast(T.ArrayType(META))

"""Messages: JSON-LD in and out, payloads, size routing."""

import pytest
from pyspark.sql import functions as F

from quadloom import vocab as V
from quadloom.operators import jsonld as J, payload as P, translate as TR
from quadloom.plans.lineage import no_cut
from quadloom.plans.rules import Cell, pattern as t
from quadloom.terms import to_long
from tests.helpers import X, as_set, expected, frames, nested_set, one_cell

XD = V.XSD + "double"
CTX = '{"@context":{"x":"http://x/","lab":{"@id":"x:label"},"ref":{"@id":"x:ref","@type":"@id"},"day":{"@id":"x:day","@type":"x:date"}},'


def quads(spark, *docs, depth=6):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "msg_id string, raw string")
    return {
        (r["msg_id"], r["g"], tuple(r["s"]), r["p"], tuple(r["o"])) for r in J.jsonld_to_quads(df, max_depth=depth).collect()
    }


def graph(*triples, m="0", g=""):
    return {(m, g, s, p, o) for _, s, p, o in expected({m: list(triples)})}


@pytest.mark.parametrize(
    "doc, want",
    [
        (CTX + '"@id":"x:a","lab":"A","ref":"x:b","day":"2020"}', [("a", "label", ("A", V.STRING)), ("a", "ref", "b"), ("a", "day", ("2020", X + "date"))]),
        (CTX + '"@id":"x:a","@type":["x:T","x:U"]}', [("a", V.RDF_TYPE, "T"), ("a", V.RDF_TYPE, "U")]),
        (CTX + '"@id":"x:a","x:n":[1,2.5,2.0,1e3,true,"s",null]}', [("a", "n", 1), ("a", "n", ("2.5E0", XD)), ("a", "n", 2), ("a", "n", 1000), ("a", "n", True), ("a", "n", ("s", V.STRING))]),
        (CTX + '"@id":"x:a","x:v":{"@value":"5","@type":"x:dt"},"x:l":{"@value":"hi","@language":"EN"}}', [("a", "v", ("5", X + "dt")), ("a", "l", ("hi", V.LANG_STRING, "en"))]),
        (CTX + '"@id":"x:a","x:in":{"@id":"_:q","x:v":[{"@set":["u","w"]}]}}', [("a", "in", "_:q"), ("_:q", "v", ("u", V.STRING)), ("_:q", "v", ("w", V.STRING))]),
        ('{"@context":{"@vocab":"http://x/","@language":"de"},"@id":"http://x/a","p":"q"}', [("a", "p", ("q", V.LANG_STRING, "de"))]),
        ('[{"@id":"http://x/a","http://x/p":"q"},{"@id":"http://x/b","unknown":"dropped"}]', [("a", "p", ("q", V.STRING))]),
        (CTX + '"@graph":[{"@id":"x:a","x:p":{"@id":"x:b"}},{"@context":{"y":"http://x/sub/"},"@id":"y:c","y:p":1}]}', [("a", "p", "b"), ("http://x/sub/c", "http://x/sub/p", 1)]),
        (CTX + '"@id":"x:a","x:n":[1,[2,"[[3]]"],[]]}', [("a", "n", 1), ("a", "n", 2), ("a", "n", ("[[3]]", V.STRING))]),
        ("{}", []),
    ],
)
def test_read(spark, doc, want):
    assert quads(spark, doc) == graph(*want)


def test_named_graph_and_message_prefix(spark):
    doc = CTX + '"@graph":[{"@id":"x:m","x:p":1},{"@id":"InterIoTMsg:payload","@graph":[{"@id":"x:a","x:q":2}]}]}'
    assert quads(spark, doc) == graph(("m", "p", 1)) | graph(("a", "q", 2), g=V.PAYLOAD_GRAPH)


def test_context_patch(spark):
    docs = ['{"@context":{"x":"http://x/"},"@id":"x:a"}', '{"@context":"http://remote","o":{"k":"v"}}', '{"@context":{"InterIoTMsg":"u"}}']
    df = spark.createDataFrame([(d,) for d in docs], "raw string")
    got = [r[0] for r in df.select(J.patch_context(F.col("raw"))).collect()]
    assert got[0].startswith('{"@context":{"InterIoTMsg":"http://inter-iot.eu/message/","x"')
    assert got[1:] == docs[1:]


def test_bad_messages_are_kept_with_their_reason(spark):
    deep = CTX + '"@id":"x:a","x:p":{"x:p":{"x:p":{"x:p":1}}}}'
    docs = ["no json", "5", '{"http://p":{"@list":[1]}}', '{"@context":"http://remote"}', deep, CTX + '"@id":"x:a","x:p":1}', '{"http://x/p":{"http://x/q":[1,[ [2]]]}}']
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "msg_id string, raw string")
    good, bad = J.read_messages(df, max_depth=3)
    assert [r["msg_id"] for r in good.collect()] == ["5"]
    reasons = {r["msg_id"]: (r["bad"], r["raw"]) for r in bad.collect()}
    assert [reasons[i][0] for i in "012346"] == [J.BAD_JSON, J.BAD_JSON, J.BAD_KEYWORD, J.BAD_CONTEXT, J.BAD_DEPTH, J.BAD_ARRAY]
    assert reasons["4"][1] == deep
    with pytest.raises(Exception, match="bad message [0-46]: "):
        J.read_messages(df, max_depth=3, on_bad_message="fail")[0].collect()


def test_write_then_read_is_the_same_graph(spark):
    _, nest = frames(spark, {"0": [("a", "p", "_:b"), ("_:b", "q", ('x"y\\', V.STRING)), ("_:b", "q", ("h", V.LANG_STRING, "en")), ("a", V.RDF_TYPE, "T")], "1": []})
    docs = J.write_messages(nest)
    before = as_set(to_long(nest))
    assert as_set(J.jsonld_to_quads(docs)) == before
    assert '"@type":["' not in docs.first()["raw"]


def test_payload_is_named_graph_or_default(spark):
    long, _ = frames(spark, {"1": [("a", "p", 1)], "2": [("b", "p", 2)]})
    q = long.withColumn("g", F.when(F.col("msg_id") == "1", V.PAYLOAD_GRAPH).otherwise(F.lit("")))
    meta = long.where("msg_id = '1'").withColumn("g", F.lit("")).withColumn("p", F.lit(X + "meta"))
    q = q.unionByName(meta)
    assert {(m, p) for m, _, p, _ in as_set(P.payload(q))} == {("1", X + "p"), ("2", X + "p")}
    back = P.with_payload(q, P.payload(q).drop("g").withColumn("p", F.lit(X + "new")))
    assert {(r["msg_id"], r["g"], r["p"]) for r in back.collect()} == {
        ("1", "", X + "meta"), ("1", V.PAYLOAD_GRAPH, X + "new"), ("2", "", X + "new")
    }


def test_size_limit(spark):
    df = spark.createDataFrame([("a", "x" * 1024), ("b", "é" * 513)], "msg_id string, raw string")
    fits, rejected = J.limit_message_size(df, kb=1)
    assert [r[0] for r in fits.collect()] == ["a"] and [r[0] for r in rejected.collect()] == ["b"]


def test_large_and_small_messages_give_the_same(spark):
    cell = Cell("c", (t("?s", X + "p", "?o"), t("?o", X + "q", "?v")), (t("?s", X + "r", "_:n"), t("_:n", X + "v", "?v")))
    graphs = {str(m): [(f"s{i}", "p", f"o{i}") for i in range(m)] + [(f"o{i}", "q", i) for i in range(m)] for m in range(7)}
    long, nest = frames(spark, graphs)
    program = one_cell(cell)
    small = nested_set(TR.translate(nest, program, limit=10**6))
    assert small == nested_set(TR.translate(nest, program, limit=5, cut=no_cut)) == nested_set(TR.translate(nest, program, limit=0, cut=no_cut))
    q = long.withColumn("g", F.lit(""))
    assert as_set(TR.translate_mixed(q, program, limit=5, cut=no_cut)) == small == as_set(TR.translate_quads(q, program, cut=no_cut))
    assert TR.translate(nest, program, limit=0, cut=no_cut).count() == 7

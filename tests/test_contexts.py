"""JSON-LD contexts: terms for keywords, bases, containers, languages, and keywords that are only text."""

import itertools
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quadloom import vocab as V
from quadloom.operators import jsonld as J
from tests.test_messages import CTX, graph, quads

DE, EN = (("x", V.LANG_STRING, "de"), ("y", V.LANG_STRING, "en"))
ALIASES = '{"@context":{"x":"http://x/","id":"@id","kind":"@type","val":"@value","lang":{"@id":"@language"},"all":"@set","g":"@graph"},'


@pytest.mark.parametrize(
    "doc, want",
    [
        (ALIASES + '"id":"x:a","kind":"x:T","x:p":{"val":"x","lang":"DE"},"x:q":{"val":"1","kind":"x:dt"},"x:r":{"all":[1,2]},"x:s":{"id":"x:b"}}',
         [("a", V.RDF_TYPE, "T"), ("a", "p", DE), ("a", "q", ("1", "http://x/dt")), ("a", "r", 1), ("a", "r", 2), ("a", "s", "b")]),
        (ALIASES + '"g":[{"id":"x:a","x:p":1}]}', [("a", "p", 1)]),
        (ALIASES + '"id":"x:other","@id":"x:a","x:p":1}', [("a", "p", 1)]),
        (CTX + '"@id":"x:a","x:p":"@id","x:q":["@type","@list","@base"],"x:r":"\\"@container\\":"}',
         [("a", "p", ("@id", V.STRING)), *(("a", "q", (k, V.STRING)) for k in ("@type", "@list", "@base")), ("a", "r", ('"@container":', V.STRING))]),
        ('{"@context":{"@base":"http://x/d/e","p":{"@id":"http://x/p","@type":"@id"}},"@id":"a","p":["../b","#c","","/d/./e","_:q","urn:u"]}',
         [("http://x/d/a", "p", o) for o in ("http://x/b", "http://x/d/e#c", "http://x/d/e", "http://x/d/e", "_:q", "urn:u")]),
        ('{"@context":{"x":"http://x/","p":{"@id":"x:p","@container":"@language"}},"@id":"x:a","p":{"DE":"x","en":["y"],"@none":"z"}}',
         [("a", "p", DE), ("a", "p", EN), ("a", "p", ("z", V.STRING))]),
        ('{"@context":{"x":"http://x/","p":{"@id":"x:p","@container":["@set","@index"]},"q":{"@id":"x:q","@container":"@set"}},"@id":"x:a","p":{"k":{"@id":"x:b"},"l":[1,2]},"q":3}',
         [("a", "p", "b"), ("a", "p", 1), ("a", "p", 2), ("a", "q", 3)]),
        ('{"@context":{"x":"http://x/","@language":"en","p":{"@id":"x:p","@language":"de"},"q":{"@id":"x:q","@language":null}},"@id":"x:a","p":"x","q":"n","x:r":"y"}',
         [("a", "p", DE), ("a", "q", ("n", V.STRING)), ("a", "r", EN)]),
        ('{"@context":[{"x":"http://x/","id":"@id"},{"p":"x:p"}],"id":"x:a","p":{"@context":{"name":"@id"},"name":"x:b","p":1}}', [("a", "p", "b"), ("b", "p", 1)]),
    ],
)
def test_contexts(spark, doc, want):
    assert quads(spark, doc) == graph(*want)


def test_keywords_that_are_not_read_are_named_by_key(spark):
    docs = {
        J.BAD_KEYWORD: ['{"http://p":{"@list":[1]}}', '{"@context":{"p":{"@id":"http://p","@container":"@list"}},"p":1}', '{"@context":{"p":{"@reverse":"http://p"}}}',
                        '{"http://p":{"@value":{"a":1},"@type":"@json"}}', '{"@context":{"p":{"@id":"http://p","@type":"@json"}}}', '{"http://p":{"http://q":{"@included":[]}}}', '{"@context":{"@import":"u"}}'],
        J.BAD_CONTEXT: ['{"@context":"http://remote"}', '{"@context":[{"x":"http://x/"},"http://remote"]}', '{"http://p":{"@context":"u","@id":"http://a"}}', '{"@context":null}'],
    }
    rows = [(f"{why}{i}", d) for why, ds in docs.items() for i, d in enumerate(ds)]
    _, bad = J.read_messages(spark.createDataFrame(rows, "msg_id string, raw string"))
    assert {r["msg_id"]: r["bad"] for r in bad.collect()} == {m: m[:-1] for m, _ in rows}


def test_references_against_a_base(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/", "urn:x:y", "http://a/b/../c?x/y#z"]
    names = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "/./g", "/../g", "g/./h", "g/../h", "g?y/../x"]
    rows = [(b, n) for b, n in itertools.product(bases, names) if not b.startswith("urn") or n.startswith(("#", "//"))]
    df = spark.createDataFrame(rows, "b string, n string").withColumn("got", J._against(F.col("b"), F.col("n")))
    for r in df.collect():
        want = urljoin(r["b"], r["n"]) if r["n"] else r["b"].split("#")[0]
        if r["b"].startswith("urn"):
            want = r["b"] + r["n"] if r["n"].startswith("#") else "urn:" + r["n"]
        assert r["got"] == want, (r["b"], r["n"])


def test_definitions_and_graphs_are_evaluated_once(spark):
    def uses(column):
        return str(column._jc).count("marked")

    assert uses(J._merge(F.col("old"), F.col("marked"))) == 1
    assert uses(J._nodes_json(F.col("marked"))) == 1
    assert uses(J.message_to_jsonld(F.col("g"), F.col("t"), F.col("marked"))) == 1

"""Registry and rule corpora derived from the given tables, so that their checks grow with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadloom import vocab as V
from quadloom.lift import SRC, epoch_seconds, money, read, spread
from quadloom.sources.rule_tables import TABLES

D = "http://example.org/dst#"
EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON-LD text on one topic per event type."""
    ev = spread(read(spark, sf_dir, "events"))
    k = F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1)
    k_json = F.when(k.try_cast("int") % 2 == 0, k).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    raw = F.concat(
        F.lit('{"@context":{"src":"' + SRC + '","value":{"@id":"src:value","@type":"' + V.DECIMAL + '"}},"@graph":['),
        F.lit('{"@id":"src:event/'), _text("event_id"), F.lit('","src:epoch":'), epoch_seconds(F.col("ts")).cast("string"),
        F.lit('},{"@id":"InterIoTMsg:payload","@graph":[{"@id":"src:event/'), _text("event_id"),
        F.lit('","@type":"src:'), F.col("event_type"), F.lit('","src:user":{"@id":"src:user/'), _text("user_id"),
        F.lit('"},"src:observation":{"@id":"_:o","value":"'), money(F.col("value")), F.lit('","src:k":'), k_json,
        F.lit("}}]}]}"),
    )
    return ev.select(
        _text("event_id").alias("msg_id"), F.col("event_type").alias("topic"),
        (F.col("event_id") % 4).cast("int").alias("src_partition"), F.col("event_id").alias("src_offset"),
        F.col("ts").alias("ingest_ts"), raw.alias("raw"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel per nation, over the event topics and the rule sets of the catalog."""
    n = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    topic = F.element_at(F.array(*[F.lit(x) for x in EVENT_TYPES]), (key % 5 + 1).cast("int"))
    has_inp, has_out = key % 3 != 0, key % 2 == 0
    return n.select(
        (key + 1).cast("int").alias("id"), F.lit("KK").alias("chan_type"), topic.alias("source"),
        F.when(has_inp, "readings").otherwise(F.lit("")).alias("inp_name"), F.when(has_inp, "1").otherwise(F.lit("")).alias("inp_version"),
        F.when(has_out, "labels").otherwise(F.lit("")).alias("out_name"), F.when(has_out, "2").otherwise(F.lit("")).alias("out_version"),
        F.concat(F.lit("out/"), "n_name").alias("sink"), F.lit("g").alias("consumer_group"), F.lit(1).alias("parallelism"),
        F.md5("n_name").alias("uuid"),
    )


# --- registry ---------------------------------------------------------------------------------


def stored_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored rule set per supplier."""
    s = read(spark, sf_dir, "supplier")
    return s.select(
        (F.col("s_suppkey") + 1).cast("int").alias("id"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("created"),
        F.col("s_name").alias("name"), F.concat(F.lit("v"), (F.col("s_nationkey") % 3).cast("string")).alias("version"),
        F.lit(SRC).alias("source_onto"), F.lit(D).alias("target_onto"), F.lit("c").alias("creator"), F.lit("d").alias("description"),
        F.concat(F.lit("<doc> "), _text("s_suppkey"), F.lit(" </doc>")).alias("source_text"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets to add: every stored one again, reformatted or changed, and one per customer."""
    s = stored_alignments(spark, sf_dir)
    text = F.when(F.col("id") % 2 == 0, F.regexp_replace("source_text", " ", "  \n ")).otherwise(F.concat("source_text", F.lit("!")))
    c = read(spark, sf_dir, "customer").select(
        F.lit(0).alias("id"), F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00")).alias("created"), F.col("c_name").alias("name"), F.lit("v1").alias("version"),
        F.lit(SRC).alias("source_onto"), F.lit(D).alias("target_onto"), F.lit("c").alias("creator"), F.lit("d").alias("description"),
        F.concat(F.lit("<doc>"), "c_mktsegment", F.lit("</doc>")).alias("source_text"),
    )
    return s.withColumn("source_text", text).unionByName(c)


def stored_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel per customer, referring to suppliers' rule sets on either side."""
    c = read(spark, sf_dir, "customer")

    def supplier(n: Column) -> Column:
        return F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))

    ident = F.col("c_mktsegment") == "BUILDING"
    return c.select(
        (F.col("c_custkey") + 1).cast("int").alias("id"),
        F.when(F.col("c_custkey") % 10 == 9, "XX").when(F.col("c_custkey") % 2 == 0, "KK").otherwise(F.lit("MM")).alias("chan_type"),
        F.concat(F.lit("in/"), _text("c_nationkey")).alias("source"),
        supplier(F.col("c_nationkey")).alias("inp_name"), F.concat(F.lit("v"), (F.col("c_custkey") % 3).cast("string")).alias("inp_version"),
        F.when(ident, "").otherwise(supplier(F.col("c_custkey") % 20)).alias("out_name"), F.when(ident, "").otherwise(F.lit("v1")).alias("out_version"),
        F.concat(F.lit("out/"), _text("c_custkey")).alias("sink"), F.lit("").alias("consumer_group"),
        (F.col("c_custkey") % 4).cast("int").alias("parallelism"), F.md5("c_name").alias("uuid"),
    )


def channel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels to create, one per order; sinks repeat among them and among the stored ones."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.lit(0).alias("id"), F.when(F.col("o_orderstatus") == "F", "KK").otherwise(F.lit("MM")).alias("chan_type"),
        F.lit("in").alias("source"), F.lit("").alias("inp_name"), F.lit("").alias("inp_version"), F.lit("").alias("out_name"), F.lit("").alias("out_version"),
        F.concat(F.lit("out/"), (F.col("o_orderkey") * 7 % 5000).cast("string")).alias("sink"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" mine ")).alias("consumer_group"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 4).alias("parallelism"), F.md5(F.concat(F.lit("o"), _text("o_orderkey"))).alias("uuid"),
    )


# --- rule corpus ------------------------------------------------------------------------------


def _slot(is_var: bool, kind: Column | str, value: Column | str, dt: str = "") -> Column:
    def c(x):
        return F.lit(x) if isinstance(x, str) else x

    term = F.struct(c(kind).alias("kind"), c(value).alias("value"), F.lit(dt).alias("dt"), F.lit("").alias("lang"))
    return F.struct(F.lit(is_var).alias("is_var"), term.alias("term"))


def rule_corpus(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A rule set per order and a cell per line, with the defects the line's values plant."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("A"), _text("l_orderkey")).alias("name")
    version = F.lit("1").alias("version")
    n = F.col("l_linenumber")
    local = F.concat(F.lit("c"), n.cast("string"))
    cell_id = F.when(n % 2 == 1, F.concat(F.lit(V.SRIPAS), local)).otherwise(local).alias("cell_id")
    cells = [name, version, cell_id]
    kind = F.when(F.col("l_tax") == 0.08, "lit").otherwise(F.lit("iri"))
    p1 = F.when(F.col("l_discount") == 0.1, "price").otherwise(F.lit(SRC + "price"))
    v2 = F.when(F.col("l_quantity") > 45, V.SRIPAS + "node_c").otherwise(F.lit(V.SRIPAS + "node_b"))
    side1 = li.select(*cells, F.lit(1).alias("side"), _slot(True, "iri", "node_a").alias("s"), p1.alias("p"), _slot(False, "iri", V.SRIPAS + "node_b").alias("o"))
    side2 = li.select(*cells, F.lit(2).alias("side"), _slot(False, kind, V.SRIPAS + "node_a").alias("s"), F.lit(D + "price").alias("p"), _slot(False, "iri", v2).alias("o"))
    prm = F.when(F.col("l_discount") > 0.08, V.SRIPAS + "node_z").otherwise(F.lit(V.SRIPAS + "node_b"))
    params = F.array(
        F.struct(F.lit(1).alias("pos"), prm.alias("var"), F.lit(None).cast("string").alias("val"), F.lit(None).cast("string").alias("datatype")),
        F.struct(F.lit(2).alias("pos"), F.lit(None).cast("string").alias("var"), F.lit("2").alias("val"), F.lit(V.INTEGER).alias("datatype")),
    )
    tables = {
        "alignment": o.select(
            F.concat(F.lit("A"), _text("o_orderkey")).alias("name"), version,
            F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.lit(SRC)).alias("source_onto"), F.lit(D).alias("target_onto"),
            F.lit("").alias("creator"), F.lit("").alias("description"), F.lit(None).cast("timestamp").alias("created"), F.lit("").alias("source_text"),
        ),
        "alignment_step": li.select(
            name, version, n.alias("ordinal"), (F.col("l_suppkey") % 7).cast("int").alias("order_attr"),
            F.concat(F.lit("c"), (n + (F.col("l_returnflag") == "R").cast("int")).cast("string")).alias("cell_id"),
        ),
        "cell": li.select(*cells, n.alias("ordinal"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.lit("=")).alias("relation"), F.lit(None).cast("string").alias("error")),
        "cell_pattern": side1.unionByName(side2),
        "cell_typing": li.select(*cells, F.lit("node_b").alias("var"), F.lit(V.DECIMAL).alias("datatype")),
        "cell_filter": li.select(*cells, F.lit("node_b").alias("var"), F.lit(V.DECIMAL).alias("datatype")),
        "cell_function": li.select(*cells, F.lit(0).alias("ordinal"), F.lit("+").alias("fname"), F.lit(V.SRIPAS + "node_w").alias("ret"), params.alias("params")),
    }
    assert set(tables) == set(TABLES)
    return tables


def rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule-set document per part."""
    p = spread(read(spark, sf_dir, "part"))
    ns = " ".join(
        f'xmlns:{k}="{u}"'
        for k, u in (("rdf", V.RDF), ("align", V.ALIGN), ("sripas", V.SRIPAS), ("dc", V.PREFIXES["dc"]), ("exmo", V.PREFIXES["exmo"]), ("src", SRC), ("dst", D))
    )
    doc = F.concat(
        F.lit(f'<rdf:RDF {ns}><align:Alignment><dc:title>'), F.col("p_name"), F.lit("</dc:title><exmo:version>"), _text("p_partkey"),
        F.lit("</exmo:version><dc:creator>"), F.col("p_brand"), F.lit("</dc:creator><dc:description>"), F.col("p_type"),
        F.lit(f'</dc:description><align:onto1><align:Ontology rdf:about="{SRC}"/></align:onto1><align:onto2><align:Ontology rdf:about="{D}"/></align:onto2>'),
        F.lit('<sripas:steps rdf:parseType="Literal"><sripas:step sripas:order="1" sripas:cell="' + V.SRIPAS + 'c2"/><sripas:step sripas:order="2" sripas:cell="' + V.SRIPAS + 'c1"/></sripas:steps>'),
        F.lit('<align:map><align:Cell rdf:about="' + V.SRIPAS + 'c1"><align:entity1 rdf:parseType="Literal"><sripas:node_a><src:size rdf:datatype="' + V.INTEGER + '">'),
        _text("p_size"), F.lit("</src:size></sripas:node_a></align:entity1>"),
        F.lit('<align:entity2 rdf:parseType="Literal"><rdf:Description rdf:about="' + V.SRIPAS + 'node_a"><dst:size rdf:resource="' + V.SRIPAS + 'node_w"/></rdf:Description></align:entity2>'),
        F.lit('<align:relation>=</align:relation><sripas:transformation rdf:parseType="Literal"><sripas:function sripas:about="*"><sripas:param sripas:order="2" sripas:val="'),
        _text("p_size"), F.lit('" sripas:datatype="' + V.INTEGER + '"/><sripas:param sripas:order="1" sripas:about="' + V.SRIPAS + 'node_a"/><sripas:return sripas:about="' + V.SRIPAS + 'node_w"/></sripas:function></sripas:transformation>'),
        F.lit('<sripas:typings rdf:parseType="Literal"><sripas:typing sripas:about="' + V.SRIPAS + 'node_a" sripas:datatype="' + V.INTEGER + '"/></sripas:typings>'),
        F.lit('<sripas:filters rdf:parseType="Literal"><sripas:filter sripas:about="' + V.SRIPAS + 'node_a" sripas:datatype="' + V.STRING + '"/></sripas:filters></align:Cell></align:map>'),
        F.lit('<align:map><align:Cell rdf:about="' + V.SRIPAS + 'c2"><align:entity1 rdf:parseType="Literal"><src:part><src:brand>'), F.col("p_brand"),
        F.lit('</src:brand></src:part></align:entity1><align:entity2 rdf:parseType="Literal"/><align:relation>=</align:relation></align:Cell></align:map></align:Alignment></rdf:RDF>'),
    )
    return p.select(doc.alias("source_text"))


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of one rule set per conversation, with an order attribute."""
    return read(spark, sf_dir, "conversations").select(
        _text("conv_id").alias("name"), F.lit("1").alias("version"), F.col("turn").cast("int").alias("ordinal"),
        (F.length("text") % 10).cast("int").alias("order_attr"), F.concat(F.lit("c"), _text("turn")).alias("cell_id"),
    )

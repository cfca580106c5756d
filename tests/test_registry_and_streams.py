"""Registry snapshots, rule documents and streaming channels."""

import pytest
from pyspark.sql import functions as F

from catalog import corpus as C
from catalog.rules import BOOK, READINGS
from quadloom import vocab as V
from quadloom.operators import quality as Q, registry as G
from quadloom.operators.routing import CHANNEL_DDL
from quadloom.sources import rule_documents as RD, rule_tables as RT, topics
from quadloom.streaming.channels import ChannelRunner, translate_batch

SF = "/root/testdata/sf0.001"


def test_registry_snapshots(spark, tmp_path):
    reg = G.Registry(spark, str(tmp_path))
    with pytest.raises(ValueError):
        reg.read("alignment")
    reg.write("alignment", C.stored_alignments(spark, SF))
    reg.write("channel", C.stored_channels(spark, SF))
    before = reg.read("alignment").count()
    verdicts = {r[0]: r[1] for r in reg.add_alignments(C.uploads(spark, SF)).groupBy("verdict").count().collect()}
    assert verdicts["created"] == reg.read("alignment").count() - before
    ids = [r[0] for r in reg.read("alignment").select("id").collect()]
    assert len(ids) == len(set(ids)) == max(ids)
    reg.delete_channels(spark.createDataFrame([(1,)], "id int"))
    assert G.find_channel(reg.read("channel"), 1).isEmpty()


def test_two_different_uploads_under_one_key(spark):
    row = C.stored_alignments(spark, SF).limit(1)
    new = row.withColumn("name", F.lit("n")).select("*").unionByName(row.withColumn("name", F.lit("n")).withColumn("source_text", F.lit("other")))
    got = sorted(r["verdict"] for r in G.add_verdicts(row, new).collect())
    assert got == ["conflict", "created"]


def test_unbound_variables_in_one_grouped_pass(spark):
    """Read but not bound, once a variable; a cell without a complete name binds nothing, as no key equals null."""
    term = "struct<kind:string,value:string,dt:string,lang:string>"
    slot = f"struct<is_var:boolean,term:{term}>"
    v = lambda name: (True, ("iri", name, "", ""))
    rows = [("A", "1", "c", 1, v("a"), "p", v("b")), ("A", "1", "c", 2, v("a"), "p", v("w")), ("A", "1", "c", 2, v("a"), "p", v("x")),
            ("A", "1", "c", 2, v("x"), "p", v("z")), ("A", "1", None, 1, v("a"), "p", v("a")), ("A", "1", None, 2, v("a"), "p", v("a")),
            ("B", "1", "c", 2, v("b"), "p", v("b")), ("B", "1", "c", 3, v("b"), "p", v("b"))]
    calls = [("A", "1", "c", "w", [("b",), ("y",), ("y",), ("x",), (None,)]), ("B", "1", "c", None, None)]
    tables = {
        "cell_pattern": spark.createDataFrame(rows, f"name string, version string, cell_id string, side int, s {slot}, p string, o {slot}"),
        "cell_function": spark.createDataFrame(calls, "name string, version string, cell_id string, ret string, params array<struct<var:string>>"),
    }
    both = Q.unbound_variables(tables)
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()
    two, prm = "unbound variable in entity 2", "unbound function parameter"
    want = [("A", "c", two, "x"), ("A", "c", two, "z"), ("A", None, two, "a"), ("B", "c", two, "b"), ("A", "c", prm, "x"), ("A", "c", prm, "y")]
    got = [(r["name"], r["cell_id"], r["rule"], r["detail"]) for r in both.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    single = [tuple(r) for f in (Q.unbound_entity2, Q.unbound_params) for r in f(tables).select("name", "cell_id", "rule", "detail").collect()]
    assert sorted(map(str, single)) == sorted(map(str, want))


def test_document_to_running_rules(spark):
    tables = {k: v.cache() for k, v in RD.rule_tables(RD.parse_documents(C.rule_documents(spark, SF).limit(3))).items()}
    report = {r["rule"] for r in Q.quality_report(tables).collect()}
    assert report == {"structure"}  # the second cell has no entity 2
    book = RT.load_rulebook(tables)
    assert len(book.keys()) == 3
    program = book.program([book.keys()[0]])
    assert [s.cell_id for s in program.steps] == ["c2", "c1"] and not program.warnings


def test_documents_outside_the_subset_are_reported(spark):
    turtle = f'<rdf:RDF xmlns:rdf="{V.RDF}" xmlns:s="{V.SRIPAS}" xmlns:a="{V.ALIGN}"><a:Alignment><s:cellFormat><s:DataFormat rdf:about="{V.CELL_FORMAT_TURTLE}"/></s:cellFormat><a:map><a:Cell rdf:about="c"><a:entity1>_:a :p _:b .</a:entity1></a:Cell></a:map></a:Alignment></rdf:RDF>'
    df = spark.createDataFrame([(turtle,), ("<broken",)], "source_text string")
    rows = RD.parse_documents(df).collect()
    assert "turtle" in rows[0]["cells"][0]["error"] and rows[1]["error"]


def test_old_layout_header(spark):
    doc = '<Alignment name="" version="" creator="me"><onto1><Ontology about="http://o/1"/></onto1><steps><step order="1" cell="c"/></steps><map><Cell id="c"><entity1/><entity2/><relation>=</relation></Cell></map></Alignment>'
    tables = RD.convert_layout(RD.rule_tables(RD.parse_documents(spark.createDataFrame([(doc,)], "source_text string"))))
    head, cell = tables["alignment"].first(), tables["cell"].first()
    assert (head["name"], head["version"], head["creator"], head["source_onto"]) == ("new alignment", "1.0", "me", "http://o/1")
    assert cell["cell_id"] == V.SRIPAS + "c" == tables["alignment_step"].first()["cell_id"]


def test_rule_tables_round_trip(spark, tmp_path):
    RT.save_tables(RT.tables_from_cells(spark, [READINGS]), str(tmp_path / "rules"))
    tables = RT.read_tables(spark, str(tmp_path / "rules"))
    assert Q.quality_report(tables).where("rule <> 'structure'").isEmpty()
    book = RT.load_rulebook(tables, keys=spark.createDataFrame([("readings", "1")], "name string, version string"))
    for a, b in zip(book.program([READINGS.key]).steps, BOOK.program([READINGS.key]).steps, strict=True):
        assert a.cell_id == b.cell_id and len(a.plan.groups) == len(b.plan.groups)
        assert set(a.plan.groups[0].patterns) == set(b.plan.groups[0].patterns) and set(a.plan.groups[0].insert) == set(b.plan.groups[0].insert)
        assert a.plan.groups[0].binds == b.plan.groups[0].binds and a.plan.groups[0].filters == b.plan.groups[0].filters


def channel(spark, **over):
    row = dict(id=1, chan_type="MM", source="click", inp_name="readings", inp_version="1", out_name="labels", out_version="2",
               sink="out", consumer_group="", parallelism=1, uuid="u1")
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], CHANNEL_DDL)


def test_channel_stream_equals_batch_and_restarts(spark, tmp_path):
    raw = C.raw_messages(spark, SF).withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp"))
    extra = raw.limit(1).withColumn("raw", F.lit("not json")).withColumn("topic", F.lit("click"))
    source, one = str(tmp_path / "in"), channel(spark)
    first, second = raw.where("src_offset % 2 = 0").unionByName(extra), raw.where("src_offset % 2 = 1")
    first.write.parquet(source)
    runner = ChannelRunner(spark, BOOK, str(tmp_path / "out"), str(tmp_path / "state"))

    def drain():
        stream = topics.read_channel(spark, one.first().asDict(), bridge=topics.read_topic_files(spark, source))
        runner.start(stream, one, once=True).awaitTermination()
        runner.stop("u1")

    drain()
    second.write.mode("append").parquet(source)
    drain()
    drain()  # nothing new: nothing is written twice
    got = {(r["msg_id"], r["raw"]) for r in runner.output("u1").collect()}
    want, rejected = translate_batch(raw.where("topic = 'click'"), one, BOOK)
    assert runner.output("u1").count() == len(got) == want.count()
    assert got == {(r["msg_id"], r["raw"]) for r in want.collect()}
    assert rejected.isEmpty() and [r["bad"] for r in runner.output("u1", "rejected").collect()] == ["not json"]
    lat = topics.read_latency(runner.output("u1", "monitor"))
    assert lat.where("end_ms >= start_ms and channel_uuid = 'u1'").count() == len(got)
    with pytest.raises(ValueError):
        runner.stop("u1")


def test_channel_types(spark):
    conf = channel(spark, chan_type="KK", consumer_group="g").first().asDict()
    assert topics.kafka_options(conf, "h:1")["kafka.group.id"] == "g"
    assert topics.kafka_options({**conf, "consumer_group": ""}, "h:1")["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        topics.read_channel(spark, {**conf, "chan_type": "ZZ"})
    with pytest.raises(ValueError):
        topics.read_channel(spark, {**conf, "chan_type": "MM"})
    runner = ChannelRunner(spark, BOOK, "/tmp/none", "/tmp/none")
    with pytest.raises(ValueError, match="unknown alignment"):
        runner.start(None, channel(spark, inp_name="nope"))


def test_large_messages_in_a_channel_batch(spark):
    raw = C.raw_messages(spark, SF)
    one = channel(spark)
    a, _ = translate_batch(raw, one, BOOK)
    b, _ = translate_batch(raw, one, BOOK, limit=1)
    assert {(r["msg_id"], r["raw"]) for r in a.collect()} == {(r["msg_id"], r["raw"]) for r in b.collect()}


def test_retained_messages_merge(spark):
    ddl = "sink string, msg_id string, raw string, ingest_ts int, src_partition int, src_offset int"
    old = spark.createDataFrame([("a", "1", "x", 1, 0, 0), ("b", "1", "x", 5, 0, 0)], ddl)
    new = spark.createDataFrame([("a", "2", "y", 2, 0, 0), ("b", "2", "y", 4, 0, 0)], ddl)
    assert {(r["sink"], r["msg_id"]) for r in topics.merge_retained(old, new).collect()} == {("a", "2"), ("b", "1")}

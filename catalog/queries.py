"""Spark side of the catalog: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import corpus as C
from catalog.rules import BOOK, BROKEN, CELLS, DROP_ALL, READING, READINGS, REPEATED
from quadloom import lift, vocab as V
from quadloom.functions import registry as FN
from quadloom.lift import SRC as S
from quadloom.operators import jsonld as J, payload as P, quality as Q, registry as G, relational as R
from quadloom.operators import chains, constraints, routing, segments as SG, translate as TR
from quadloom.plans.lineage import cut_lineage, ensure_checkpoint_dir
from quadloom.plans.rules import Program, Step, compile_cell, compile_program, pattern as t
from quadloom.sources import rule_documents as RD, rule_tables as RT, topic_log, topics
from quadloom.streaming.channels import run_stream_once, translate_stream
from quadloom.terms import TERM_DDL, iri, literal, to_long

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


# --- shared inputs and outputs ----------------------------------------------------------------


def events(spark, sf) -> DataFrame:
    return lift.events_long(lift.read(spark, sf, "events"))


def event_payload(spark, sf) -> DataFrame:
    return P.payload(events(spark, sf)).drop("g")


def event_msgs(spark, sf) -> DataFrame:
    return lift.events_nested(lift.spread(lift.read(spark, sf, "events")))


def orders(spark, sf) -> DataFrame:
    return lift.orders_long(lift.read(spark, sf, "orders"), lift.read(spark, sf, "lineitem"))


def mixed(spark, sf) -> DataFrame:
    """Stored quads of both lifts: messages with and without a named payload, small and large.
    Written once, as every translation reads its quads several times."""
    return cut_lineage(events(spark, sf).unionByName(_order_quads(spark, sf)))


def order_triples(spark, sf) -> DataFrame:
    """Order graphs as sets: equal lines of an order have equal nodes."""
    return orders(spark, sf).drop("g")


def flat(df: DataFrame, *extra: str) -> DataFrame:
    """Triples with terms as plain columns."""
    s, o = F.col("s"), F.col("o")
    return df.select(
        "msg_id", *extra, s["kind"].alias("s_kind"), s["value"].alias("s_value"), "p",
        o["kind"].alias("o_kind"), o["value"].alias("o_value"), o["dt"].alias("o_dt"), o["lang"].alias("o_lang"),
    )


def nested_payload(msgs: DataFrame) -> DataFrame:
    return to_long(msgs).where(F.col("g") == V.PAYLOAD_GRAPH)


# --- one cell ---------------------------------------------------------------------------------


@query("cell_reading_relational")
def _(spark, sf):
    return flat(R.apply_cell(event_payload(spark, sf), compile_cell(READING)))


@query("cell_reading_nested")
def _(spark, sf):
    return flat(nested_payload(TR.translate_small(event_msgs(spark, sf), one_step(READING))))


def one_step(cell) -> Program:
    return Program((Step("one", "1", 0, 0, cell.cell_id, compile_cell(cell)),))


def _cell_queries() -> None:
    on_orders = {"cross_part_insert", "independent_parts", "literal_constant", "fresh_nodes", "unbound_insert"}
    for name, cell in CELLS.items():
        source = order_triples if name in on_orders else event_payload

        def relational(spark, sf, cell=cell, source=source):
            return flat(R.apply_cell(source(spark, sf), compile_cell(cell)))

        query(f"cell_{name}")(relational)
        if source is event_payload:

            def nested(spark, sf, cell=cell):
                return flat(nested_payload(TR.translate_small(event_msgs(spark, sf), one_step(cell))))

            query(f"cell_{name}_nested")(nested)


_cell_queries()


@query("cell_repeated_variable")
def _(spark, sf):
    li = lift.read(spark, sf, "lineitem")
    pairs = li.select(
        F.col("l_orderkey").cast("string").alias("msg_id"), lift.node("item", F.col("l_partkey") % 50).alias("s"),
        F.lit(S + "pairs").alias("p"), lift.node("item", F.col("l_suppkey") % 50).alias("o"),
    )
    return flat(R.apply_cell(pairs.distinct(), compile_cell(REPEATED)))


@query("graph_pattern_match")
def _(spark, sf):
    b = R.match_bgp(order_triples(spark, sf), [t("?o", S + "line", "?l"), t("?l", S + "part", "?p"), t("?l", S + "quantity", "?q")])
    return b.select("msg_id", *[F.col(v)["value"].alias(v) for v in ("l", "o", "p", "q")])


@query("graph_pattern_datatype_filter")
def _(spark, sf):
    b = R.match_bgp(event_payload(spark, sf), [t("?e", S + "observation", "?o"), t("?o", S + "k", "?k")])
    return R.typed_filter(b, "k", V.INTEGER).select("msg_id", F.col("e")["value"].alias("e"), F.col("k")["value"].alias("k"))


@query("bindings_retype")
def _(spark, sf):
    b = R.retype(R.match_bgp(event_payload(spark, sf), [t("?s", S + "k", "?k"), t("?e", S + "observation", "?s")]), "k", V.DOUBLE)
    b = R.retype(b, "s", V.STRING)
    k = F.col("k_typed")
    return b.select("msg_id", k["value"].alias("k"), k["dt"].alias("dt"), F.col("s_typed").isNull().alias("blank_is_error"))


@query("predicate_variable")
def _(spark, sf):
    cell = RULE_PREDICATE
    return flat(R.apply_cell(event_payload(spark, sf), compile_cell(cell, predicate_vars=True)))


def _predicate_rule():
    from quadloom.plans.rules import Cell

    return Cell("any", (t("?o", "?p", "?v"), t("?e", S + "observation", "?o")), (t("?e", "?p", "?v"),))


RULE_PREDICATE = _predicate_rule()


@query("effect_report")
def _(spark, sf):
    before = event_payload(spark, sf)
    return R.effect_report(before, R.apply_cell(before, compile_cell(READING)))


@query("effect_report_by_step")
def _(spark, sf):
    report = R.count_by_step(event_payload(spark, sf), BOOK.program([READINGS.key]))
    return report.select("msg_id", "step", "cell_id", "deleted", "inserted")


@query("graph_union_and_difference")
def _(spark, sf):
    o = order_triples(spark, sf)
    lines = o.where(F.col("p").isin(S + "line", S + "part"))
    keep = R.delete_matched(o, lines.where(F.col("p") == S + "line"))
    return flat(R.union_graphs(keep, lines.where(F.col("p") == S + "part")))


# --- functions --------------------------------------------------------------------------------


def _values(df: DataFrame, **terms) -> DataFrame:
    """Value and datatype of each computed term, every term evaluated once."""
    cols = []
    for name in terms:
        cols += [F.col(name)["value"].alias(name), F.col(name)["dt"].alias(name + "_dt")]
    return df.select("key", *[term.alias(name) for name, term in terms.items()]).select("key", *cols)


def _lines(spark, sf, *columns: str) -> DataFrame:
    """Columns of the lines, dealt out by their labels: equal results meet before they are computed, so that
    only these narrow rows are shuffled."""
    li = lift.read(spark, sf, "lineitem").withColumn("key", lift.line_label())
    return lift.spread(li.select("key", *columns), "key")


def _c(value: str, dt: str = V.STRING):
    return literal(value, dt)


@query("functions_string")
def _(spark, sf):
    d = lift.spread(lift.read(spark, sf, "documents"))
    x, f = literal(F.col("text")), FN.call
    return _values(
        d.withColumn("key", F.col("doc_id")),
        concat=f("CONCAT", [x, _c("|"), literal(F.col("lang"))]), strlen=f("STRLEN", [x]),
        substr=f("SUBSTR", [x, _c("3", V.INTEGER), _c("5", V.INTEGER)]), tail=f("SUBSTR", [x, _c("4", V.INTEGER)]),
        ucase=f("UCASE", [literal(F.col("source"))]), lcase=f("LCASE", [literal(F.col("source"))]),
        starts=f("STRSTARTS", [x, _c("The")]), ends=f("STRENDS", [x, _c(".")]), contains=f("CONTAINS", [x, _c("the")]),
        before=f("STRBEFORE", [x, _c(" ")]), after=f("STRAFTER", [x, _c(". ")]),
        replace=f("REPLACE", [x, _c("[aeiou]+"), _c("_")]), regex=f("REGEX", [x, _c("(th|he) "), _c("i")]),
        uri=f("ENCODE_FOR_URI", [literal(F.col("text"))]),
    )


@query("functions_arithmetic")
def _(spark, sf):
    li = _lines(spark, sf, "l_quantity", "l_extendedprice", "l_linenumber", "l_partkey")
    q, p = literal(lift.money(F.col("l_quantity")), V.DECIMAL), literal(lift.money(F.col("l_extendedprice")), V.DECIMAL)
    n, part = literal(F.col("l_linenumber").cast("string"), V.INTEGER), literal(F.col("l_partkey").cast("string"), V.INTEGER)
    f = FN.call
    out = _values(
        li,
        add=f("+", [q, p]), add_int=f("+", [n, part]), sub=f("-", [p, q, n]), mul=f("*", [q, p]), mul_int=f("*", [n, part]),
        div=f("/", [p, _c("8", V.INTEGER)]), div_zero=f("/", [p, _c("0", V.INTEGER)]), untyped=f("+", [q, literal(F.lit("x"))]),
        dbl=f("+", [literal(F.col("l_linenumber").cast("string"), V.DOUBLE), n]),
    )
    return out.distinct()


@query("functions_exact_decimals")
def _(spark, sf):
    """Products and sums with more fraction digits than money has, and past 20 digits."""
    li = _lines(spark, sf, "l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    price, disc, tax = (literal(lift.money(F.col(f"l_{c}")), V.DECIMAL) for c in ("extendedprice", "discount", "tax"))
    large = literal(F.concat(F.col("l_orderkey").cast("string"), F.lit("99999999999999999999.5")), V.DECIMAL)
    f, tiny = FN.call, _c("0.00000001", V.DECIMAL)
    out = _values(
        li,
        mul=f("*", [price, disc, tax]), mul_tiny=f("*", [price, disc, tax, tiny]), add_tiny=f("+", [price, tiny]), sub_tiny=f("-", [tiny, disc]),
        add_large=f("+", [large, disc]), abs_tiny=f("ABS", [f("-", [tiny, price])]), floor_large=f("FLOOR", [large]), cast_tiny=f("xsd:decimal", [f("*", [tax, tiny])]),
    )
    return out.distinct()


@query("functions_numeric")
def _(spark, sf):
    p = lift.spread(lift.read(spark, sf, "customer"))
    x = literal(lift.money(F.col("c_acctbal")), V.DECIMAL)
    i = literal(F.col("c_custkey").cast("string"), V.INTEGER)
    f = FN.call
    return _values(
        p.withColumn("key", F.col("c_custkey")),
        abs=f("ABS", [x]), ceil=f("CEIL", [x]), floor=f("FLOOR", [x]), round=f("ROUND", [x]), abs_int=f("ABS", [i]), round_int=f("ROUND", [i]),
        numeric=f("ISNUMERIC", [x]), not_numeric=f("ISNUMERIC", [literal(F.col("c_name"), V.INTEGER)]),
    )


@query("functions_date")
def _(spark, sf):
    e = lift.spread(lift.read(spark, sf, "events"))
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "-05:30").otherwise(F.lit(""))
    x = literal(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), zone), V.DATETIME)
    f = FN.call
    return _values(
        e.withColumn("key", F.col("event_id")),
        year=f("YEAR", [x]), month=f("MONTH", [x]), day=f("DAY", [x]), hours=f("HOURS", [x]), minutes=f("MINUTES", [x]),
        seconds=f("SECONDS", [x]), tz=f("TZ", [x]), timezone=f("TIMEZONE", [x]),
        utc=f("unixEpochToUTC", [literal(lift.epoch_seconds(F.col("ts")).cast("string"), V.INTEGER)]),
        utc_bad=f("unixEpochToUTC", [literal(F.col("event_type"), V.INTEGER)]),
    )


@query("functions_hash")
def _(spark, sf):
    d = lift.spread(lift.read(spark, sf, "documents"))
    x, f = literal(F.col("text")), FN.call
    return _values(d.withColumn("key", F.col("doc_id")), md5=f("MD5", [x]), sha1=f("SHA1", [x]), sha256=f("SHA256", [x]))


@query("functions_term")
def _(spark, sf):
    c = lift.spread(lift.read(spark, sf, "customer"))
    name, key = literal(F.col("c_name")), lift.node("customer", F.col("c_custkey"))
    tag = _c("en-GB")
    tagged, f = FN.call("STRLANG", [name, tag]), FN.call
    return _values(
        c.withColumn("key", F.col("c_custkey")),
        str=f("STR", [key]), iri=f("IRI", [literal(F.concat(F.lit(S), "c_mktsegment"))]), strdt=f("STRDT", [name, key]), strlang=tagged,
        lang=f("LANG", [tagged]), datatype=f("DATATYPE", [tagged]), langmatches=f("LANGMATCHES", [f("LANG", [tagged]), _c("EN")]),
        isiri=f("ISIRI", [key]), isblank=f("ISBLANK", [key]), isliteral=f("ISLITERAL", [name]), same=f("SAMETERM", [name, tagged]),
        bnode=f("BNODE", [name]),
    )


@query("functions_condition")
def _(spark, sf):
    c = lift.spread(lift.read(spark, sf, "customer"))
    bal = literal(lift.money(F.col("c_acctbal")), V.DECIMAL)
    building = literal((F.col("c_mktsegment") == "BUILDING").cast("string"), V.BOOLEAN)
    missing, f = F.lit(None).cast(TERM_DDL), FN.call
    return _values(
        c.withColumn("key", F.col("c_custkey")),
        if_=f("IF", [building, bal, _c("no")]), if_error=f("IF", [missing, bal, bal]), coalesce=f("COALESCE", [missing, bal]), bound=f("BOUND", [missing]),
    )


@query("functions_cast")
def _(spark, sf):
    p = lift.spread(lift.read(spark, sf, "customer"))
    dec, i, s = literal(lift.money(F.col("c_acctbal")), V.DECIMAL), literal(F.col("c_custkey").cast("string"), V.INTEGER), literal(F.col("c_name"))
    f = FN.call
    return _values(
        p.withColumn("key", F.col("c_custkey")),
        to_int=f("xsd:integer", [dec]), to_dec=f("xsd:decimal", [i]), to_bool=f("xsd:boolean", [i]), to_str=f("xsd:string", [dec]),
        bad=f("xsd:integer", [s]), bool_int=f("xsd:integer", [literal("true", V.BOOLEAN)]), dt=f("xsd:dateTime", [s]),
    )


# --- composition ------------------------------------------------------------------------------


def _translated(spark, sf, keys) -> DataFrame:
    done = TR.translate_quads(events(spark, sf), BOOK.program(keys))
    return flat(done, "g")


@query("alignment_steps_relational")
def _(spark, sf):
    return _translated(spark, sf, [("readings", "1")])


@query("alignment_steps_nested")
def _(spark, sf):
    return flat(to_long(TR.translate(event_msgs(spark, sf), BOOK.program([("readings", "1")]))), "g")


@query("alignment_steps_by_size")
def _(spark, sf):
    """Both forms in one run: the limit sends some messages each way."""
    done = TR.translate_mixed(mixed(spark, sf), BOOK.program([("readings", "1")]), limit=20)
    return flat(done, "g")


def _order_quads(spark, sf):
    return orders(spark, sf).withColumn("msg_id", F.concat(F.lit("order/"), "msg_id"))


@query("alignment_chain")
def _(spark, sf):
    return _translated(spark, sf, [("readings", "1"), ("", ""), ("labels", "2")])


@query("alignment_identity")
def _(spark, sf):
    return _translated(spark, sf, [("", "")])


@query("alignment_malformed_cell")
def _(spark, sf):
    program = compile_program([BROKEN])
    done = flat(TR.translate_small(event_msgs(spark, sf), program).transform(nested_payload))
    return done.withColumn("cell_id", F.lit(",".join(w[2] for w in program.warnings)))


@query("alignment_from_rule_tables")
def _(spark, sf):
    tables = RT.tables_from_cells(spark, [READINGS])
    book = RT.load_rulebook(tables)
    return flat(to_long(TR.translate(event_msgs(spark, sf), book.program([READINGS.key]))), "g")


@query("channel_routing")
def _(spark, sf):
    msgs = event_msgs(spark, sf).join(C.raw_messages(spark, sf).select("msg_id", "topic"), "msg_id")
    done = routing.apply_channels(msgs, C.channels(spark, sf), BOOK)
    return flat(to_long(done, "sink").where(F.col("g") == V.PAYLOAD_GRAPH), "sink")


@query("channel_chains")
def _(spark, sf):
    """Whole graphs for all channels, each distinct chain translated once a message."""
    msgs = event_msgs(spark, sf).join(C.raw_messages(spark, sf).select("msg_id", "topic"), "msg_id")
    return flat(to_long(chains.apply_channels(msgs, C.channels(spark, sf), BOOK), "sink"), "g", "sink")


@query("channel_chain_counts")
def _(spark, sf):
    """Translations made for each topic: as many a message as there are distinct chains."""
    msgs = event_msgs(spark, sf).join(C.raw_messages(spark, sf).select("msg_id", "topic"), "msg_id")
    done = chains.translate_by_chains(msgs, C.channels(spark, sf), BOOK)
    return done.groupBy("topic").agg(F.count("*").alias("n_translations"), F.count_distinct("msg_id").alias("n_messages"))


@query("channel_empty_payload")
def _(spark, sf):
    """Messages that lose all triples are still messages."""
    done = TR.translate(event_msgs(spark, sf), one_step(DROP_ALL))
    return done.select("msg_id", F.size("triples").alias("n_triples"), F.size("meta").alias("n_meta"))


# --- messages ---------------------------------------------------------------------------------


@query("payload_selection")
def _(spark, sf):
    return flat(P.payload(mixed(spark, sf)), "g")


@query("payload_replacement")
def _(spark, sf):
    quads = mixed(spark, sf)
    new = R.apply_cell(P.payload(quads).drop("g"), compile_cell(CELLS["independent_parts"]))
    return flat(P.with_payload(quads, new), "g")


@query("jsonld_read")
def _(spark, sf):
    return flat(J.jsonld_to_quads(C.raw_messages(spark, sf)), "g")


@query("jsonld_round_trip")
def _(spark, sf):
    docs = J.write_messages(J.read_messages(C.raw_messages(spark, sf))[0].select("msg_id", "payload_g", "triples", "meta"))
    return flat(J.jsonld_to_quads(docs), "g")


@query("jsonld_write_payload")
def _(spark, sf):
    msgs = event_msgs(spark, sf)
    return msgs.select("msg_id", J.payload_to_jsonld(F.col("triples")).alias("doc"))


@query("jsonld_write_quads")
def _(spark, sf):
    docs, large = J.quads_to_jsonld(P.payload(events(spark, sf)))
    return docs.select("msg_id", "raw")


@query("jsonld_segments")
def _(spark, sf):
    """Documents cut into several pieces each, and put together again."""
    return SG.join_segments(SG.write_segments(P.payload(events(spark, sf)), piece_bytes=200))


@query("jsonld_large_message")
def _(spark, sf):
    """All orders of a status are one message, far above what a row should hold."""
    o = lift.read(spark, sf, "orders")
    props = [F.struct(F.lit(S + p).alias("p"), literal(F.col(c)).alias("o")) for p, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"))]
    name = iri(F.concat(F.lit(S + "order/"), "o_orderkey"))
    nodes = o.select(F.col("o_orderstatus").alias("msg_id"), F.lit(V.DEFAULT_GRAPH).alias("g"), name.alias("s"), F.array(*props).alias("props"))
    quads = nodes.select("msg_id", "g", "s", F.inline("props"))
    return SG.write_segments(quads, piece_bytes=1 << 16)


@query("jsonld_context_patch")
def _(spark, sf):
    raw = C.raw_messages(spark, sf)
    return raw.select("msg_id", J.patch_context(F.col("raw")).alias("raw"))


@query("message_size_limit")
def _(spark, sf):
    d = lift.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("msg_id"), F.col("text").alias("raw"))
    fits, rejected = J.limit_message_size(d, kb=1)
    return fits.select("msg_id", F.lit(True).alias("fits")).unionByName(rejected.select("msg_id", F.lit(False).alias("fits")))


@query("bad_messages")
def _(spark, sf):
    """Prose is not a message: all documents are rejected, all events pass."""
    d = lift.read(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("msg_id"), F.col("text").alias("raw"))
    _, bad = J.read_messages(C.raw_messages(spark, sf).select("msg_id", "raw").unionByName(d), max_depth=5)
    return bad.select("msg_id", "bad")


# --- sinks and streams ------------------------------------------------------------------------


def _documents(spark, sf) -> DataFrame:
    raw = C.raw_messages(spark, sf)
    return raw.select("*", F.concat(F.lit("out/"), "topic").alias("sink"), F.md5("topic").alias("channel_uuid"))


@query("sink_rows")
def _(spark, sf):
    return topics.sink_rows(_documents(spark, sf).withColumn("raw", F.md5("raw")))


def _published(spark, sf) -> DataFrame:
    """Documents published to a topic log by a drained stream, in several batches, read back."""
    work = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    docs = _documents(spark, sf).select("sink", "raw", "channel_uuid", F.col("ingest_ts").cast("timestamp").alias("ingest_ts"), "src_offset")
    docs.repartition(3).write.parquet(f"{work}/in")
    topic_log.register(spark)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    sink = topic_log.log_rows(stream).writeStream.format(topic_log.FORMAT).option("path", f"{work}/log")
    sink.option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return topic_log.read_log(spark, f"{work}/log")


@query("sink_topic_log")
def _(spark, sf):
    return _published(spark, sf).select("topic", "value", "channel_uuid")


@query("sink_log_retained")
def _(spark, sf):
    """What each topic keeps, published in source order by four tasks a batch."""
    work = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    topic_log.append(_documents(spark, sf).withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp")), work, "all", 0, parallelism=4)
    return topic_log.retained(topic_log.read_log(spark, work)).select("topic", "value")


@query("sink_retained_message")
def _(spark, sf):
    return topics.latest_per_topic(_documents(spark, sf).withColumn("raw", F.md5("raw")))


@query("monitoring_latency")
def _(spark, sf):
    start = lift.epoch_seconds(F.col("ingest_ts")) * 1000
    return topics.emit_latency(_documents(spark, sf), start, start + F.col("src_offset") % 97)


@query("monitoring_rollup")
def _(spark, sf):
    start = lift.epoch_seconds(F.col("ingest_ts")) * 1000
    rows = topics.emit_latency(_documents(spark, sf), start, start + F.col("src_offset") % 97)
    return topics.latency_rollup(topics.read_latency(rows), minutes=60)


@query("stream_channels")
def _(spark, sf):
    """The routed translation as a stream over message files, drained once, read back."""
    work = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = C.raw_messages(spark, sf).withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp"))
    raw.write.parquet(f"{work}/in")
    stream = topics.read_topic_files(spark, f"{work}/in")
    run_stream_once(stream, C.channels(spark, sf), BOOK, f"{work}/out", f"{work}/state")
    docs = spark.read.parquet(f"{work}/out")
    return flat(J.jsonld_to_quads(docs, keep=("sink",)).where(F.col("g") == V.PAYLOAD_GRAPH), "sink")


@query("stream_rejected_messages")
def _(spark, sf):
    """Documents that are no messages, kept with a reason by a drained stream."""
    work = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = C.raw_messages(spark, sf).withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp"))
    docs = lift.read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("msg_id"), F.lit("click").alias("topic"), F.lit(0).alias("src_partition"),
        F.col("doc_id").alias("src_offset"), F.lit(None).cast("timestamp").alias("ingest_ts"), F.col("text").alias("raw"))
    raw.select(*docs.columns).union(docs).write.parquet(f"{work}/in")
    run_stream_once(topics.read_topic_files(spark, f"{work}/in"), C.channels(spark, sf), BOOK, f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out-rejected").select("msg_id", "bad", F.octet_length("raw").cast("long").alias("n_bytes"))


@query("batch_channels_from_text")
def _(spark, sf):
    docs = translate_stream(C.raw_messages(spark, sf), C.channels(spark, sf), BOOK)
    return flat(J.jsonld_to_quads(docs, keep=("sink",)).where(F.col("g") == V.PAYLOAD_GRAPH), "sink")


# --- registry ---------------------------------------------------------------------------------


@query("registry_key_hash")
def _(spark, sf):
    return C.stored_alignments(spark, sf).select("name", "version", G.key_hash().alias("key"))


@query("registry_add_verdicts")
def _(spark, sf):
    return G.add_verdicts(C.stored_alignments(spark, sf), C.uploads(spark, sf)).select("name", "version", "verdict")


@query("registry_add_alignments")
def _(spark, sf):
    table, _ = G.add_alignments(C.stored_alignments(spark, sf), C.uploads(spark, sf))
    return table.select("id", "name", "version", "source_text")


@query("registry_delete_alignments")
def _(spark, sf):
    stored = C.stored_alignments(spark, sf)
    keys = stored.select("name", "version").unionByName(lift.read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("v1").alias("version")))
    table, verdicts = G.delete_alignments(stored, keys, C.stored_channels(spark, sf))
    return verdicts.withColumn("n_left", F.lit(table.count()))


@query("registry_channel_counts")
def _(spark, sf):
    return G.channel_counts(C.stored_channels(spark, sf))


@query("registry_add_channels")
def _(spark, sf):
    table, _ = G.add_channels(C.stored_channels(spark, sf), C.channel_requests(spark, sf))
    return table.select("id", "sink", "consumer_group", "parallelism", "uuid")


@query("registry_sink_conflicts")
def _(spark, sf):
    return G.sink_conflicts(C.stored_channels(spark, sf), C.channel_requests(spark, sf)).select("uuid", "sink")


@query("registry_delete_channels")
def _(spark, sf):
    gone = lift.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") + 1).cast("int").alias("id")).distinct()
    return G.delete_channels(C.stored_channels(spark, sf), gone).select("id", "sink")


@query("registry_alignment_info")
def _(spark, sf):
    return G.alignment_info(C.stored_alignments(spark, sf)).drop("created")


@query("registry_channel_info")
def _(spark, sf):
    return G.channel_info(C.stored_channels(spark, sf)).select("id", "desc_id")


@query("registry_find")
def _(spark, sf):
    found = G.find_alignment(C.stored_alignments(spark, sf), "Supplier#000000003", "v1")
    chan = G.find_channel(C.stored_channels(spark, sf), 7)
    return found.select("id", "name").unionByName(chan.select("id", F.col("source").alias("name")))


# --- rule sets and their quality ---------------------------------------------------------------


def _report(df: DataFrame) -> DataFrame:
    return df.select("name", "version", "cell_id", "rule", "detail")


for _name, _check in {
    "quality_duplicate_cells": lambda tb: Q.duplicate_cells(tb["cell"]),
    "quality_missing_step_cells": lambda tb: Q.missing_step_cells(tb["alignment_step"], tb["cell"]),
    "quality_unbound_entity2": Q.unbound_entity2,
    "quality_unbound_params": Q.unbound_params,
    "quality_structure": Q.structure,
    "quality_malformed_entities": Q.malformed_entities,
    "quality_report": Q.quality_report,
}.items():
    query(_name)(lambda spark, sf, check=_check: _report(check(C.rule_corpus(spark, sf))))


@query("quality_constraints")
def _(spark, sf):
    """Constraints held in a table, over the whole rule corpus."""
    table = constraints.constraint_table(spark, constraints.CONFORMING)
    return constraints.violations(C.rule_corpus(spark, sf), constraints.read_constraints(table))


@query("quality_step_order")
def _(spark, sf):
    return _report(Q.step_order(C.conversation_steps(spark, sf)))


@query("quality_valid_alignments")
def _(spark, sf):
    tables = C.rule_corpus(spark, sf)
    return Q.valid_alignments(tables, Q.quality_report(tables)).select("name", "version")


@query("quality_channels")
def _(spark, sf):
    return Q.check_channels(C.stored_channels(spark, sf), C.stored_alignments(spark, sf))


def _parsed(spark, sf):
    return RD.rule_tables(RD.parse_documents(C.rule_documents(spark, sf)), created="2024-01-01 00:00:00")


@query("rule_document_headers")
def _(spark, sf):
    return _parsed(spark, sf)["alignment"].select("name", "version", "source_onto", "target_onto", "creator", "description")


@query("rule_document_steps")
def _(spark, sf):
    return _parsed(spark, sf)["alignment_step"]


@query("rule_document_patterns")
def _(spark, sf):
    def slot(c):
        return [F.col(c)["term"][f].alias(f"{c}_{f}") for f in ("kind", "value", "dt")]

    return _parsed(spark, sf)["cell_pattern"].select("name", "version", "cell_id", "side", *slot("s"), "p", *slot("o"))


@query("rule_document_functions")
def _(spark, sf):
    fn = _parsed(spark, sf)["cell_function"]
    return fn.select("name", "version", "cell_id", "fname", "ret", F.inline("params"))


@query("rule_document_typings")
def _(spark, sf):
    tb = _parsed(spark, sf)
    return tb["cell_typing"].withColumn("what", F.lit("typing")).unionByName(tb["cell_filter"].withColumn("what", F.lit("filter")))


@query("rule_layout_conversion")
def _(spark, sf):
    tables = C.rule_corpus(spark, sf)
    blank_first = {n: df.withColumn("name", F.when(F.col("name").endswith("0"), "").otherwise(F.col("name"))) for n, df in tables.items()}
    out = RD.convert_layout(blank_first)
    return out["cell"].select("name", "version", "cell_id").unionByName(out["alignment_step"].select("name", "version", "cell_id"))


__all__ = ["QUERIES"]

"""Chains as a prefix tree: one translation for each distinct chain, whatever the number of channels."""

import pytest
from pyspark.sql import functions as F

from catalog import corpus as C
from catalog.rules import BOOK
from helpers import frames
from quadloom.operators import chains, routing
from quadloom.plans.lineage import no_cut
from quadloom.plans.rules import IDENTITY

READ, LABEL = ("readings", "1"), ("labels", "2")
SF = "/root/testdata/sf0.001"


def channel_rows(spark, pairs, topics=("click",), n=None):
    rows = []
    for i in range(n or len(pairs)):
        inp, out = pairs[i % len(pairs)]
        rows.append((i, "KK", topics[i % len(topics)], *inp, *out, f"out/{i}", "g", 1, f"u{i}"))
    return spark.createDataFrame(rows, routing.CHANNEL_DDL)


def messages(spark):
    from quadloom import lift

    msgs = lift.events_nested(lift.read(spark, SF, "events"))
    return msgs.join(C.raw_messages(spark, SF).select("msg_id", "topic"), "msg_id")


def graphs(df):
    return sorted((r["msg_id"], r["sink"], sorted(map(str, r["triples"]))) for r in df.select("msg_id", "sink", "triples").collect())


def test_tree_shares_beginnings():
    tree = chains.prefix_tree([(READ, LABEL), (READ, IDENTITY), (IDENTITY, LABEL), (READ, LABEL)])
    assert {k: b.chains for k, b in tree.after.items()} == {READ: [0, 1, 3], IDENTITY: [2]}
    assert {k: b.ends for k, b in tree.after[READ].after.items()} == {LABEL: [0, 3], IDENTITY: [1]}
    assert len(list(tree.walk())) == 5


def test_a_thousand_channels_with_three_chains(spark):
    pairs = [(READ, LABEL), (READ, IDENTITY), (IDENTITY, IDENTITY)]
    table, msgs = channel_rows(spark, pairs, n=1000), messages(spark).where("topic = 'click'").limit(20).persist()
    once = chains.translate_by_chains(msgs, table, BOOK)
    assert once.groupBy("msg_id").count().where("count <> 3").isEmpty() and once.count() == 3 * msgs.count()
    copies = chains.to_channels(once, table)
    assert copies.count() == 1000 * msgs.count() and copies.select("msg_id").distinct().count() == copies.count()


def test_chains_equal_channels(spark):
    """The same graphs as a translation of each channel's copy, but for the names of new blank nodes."""
    pairs = [(READ, LABEL), (IDENTITY, LABEL), (READ, IDENTITY), (IDENTITY, IDENTITY), (LABEL, READ)]
    table, msgs = channel_rows(spark, pairs, ("click", "view")), messages(spark)
    named = F.transform("triples", lambda t: F.struct(*(F.when(t[c]["kind"] == "bnode", F.lit("b")).otherwise(t[c]["value"]) for c in "so"), t["p"]))
    want = graphs(routing.apply_channels(msgs, table, BOOK, cut=no_cut).withColumn("triples", named))
    for limit in (None, 0, 4, 256):
        assert graphs(chains.apply_channels(msgs, table, BOOK, limit=limit).withColumn("triples", named)) == want


def test_awkward_channels(spark):
    _, msgs = frames(spark, {"m": [("a", "p", "b")], "empty": []})
    msgs = msgs.withColumns({"topic": F.lit("t"), "chain": F.lit("own")}).drop("chain").unionByName(msgs.withColumn("topic", F.lit(None).cast("string")))
    none = channel_rows(spark, [(IDENTITY, IDENTITY)]).where("false")
    assert chains.apply_channels(msgs, none, BOOK).count() == 0
    table = channel_rows(spark, [(IDENTITY, IDENTITY)], ("t", "other"), 4)
    got = chains.apply_channels(msgs, table, BOOK)
    assert sorted(r["msg_id"] for r in got.collect()) == ["0/empty", "0/m", "2/empty", "2/m"]
    with pytest.raises(ValueError, match="unknown alignment"):
        chains.apply_channels(msgs, channel_rows(spark, [(("nope", "1"), IDENTITY)], ("t",)), BOOK)
    huge = chains.bounded_by_bytes(table, most=1)
    assert huge is table


def test_plan_grows_with_alignments_not_channels(spark):
    msgs, pairs = messages(spark), [(READ, LABEL), (READ, IDENTITY)]
    sizes = [len(chains.apply_channels(msgs, channel_rows(spark, pairs, n=n), BOOK)._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 300)]
    assert sizes[1] < 1.1 * sizes[0] + 2000

"""The committing topic sink: each message once, in order, with its own times."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from catalog import corpus as C
from catalog.rules import BOOK
from quadloom.sources import topic_log as L, topics
from quadloom.streaming.channels import ChannelRunner, translate_batch
from tests.test_registry_and_streams import SF, channel

DOC_DDL = "sink string, raw string, channel_uuid string, ingest_ts timestamp, src_partition int, src_offset bigint"


def docs(spark, n, partition=0):
    rows = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id") % 3).alias("sink"), F.concat(F.lit("m"), "id").alias("raw"), F.lit("u").alias("channel_uuid"),
        F.timestamp_millis(F.col("id")).alias("ingest_ts"), F.lit(partition).alias("src_partition"), F.col("id").alias("src_offset"))
    return rows


def drain(spark, source, log, state):
    stream = spark.readStream.schema(DOC_DDL).option("maxFilesPerTrigger", 1).parquet(source)
    L.register(spark)
    L.log_rows(stream).writeStream.format(L.FORMAT).option("path", log).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def without(folder, copy, part, *names):
    """A copy of a folder that lacks some files of one of its parts."""
    return shutil.copytree(folder, copy, ignore=lambda at, _: names if os.path.basename(at) == part else ())


def test_a_repeated_batch_leaves_each_message_once(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    docs(spark, 90).repartition(3).write.parquet(source)
    drain(spark, source, log, state)
    n_batches = len(glob.glob(f"{log}/commits/*.json"))
    n_files = len(glob.glob(f"{log}/data/*.parquet"))
    assert n_batches == 3
    # as if the session had ended after the sink's commit of the last batch and before Spark's own
    again = without(state, str(tmp_path / "again"), "commits", "2", ".2.crc")
    drain(spark, source, log, again)
    assert os.path.exists(f"{again}/commits/2")
    assert len(glob.glob(f"{log}/commits/*.json")) == n_batches and len(glob.glob(f"{log}/data/*.parquet")) == n_files
    # and before it: the sink's commit is missing too, its files stay behind unread
    last = os.path.basename(glob.glob(f"{log}/commits/*-2.json")[0])
    log = without(log, str(tmp_path / "cut"), "commits", last)
    assert L.read_log(spark, log).count() < 90
    drain(spark, source, log, without(state, str(tmp_path / "third"), "commits", "2", ".2.crc"))
    got = L.read_log(spark, log)
    assert sorted(r["value"] for r in got.collect()) == sorted(f"m{i}" for i in range(90))
    assert len(glob.glob(f"{log}/data/*.parquet")) > n_files


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    L.append(docs(spark, 5), log, "q", 0)
    broken = docs(spark, 40).withColumn("raw", F.when(F.col("src_offset") == 33, F.raise_error(F.lit("gone")).cast("string")).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="gone"):
        L.append(broken, log, "q", 1)
    assert L.read_log(spark, log).count() == 5
    L.append(docs(spark, 40), log, "q", 1)
    L.append(docs(spark, 40), log, "q", 1)  # the same batch again
    L.append(docs(spark, 7), log, "other", 1)  # another query has batches of its own
    assert {(r["query"], r["batch"]): r["count"] for r in L.read_log(spark, log).groupBy("query", "batch").count().collect()} == {
        ("q", 0): 5, ("q", 1): 40, ("other", 1): 7}


def test_order_with_a_hot_source_partition(spark, tmp_path):
    log = str(tmp_path / "log")
    both = docs(spark, 3000, 0).unionByName(docs(spark, 10, 1)).repartition(5)
    L.append(both, log, "q", 0, parallelism=4)
    rows = L.read_log(spark, log).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(3010))
    assert [r["value"] for r in rows] == [f"m{i}" for i in range(3000)] + [f"m{i}" for i in range(10)]
    parts = [r["rows"] for r in spark.read.json(f"{log}/commits").collect()]
    assert len(parts) == 4 and max(parts) < 1500  # the hot partition is shared


def test_awkward_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    L.append(docs(spark, 0), log, "q", 0)
    assert L.read_log(spark, log).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, None), ("t", "", "u", None, 0, 1), ("t", "", "u", None, 0, 1), ("t", "x" * 3_000_000, "u", None, 0, 2)], DOC_DDL)
    L.append(odd.withColumn("nth", F.lit("clash")), log, "q", 1, parallelism=2)
    got = L.read_log(spark, log).select("topic", F.length("value").alias("n")).collect()
    assert sorted(map(str, got)) == sorted(["Row(topic=None, n=None)"] + ["Row(topic='t', n=0)"] * 2 + ["Row(topic='t', n=3000000)"])
    assert L.latency(L.read_log(spark, log)).isEmpty()
    L.register(spark)
    with pytest.raises(Exception, match="topic"):
        spark.range(3).write.format(L.FORMAT).mode("append").option("path", log).option("query", "q").option("batch", "2").save()


def test_late_rows_and_retained_messages(spark, tmp_path):
    log = str(tmp_path / "log")
    for n, (lo, hi) in enumerate([(0, 10), (20, 30), (10, 20)]):  # the third batch is late
        L.append(docs(spark, 30).where(F.col("src_offset").between(lo, hi - 1)), log, "q", n, parallelism=2)
    got = {r["topic"]: r["value"] for r in L.retained(L.read_log(spark, log)).collect()}
    assert got == {"t0": "m18", "t1": "m19", "t2": "m17"}  # published last


def test_channels_publish(spark, tmp_path):
    raw = C.raw_messages(spark, SF).withColumn("ingest_ts", F.col("ingest_ts").cast("timestamp"))
    source, log, one = str(tmp_path / "in"), str(tmp_path / "log"), channel(spark, parallelism=3)
    raw.write.parquet(source)
    runner = ChannelRunner(spark, BOOK, str(tmp_path / "out"), log=log)
    runner.start(topics.read_channel(spark, one.first().asDict(), bridge=topics.read_topic_files(spark, source)), one, once=True).awaitTermination()
    want, _ = translate_batch(raw.where("topic = 'click'"), one, BOOK)
    got = L.read_log(spark, log)
    assert sorted(r["value"] for r in got.collect()) == sorted(r["raw"] for r in want.collect())
    assert {r["topic"] for r in got.select("topic").distinct().collect()} == {"out"}
    times = L.latency(got)
    assert times.select("start_ms").distinct().count() == raw.where("topic = 'click'").select("ingest_ts").distinct().count()
    assert times.where("end_ms >= start_ms").count() == got.count()

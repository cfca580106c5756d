"""Work is dealt out and written compactly, whatever the files of a table look like."""

import os

from pyspark.sql import functions as F

from quadloom import lift, vocab as V
from quadloom.operators import jsonld as J
from quadloom.plans import lineage
from quadloom.sources import rule_documents as RD
from quadloom.terms import iri, literal


def _rows_by_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lift, "ROWS_A_TASK", 1000)
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    # as many splits as cores, of which one holds the only row group
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert max(_rows_by_task(lift.spread(df))) <= 2000
        assert lift.spread(df).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dealt_out_rows_stay(spark):
    df = spark.range(0, 4000, 1, 16)
    assert lift.spread(df) is df


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([("<a/>",)], "source_text string")
    for table, df in RD.rule_tables(RD.parse_documents(docs)).items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_document(") == 1, table


def test_cut_rows_are_compact_and_complete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    rows = spark.range(20_000).select(
        F.col("id").cast("string").alias("msg_id"), F.lit("").alias("g"), iri(F.concat(F.lit("http://x/"), "id")).alias("s"),
        F.lit("http://x/p").alias("p"), literal(F.col("id").cast("string"), V.INTEGER).alias("o"),
    )
    cut = lineage.cut_lineage(rows)
    assert cut.columns == rows.columns and cut.exceptAll(rows).count() == 0 and cut.count() == 20_000
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert 0 < size < 20_000 * 60  # a row takes about 300 bytes as it is


def test_reasons_are_found_without_reading_quads(spark):
    docs = ["prose", '{"http://x/p":1}', '{"@context":"http://remote"}', '{"\\u0040context":{},"\\u0040list":[1]}', "[5]", "5"]
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "msg_id string, raw string")
    _, bad = J.read_messages(df)
    assert "_q0" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert {r["msg_id"]: r["bad"] for r in bad.collect()} == {
        "0": J.BAD_JSON, "2": J.BAD_CONTEXT, "3": J.BAD_KEYWORD, "4": J.BAD_ROOT, "5": J.BAD_JSON}

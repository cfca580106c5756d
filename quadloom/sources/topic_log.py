"""A topic sink with commits, as a Spark data source named ``topic_log``.

Tasks write Parquet files and answer with a commit message; the driver turns the messages of a batch into
one small commit file. Only files that a commit names are read. A commit is kept under the name of its
query and batch, so a batch that runs again after a crash, before or after its commit, leaves each message
once: files without a commit are never read, and those of a second run are taken away.

Paths are opened through ``pyarrow.fs``, so tasks and driver need a folder that all of them reach.

Rows have ``topic`` and ``value``, and may have ``channel_uuid`` and ``start_ms``; other columns are not
published. A stored row also has the time its task wrote it (``end_ms``) and its place. Defined cases: null
topics and values are kept as nulls; equal rows are all kept; an empty batch is committed without files.
"""

from __future__ import annotations

import json
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "topic_log"
GIVEN = {"topic": pa.string(), "value": pa.string(), "channel_uuid": pa.string(), "start_ms": pa.int64()}
STORED_DDL = "topic string, value string, channel_uuid string, start_ms bigint, end_ms bigint, nth bigint"
COMMIT_DDL = "query string, batch bigint, file string, part int, rows bigint, base bigint"


class Written(WriterCommitMessage):
    """What a task wrote: its part of the batch, the file and the number of its rows."""

    def __init__(self, query: str | None, part: int, file: str | None, rows: int):
        self.query, self.part, self.file, self.rows = query, part, file, rows


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else "file://" + path)


class _Log:
    """Files and commits of one log."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write_part(self, batches, query: str | None = None) -> Written:
        """All rows of a task in one file, which nobody reads before the commit."""
        context = TaskContext.get()
        part, query = context.partitionId(), query or context.getLocalProperty("sql.streaming.queryId")
        store, root = _store(self.path)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                n = batch.num_rows
                cols = {c: batch.column(c).cast(k) if c in batch.schema.names else pa.nulls(n, k) for c, k in GIVEN.items()}
                cols["end_ms"] = pa.array([int(time.time() * 1000)] * n, pa.int64())
                cols["nth"] = pa.array(range(rows, rows + n), pa.int64())
                table = pa.table(cols)
                if out is None:
                    store.create_dir(f"{root}/data")
                    out = pq.ParquetWriter(f"{root}/data/{name}", table.schema, filesystem=store)
                out.write_table(table)
                rows += n
        finally:
            if out is not None:
                out.close()
        return Written(query, part, name if rows else None, rows)

    def drop(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/data/{m.file}")

    def publish(self, messages, query: str, batch: int) -> None:
        """One commit of the batch, unless it has one already."""
        store, root = _store(self.path)
        target = f"{root}/commits/{query}-{batch}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            self.drop(messages)
            return
        lines, base = [], 0
        for m in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.part):
            lines.append({"query": query, "batch": batch, "file": m.file, "part": m.part, "rows": m.rows, "base": base})
            base += m.rows
        store.create_dir(f"{root}/commits")
        # readers skip names that begin with an underscore
        draft = f"{root}/commits/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        store.move(draft, target)


class _BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.log, self.query, self.batch = _Log(options), options["query"], int(options["batch"])

    def write(self, iterator):
        return self.log.write_part(iterator, self.query)

    def commit(self, messages):
        self.log.publish(messages, self.query, self.batch)

    def abort(self, messages):
        self.log.drop(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def write(self, iterator):
        return self.log.write_part(iterator)

    def commit(self, messages, batchId):
        if messages:
            self.log.publish(messages, messages[0].query, batchId)

    def abort(self, messages, batchId):
        self.log.drop(messages)


class TopicLog(DataSource):
    """``df.write.format("topic_log")`` with ``path``, ``query`` and ``batch``, in append mode, or
    ``df.writeStream.format("topic_log")`` with ``path``, where Spark names query and batch."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _checked(self, schema, *needed: str) -> dict:
        missing = [c for c in ("topic", "value") if c not in schema.names] + [o for o in ("path", *needed) if o not in self.options]
        if missing:
            raise ValueError("a topic log needs " + ", ".join(missing))
        return dict(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a topic log is only appended to")
        return _BatchWriter(self._checked(schema, "query", "batch"))

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self._checked(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)


def log_rows(docs: DataFrame) -> DataFrame:
    """Translated documents as rows of a log. A message's time starts where it came in."""
    return docs.select(F.col("sink").alias("topic"), F.col("raw").alias("value"), "channel_uuid", F.unix_millis("ingest_ts").alias("start_ms"))


def in_order(docs: DataFrame, parallelism: int) -> DataFrame:
    """Documents of a batch in source order over ``parallelism`` tasks: ranges of partition and offset, so a
    source partition with most messages is shared by several tasks. A log numbers them through."""
    return docs.repartitionByRange(max(1, parallelism), "src_partition", "src_offset").sortWithinPartitions("src_partition", "src_offset")


def append(docs: DataFrame, path: str, query: str, batch: int, parallelism: int | None = None) -> None:
    """Publish the documents of one batch, in source order if ``parallelism`` is given."""
    register(docs.sparkSession)
    rows = log_rows(docs if parallelism is None else in_order(docs, parallelism))
    rows.write.format(FORMAT).mode("append").option("path", path).option("query", query).option("batch", str(batch)).save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Committed rows: ``topic, value, channel_uuid, start_ms, end_ms, query, batch, position``, the last
    without gaps from 0 in each batch."""
    commits = spark.read.schema(COMMIT_DDL).json(f"{path}/commits").select("query", "batch", "file", "base")
    # names alone, as Spark lists the files of any table
    files = [f"{path}/data/{r['file']}" for r in commits.select("file").toLocalIterator()]
    if files:
        rows = spark.read.schema(STORED_DDL).parquet(*files).withColumn("file", F.col("_metadata.file_name"))
    else:
        rows = spark.createDataFrame([], STORED_DDL + ", file string")
    placed = rows.join(commits, "file").withColumn("position", F.col("base") + F.col("nth"))
    return placed.select("topic", "value", "channel_uuid", "start_ms", "end_ms", "query", "batch", "position")


def latency(log: DataFrame) -> DataFrame:
    """``channel_uuid, start_ms, end_ms`` of each published message: its own times, not its batch's."""
    return log.where("start_ms is not null").select("channel_uuid", "start_ms", "end_ms")


def retained(log: DataFrame) -> DataFrame:
    """The message that each topic keeps: the last one published by its query."""
    newest = F.max_by("value", F.struct("batch", "position"))
    return log.groupBy("query", "topic").agg(newest.alias("value"))

"""From raw documents to packed sequences: toxicity, near-duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives the documents it keeps, with the columns they came
with, whatever their names; the last gives the packed pieces with their tokens. Rows without an id or a
text pass the filters: nothing speaks against them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import decontaminate, near_dups, packing, toxicity
from quadloom.llm.common import free_name, read_table, stored


#: Documents that Spark and its Python workers exchange at a time. Both sides hold a batch, of texts of some
#: kilobytes each, so Spark's 10,000 would take a fifth of an executor's memory.
BATCH = 1000
#: Words that a worker remembers while packing; fewer than packing alone would, since the heap is full by then.
REMEMBERED = 300_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    small_batches(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: five words a shingle, similarity 0.8."""
    small_batches(spark)
    return near_dups.drop_near_duplicates(docs, width=5, percent=80, block=16).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; what is mostly such passages goes."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its place in a sequence and its ids (little-endian, 32 bits)."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, with_ids=True, remembered=REMEMBERED)


STAGES = [("toxicity", drop_toxic), ("near_dups", drop_near_duplicates), ("decontaminate", cut_benchmark), ("packing", pack)]

#: SQL has no lattice decoding and no tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

"""Token counts of whole texts, in the scan itself.

A text is cut where no piece of the vocabulary can reach across: before a space that follows another
character, and around line ends. Lengths of these pre-tokens add up to the length of the text, so two
tables serve nearly all of them: one of frequent pre-tokens, counted over all texts and broadcast as one
blob of keys and one of lengths, and one per worker that remembers what it had to encode. Of the
pre-tokens only each task's most frequent are shuffled, with their counts, and the tables change nothing
but the time taken.

Defined cases: a null or empty text has 0 tokens; control strings inside a text are ordinary text, as
the library has it by default; a text of any length is counted whole; rows are independent, so repeated
rows give repeated results and other columns, whatever their names, are passed on untouched.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import utf8

#: Entries of the table of frequent pre-tokens, at most, and those a task counts before it drops the rarest.
FREQUENT = 50_000
COUNTED = 400_000
#: Entries of a worker's own table, after which it starts anew, and bytes of the longest key kept.
WORKER_ENTRIES = 400_000
LONGEST_KEY = 64

RUNS = re.compile(rb"\n[^ \n]*| +[^ \n]*")
MARK = "▁".encode()


@lru_cache(maxsize=4)
def encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if "\n" in p or re.search("[^▁]▁", p)]
    if crossing:
        raise ValueError(f"pieces such as {crossing[0]!r} reach across pre-tokens: this vocabulary can't be counted by parts")
    return model


def pre_tokens(text: bytes) -> list[bytes]:
    """Keys of the pre-tokens of a text: one leading space left out, a leading line end kept."""
    if MARK in text:  # the library's own sign for a space
        text = text.replace(MARK, b" ")
    keys = (b" " + text.replace(b"\n", b" \n")).split(b" ")
    del keys[0]
    if b"" in keys:  # runs of spaces are pre-tokens with what follows them
        keys = [k[1:] if k[0] == 32 else k for k in RUNS.findall(b" " + text)]
    return keys


class Lengths(dict):
    """Lengths of frequent pre-tokens; others come from the worker's table or are encoded."""

    def __init__(self, frequent: dict[bytes, int], path: str):
        super().__init__(frequent)
        self.own: dict[bytes, int] = {}
        self.encode = encoder(path).encode

    def __missing__(self, key: bytes) -> int:
        n = self.own.get(key)
        if n is None:
            # after a line end nothing joins: two tokens, then those of the pre-token
            part = key if key[:1] == b"\n" else b" " + key
            n = len(self.encode("\n" + part.decode("utf-8", "replace"))) - 2
            if len(key) <= LONGEST_KEY:
                if len(self.own) >= WORKER_ENTRIES:
                    self.own.clear()
                self.own[key] = n
        return n

    def count(self, text: bytes | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def frequent_table(docs: DataFrame, path: str, text: str = "text") -> tuple[bytes, bytes]:
    """Keys and lengths of the most frequent pre-tokens of all documents."""

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                if t := t.as_py():
                    counts.update(k for k in pre_tokens(t) if 0 < len(k) <= LONGEST_KEY and b" " not in k)
                    if len(counts) > COUNTED:
                        counts = Counter(dict(counts.most_common(FREQUENT)))
        top = counts.most_common(FREQUENT)
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in top], pa.binary()), "n": pa.array([c for _, c in top], pa.int64())})

    counted = docs.select(utf8(text).alias("text")).mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = [bytes(r["key"]) for r in counted.orderBy(F.col("n").desc(), "key").limit(FREQUENT).collect()]
    lengths = Lengths({}, path)
    pairs = [(k, n) for k in keys if (n := lengths[k]) < 256]
    return b" ".join(k for k, _ in pairs), bytes(n for _, n in pairs)


#: The worker's tables, of the call they were last made for.
_tables: dict[tuple[str, str], Lengths] = {}


def counter(spark: SparkSession, path: str, frequent: tuple[bytes, bytes] = (b"", b"")):
    """A column function from text to its number of tokens."""
    table = spark.sparkContext.broadcast(frequent)
    key = (path, uuid.uuid4().hex)

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        if key not in _tables:
            _tables.clear()
            keys, lengths = table.value
            _tables[key] = Lengths(dict(zip(keys.split(b" "), lengths, strict=True)) if lengths else {}, path)
        count = _tables[key].count
        return pa.array([count(t.as_py()) for t in texts], pa.int64())

    def of(text: str | Column) -> Column:
        return n_tokens(utf8(text))

    return of


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``, which replace columns of these names."""
    of = counter(docs.sparkSession, path, frequent_table(docs, path, text))
    out = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": of(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

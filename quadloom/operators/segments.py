"""Documents of messages of any size, as ordered pieces of text.

A document of a message is one text, which a row holds only while the message is small. Here quads are put
in the order of their document by a range partitioning over message, graph, subject, predicate and value,
so one message, or one property with many values, spreads over as many tasks as its rows fill. What a
quad adds to the text depends on the quad before it. Where that stands in another task, a table with a
row for each message and task has it. Prefix sums of lengths over the same table give each quad its place,
and places give pieces of about equal size. Only a piece is ever gathered, and a longer one only where one value is longer.

* ``write_segments``: pieces that, put together in order, are the document.
* ``write_pieces``: pieces that are documents of their own, with the message's id. Tasks read them apart from each
  other, and the union of their quads is the message: ``jsonld.jsonld_to_quads`` takes these rows as they are.

Defined cases: repeated quads, and values with the same text, count once, as graphs are sets; a message without quads gives one piece, if ``msgs``
names it; an empty table gives no row; a null ``msg_id`` is a message like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadloom import vocab as V
from quadloom.operators.jsonld import _label, _quote, _value_json
from quadloom.plans.lineage import cut_lineage

#: Bytes of a piece, and those that brackets and keys of a quad add at most to its own.
PIECE_BYTES = 1 << 20
AROUND = 32

_PLACE = ["named", "g", "s", "p", "v"]
EMPTY = '{"@graph":[]}'


def _ordered(quads: DataFrame, partitions: int | None) -> DataFrame:
    """Distinct quads in document order: ``msg_id, named, g, s, p, v, task``, sorted by task and, inside, by the rest."""
    rows = quads.select("msg_id", (F.col("g") != V.DEFAULT_GRAPH).alias("named"), "g", "s", "p", _value_json(F.col("o")).alias("v")).distinct()
    keys = ["msg_id", *_PLACE]
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return rows.withColumn("task", F.spark_partition_id())


def _closing(q: Column) -> Column:
    """What ends the graph that ``q`` is the last quad of."""
    return F.when(q["named"], F.concat(F.lit(']}],"@id":'), _quote(q["g"]), F.lit("}"))).otherwise(F.lit("]}"))


def _text(before: Column, last: Column) -> Column:
    """What a quad adds to the text, after the quad ``before`` (NULL at the start)."""
    same_graph = F.coalesce(before["g"] == F.col("g"), F.lit(False))
    same_node = same_graph & (before["s"] == F.col("s"))
    same_property = same_node & (before["p"] == F.col("p"))
    end = (
        F.when(before.isNull(), F.lit('{"@graph":['))
        .when(same_property, F.lit(","))
        .when(same_node, F.lit("],"))
        .when(same_graph, F.lit("]},"))
        .otherwise(F.concat(_closing(before), F.lit(",")))
    )
    graph = F.when(~same_graph & F.col("named"), F.lit('{"@graph":[')).otherwise(F.lit(""))
    node = F.when(same_node, F.lit("")).otherwise(F.concat(F.lit('{"@id":'), _quote(_label(F.col("s"))), F.lit(",")))
    prop = F.when(same_property, F.lit("")).otherwise(F.concat(_quote(F.col("p")), F.lit(":[")))
    this = F.struct("named", "g")
    tail = F.when(last, F.concat(_closing(this), F.lit("]}"))).otherwise(F.lit(""))
    return F.concat(end, graph, node, prop, F.col("v"), tail)


def _key() -> Column:
    return F.struct(*_PLACE)


def _with_carry(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of a row for each message and task. A null id is joined, too."""
    table = table.withColumnsRenamed({"msg_id": "_m", "task": "_t"})
    return rows.join(table, F.col("msg_id").eqNullSafe(F.col("_m")) & (F.col("task") == F.col("_t"))).drop("_m", "_t")


def _numbered(rows: DataFrame, length: Column, piece_bytes: int) -> DataFrame:
    """``rows`` with ``at``, the bytes of their message before them, and ``piece``."""
    rows = rows.withColumn("length", length)
    sums = rows.groupBy("msg_id", "task").agg(F.sum("length").alias("bytes"))
    earlier = Window.partitionBy("msg_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("msg_id", "task", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("carried"))
    mine = Window.partitionBy("msg_id", "task").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("length").over(mine), F.lit(0)))
    at = F.col("carried") + F.col("own")
    return _with_carry(rows, sums).withColumn("at", at).withColumn("piece", F.floor(F.col("at") / piece_bytes)).drop("carried", "own", "length")


def _gathered(rows: DataFrame) -> DataFrame:
    """``msg_id, piece, raw``: pieces numbered from 0 without gaps."""
    parts = rows.groupBy("msg_id", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    # a long value may span the places of several pieces, which stay empty
    number = F.row_number().over(Window.partitionBy("msg_id").orderBy("piece")) - 1
    return parts.select("msg_id", number.cast("long").alias("piece"), F.array_join(F.col("parts.text"), "").alias("raw"))


def _with_empty(pieces: DataFrame, quads: DataFrame, msgs: DataFrame | None) -> DataFrame:
    if msgs is None:
        return pieces
    known = quads.select(F.col("msg_id").alias("_m")).distinct()
    empty = msgs.select("msg_id").distinct().join(known, F.col("msg_id").eqNullSafe(F.col("_m")), "left_anti")
    return pieces.unionByName(empty.select("msg_id", F.lit(0).cast("long").alias("piece"), F.lit(EMPTY).alias("raw")))


def write_segments(quads: DataFrame, msgs: DataFrame | None = None, piece_bytes: int = PIECE_BYTES, partitions: int | None = None, cut=cut_lineage) -> DataFrame:
    """``msg_id, piece, raw``: the text of each message's document, cut into pieces in order."""
    rows = cut(_ordered(quads, partitions))
    mine = Window.partitionBy("msg_id", "task").orderBy(*_PLACE)
    through = Window.partitionBy("msg_id").orderBy("task")
    edges = rows.groupBy("msg_id", "task").agg(F.max(_key()).alias("end"))
    edges = edges.select("msg_id", "task", F.lag("end").over(through).alias("carry"), F.lead("task").over(through).isNull().alias("final"))
    rows = rows.withColumn("before", F.lag(_key()).over(mine)).withColumn("ends", F.lead("v").over(mine).isNull())
    rows = _with_carry(rows, edges)
    text = _text(F.coalesce("before", "carry"), F.col("ends") & F.col("final"))
    # written, so that the prefix sums and the pieces start from the same texts
    rows = cut(rows.select("msg_id", "task", *_PLACE, text.alias("text")))
    return _with_empty(_gathered(_numbered(rows, F.octet_length("text"), piece_bytes)), quads, msgs)


def write_pieces(quads: DataFrame, msgs: DataFrame | None = None, piece_bytes: int = PIECE_BYTES, partitions: int | None = None, cut=cut_lineage) -> DataFrame:
    """``msg_id, piece, raw``: documents whose quads together are those of the message."""
    length = sum((F.octet_length(c) for c in (F.col("s")["value"], F.col("p"), F.col("v"))), F.lit(AROUND))
    rows = _numbered(cut(_ordered(quads, partitions)), length, piece_bytes)
    mine = Window.partitionBy("msg_id", "piece").orderBy("at")
    rows = rows.withColumn("before", F.lag(_key()).over(mine)).withColumn("ends", F.lead("at").over(mine).isNull())
    return _with_empty(_gathered(rows.select("msg_id", "piece", "at", _text(F.col("before"), F.col("ends")).alias("text"))), quads, msgs)


def join_segments(pieces: DataFrame) -> DataFrame:
    """``msg_id, raw`` from pieces: for messages known to fit a row."""
    whole = F.array_sort(F.collect_list(F.struct("piece", "raw")))
    return pieces.groupBy("msg_id").agg(F.array_join(whole["raw"], "").alias("raw"))

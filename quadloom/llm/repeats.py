"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays of shards.

A window is ``span`` consecutive bytes of a text. Equal windows must meet in one shard, whatever texts they
are from, and no shard may grow with the corpus:

* Every window names an anchor, the gram inside it with the least hash (the first of equals). That depends on
  the window's bytes alone, so equal windows have equal anchors, at the same distance. The windows of one
  anchor are consecutive; their bytes are a segment of at most twice the span.
* Grams that are an anchor once in the corpus are dropped. Segments that occur twice as a whole repeat in all
  their windows. The others are open, and distinct segments of their gram meet in a shard.
* A gram with more than GROUP distinct segments (a passage in front of which each document says something
  else) is cut by where windows lie around the anchor, and keyed by the bytes that all windows of a cut
  share, until no group is larger; a cut of one window has one content.
* Shards are groups up to SHARD bytes. Each gets its suffix array by induced sorting and the permuted common
  prefixes; a window that shares ``span`` bytes with a neighbour repeats.

Which windows to look at twice is told to the second reading by a bit table of fixed size, which lets through
too much and never too little. Texts are named by 128 bits of hashes, so copies share their findings;
segments and grams by 64 each.

Defined cases: null texts are empty; texts shorter than the span have no window; matches never cross texts;
copies of a text, repeated rows included, repeat each other; a string that overlaps its own repetition repeats;
bytes are judged on the input, not on what is left; an empty table gives no row; other columns are passed on,
and lose to the new ones where they clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import stored, utf8
from quadloom.llm.suffix_array import repeated

SPAN = 200
#: Distinct segments of a group, and bytes of a shard that begins no further group.
GROUP = 512
SHARD = 1 << 18
#: Cuts that a large group is divided into at a time.
CUTS = 8
#: Bits, as a power of two, of the table of repeated grams.
BITS = 27
#: Windows looked at together, grams a task counts, and anchors sent in one batch.
STRETCH = 1 << 22
COUNTED = 1 << 21
SENT = 1 << 18

PIECE = "key long, c long, whole boolean, t1 long, t2 long, p int, low int, high int, first int, last int, bytes binary"
SPANS = "t1 long, t2 long, start int, end int"
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def gram_size(span: int) -> int:
    """The largest power of two within a third of the span."""
    return 1 << max(0, (span // 3).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each gram of bytes, from those of its halves."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    size, base = 1, 0x85EBCA6B
    while size < gram:
        h = h[:-size] * np.uint32(base) + h[size:]
        base = base * base & 0xFFFFFFFF
        size *= 2
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(13)
    return h


def anchors(data: bytes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(gram, first window, last window)`` of each anchor, as starts."""
    found = []
    for at in range(0, len(data) - span + 1, STRETCH):
        h = gram_hashes(np.frombuffer(data, np.uint8, min(len(data) - at, STRETCH + span - 1), at), gram)
        least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        width, size = span - gram + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        found.append((place[low] + at, low + at, np.append(low[1:], len(place)) - 1 + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def hashes_at(data: bytes, starts: list[int], size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[p : p + size]) for p in starts], np.uint64).view(np.int64)


def named(docs: DataFrame, text: str, span: int) -> DataFrame:
    """``t1, t2, data`` of texts that have a window."""
    data = utf8(text)
    return docs.where(F.octet_length(data) >= span).select(F.xxhash64(data).alias("t1"), F.xxhash64(F.lit("second"), data).alias("t2"), data.alias("data"))


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def repeated_grams(texts: DataFrame, span: int) -> DataFrame:
    """``h`` of grams that are an anchor twice."""
    gram = gram_size(span)

    def count(batches):
        parts, size = [], 0

        def counted():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                parts.append(hashes_at(data, anchors(data, span, gram)[0].tolist(), gram))
                size += len(parts[-1])
                if size > COUNTED:
                    yield counted()
                    parts, size = [], 0
        if parts:
            yield counted()

    return texts.select("data").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Words of the table of hashes; BITS bounds what the driver gets."""
    bit = F.col("h").bitwiseAND((1 << BITS) - 1)
    words = hashes.select(F.shiftright(bit, 6).alias("w"), F.expr("1L").alias("one"), bit.bitwiseAND(63).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def find_anchors(texts: DataFrame, table: np.ndarray, span: int) -> DataFrame:
    """Anchors whose gram may repeat: hashes ``h`` of the gram and ``c`` of the segment, the text, places."""
    gram, shared = gram_size(span), texts.sparkSession.sparkContext.broadcast(table)
    names = ["h", "c", "t1", "t2", "p", "low", "high"]
    kinds = [np.int64] * 4 + [np.int32] * 3

    def find(batches):
        bits, digest = shared.value, xxhash.xxh64_intdigest
        done, size = [], 0

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for b in batches:
            for t1, t2, data in zip(*(b.column(c) for c in ("t1", "t2", "data")), strict=True):
                data = data.as_py()
                p, low, high = anchors(data, span, gram)
                h = hashes_at(data, p.tolist(), gram)
                at = h & ((1 << BITS) - 1)
                hit = (bits[at >> 6] >> (at & 63)) & 1 == 1
                if not hit.any():
                    continue
                h, p, low, high = h[hit], p[hit], low[hit], high[hit]
                # windows before the anchor tell a segment from one with the same bytes
                c = [digest(data[x : y + span], z - x) for x, y, z in zip(low.tolist(), high.tolist(), p.tolist(), strict=True)]
                done.append((h, np.array(c, np.uint64).view(np.int64), np.full(len(h), t1.as_py()), np.full(len(h), t2.as_py()), p, low, high))
                size += len(h)
                if size > SENT:
                    yield sent()
                    done, size = [], 0
        if done:
            yield sent()

    return texts.mapInArrow(find, "h long, c long, t1 long, t2 long, p int, low int, high int")


def kinds_of(pieces: DataFrame, key: str) -> DataFrame:
    """``key, c`` with how often the content occurs (``n``), the least name of an occurrence (``r``), and of its
    key how many contents there are (``kinds``) and how often the rarest occurs (``least``)."""
    weight = F.when(F.col("whole"), 2).otherwise(1) if "whole" in pieces.columns else F.lit(1)
    each = stored(pieces.groupBy(key, "c").agg(F.sum(weight).alias("n"), F.min(F.xxhash64("t1", "t2", "low")).alias("r")), "contents")
    per = each.groupBy(key).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.min("n").alias("least")).where("all > 1")
    return stored(each.join(per.drop("all"), key), "kinds")


def ranges(pieces: DataFrame, span: int) -> DataFrame:
    return pieces.select("t1", "t2", F.col("low").alias("start"), (F.col("high") + span).alias("end"))


def pieces_of(found: DataFrame, kinds: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """One segment for each distinct content of grams with an open one, with its bytes."""
    width = span - gram_size(span) + 1
    need = kinds.where("kinds > 1 and least = 1").select("h", "c", "r", (F.col("n") > 1).alias("whole"))
    one = found.withColumn("r", F.xxhash64("t1", "t2", "low")).join(need, ["h", "c", "r"])
    wanted = one.groupBy("t1", "t2").agg(F.collect_set(F.struct("h", "c", "whole", "p", "low", "high")).alias("of"))
    bytes_ = F.substring("data", F.col("x.low") + 1, F.col("x.high") - F.col("x.low") + span)
    cut = texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "data", F.explode("of").alias("x"))
    cut = cut.select(F.col("x.h").alias("key"), "x.c", "x.whole", "t1", "t2", "x.p", "x.low", "x.high", F.lit(1 - width).alias("first"), F.lit(0).alias("last"), bytes_.alias("bytes"))
    return stored(one_each(cut), "pieces")  # copies of a text gave the same


def one_each(pieces: DataFrame) -> DataFrame:
    """One piece for each key and content."""
    rest = [c for c in pieces.columns if c not in ("key", "c")]
    return pieces.groupBy("key", "c").agg(F.first(F.struct(*rest)).alias("x")).select("key", "c", "x.*")


def divided(pieces: DataFrame, span: int) -> DataFrame:
    """Pieces cut by where their windows lie around the anchor, keyed by what all windows of a cut share."""

    def cut(batches):
        digest = xxhash.xxh64_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            rows = []
            for r in b.to_pylist():
                size = -(-(r["last"] - r["first"] + 1) // CUTS)
                for first in range(r["first"], r["last"] + 1, size):
                    last = min(first + size - 1, r["last"])
                    p, at = r["p"], r["low"]
                    low, high = max(at, p + first), min(r["high"], p + last)
                    if low <= high:
                        shared = r["bytes"][p + last - at : p + first + span - at]
                        own = r["bytes"][low - at : high - at + span]
                        rows.append((signed(digest(shared, 1 + last - first + span * -last)), signed(digest(own, p - low)), r["whole"], r["t1"], r["t2"], p, low, high, first, last, own))
            yield batch_of(rows, PIECE)

    return pieces.mapInArrow(cut, PIECE)


def bounded_groups(pieces: DataFrame, span: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces in groups of at most GROUP, and ranges found to repeat on the way."""
    parts, marks = [], []
    while True:
        large = stored(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "large")
        if large.isEmpty():
            parts.append(pieces)
            break
        parts.append(pieces.join(large, "key", "left_anti"))
        own = stored(divided(pieces.join(large, "key").select(pieces.columns), span), "cuts")
        kinds = kinds_of(own, "key")
        again = own.join(kinds.where("n > 1").select("key", "c"), ["key", "c"]).where("not whole")
        marks.append(ranges(again, span))
        need = kinds.where("kinds > 1 and least = 1").select("key", "c", "r", (F.col("n") > 1).alias("w"))
        left = own.withColumn("r", F.xxhash64("t1", "t2", "low")).join(need, ["key", "c", "r"]).withColumn("whole", F.col("w"))
        pieces = stored(one_each(left.select(pieces.columns)), "pieces")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, marks


def sorted_shards(pieces: DataFrame, span: int) -> DataFrame:
    """Ranges of open pieces that repeat, by the suffix arrays of their shards."""

    def sort(batches):
        held, size, last = [], 0, None
        for b in batches:
            for r in zip(*(b.column(c) for c in ("key", "whole", "t1", "t2", "low", "high", "bytes")), strict=True):
                key, *r = (x.as_py() for x in r)
                if size >= SHARD and key != last:
                    yield batch_of(shard(held, span), SPANS)
                    held, size = [], 0
                held.append(r)
                size += len(r[-1]) + 1
                last = key
        if held:
            yield batch_of(shard(held, span), SPANS)

    own = pieces.select("key", "whole", "t1", "t2", "low", "high", "bytes").repartition("key").sortWithinPartitions("key")
    return own.mapInArrow(sort, SPANS)


def shard(rows: list, span: int) -> list[tuple[int, int, int, int]]:
    """``(t1, t2, start, end)`` of the stretches of windows in open pieces that stand elsewhere in the shard."""
    text = np.frombuffer(b"\0".join([r[-1] for r in rows]) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum([len(r[-1]) + 1 for r in rows])
    text[ends - 1] = 1
    hit = repeated(np.append(text, 0), span)
    out = []
    for (whole, t1, t2, low, high, data), end in zip(rows, ends.tolist(), strict=True):
        if not whole:
            at = end - 1 - len(data)
            own = np.concatenate([[False], hit[at : at + high - low + 1], [False]])
            for a, b in np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2).tolist():
                out.append((t1, t2, low + a, low + b - 1 + span))
    return out


def find_spans(docs: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """``t1, t2, spans``: for each distinct text with any, the byte ranges of windows that repeat."""
    texts = named(docs, text, span)
    table = bit_table(repeated_grams(texts, span))
    found = stored(find_anchors(texts, table, span), "anchors")
    kinds = kinds_of(found, "h")
    whole = ranges(found.join(kinds.where("n > 1").select("h", "c"), ["h", "c"]), span)
    pieces, marks = bounded_groups(pieces_of(found, kinds, texts, span), span)
    all_ = sorted_shards(pieces, span)
    for part in [whole, *marks]:
        all_ = all_.unionByName(part)
    return stored(all_.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of the bytes, and how many stretches went."""
    kept, done, n, at = [], 0, 0, -1
    for start, end in sorted(spans):
        if start > at:
            kept.append(data[done:start])
            n += 1
        at = max(at, end)
        done = at
    return b"".join([*kept, data[done:]]), n


def remove_repeats(docs: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that are left of the text."""
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    spans = find_spans(docs, text, span)

    @F.arrow_udf("kept binary, n long")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        kept, n = [], []
        for data, own in zip(texts, ranges.to_pylist(), strict=True):
            got = (None, 0) if own is None else without(data.as_py(), [(x["start"], x["end"]) for x in own])
            kept.append(got[0])
            n.append(got[1])
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(n, pa.int64())], ["kept", "n"])

    rest = [c for c in docs.columns if c not in new]
    data: Column = F.coalesce(utf8(text), F.lit(b""))
    held = docs.select(F.struct(*rest).alias("row"), data.alias("data"))
    short = held.where(F.octet_length("data") < span).select("row", "data", F.lit(None).cast("struct<kept:binary,n:bigint>").alias("c"))
    long = held.where(F.octet_length("data") >= span).withColumns({"t1": F.xxhash64("data"), "t2": F.xxhash64(F.lit("second"), "data")})
    long = long.join(spans, ["t1", "t2"], "left")
    long = long.select("row", "data", cut.asNondeterministic()(F.when(F.col("spans").isNotNull(), F.col("data")), "spans").alias("c"))
    both = short.unionByName(long)
    size, kept = F.octet_length("data").cast("long"), F.coalesce("c.kept", "data")
    return both.select(*(F.col("row")[c].alias(c) for c in rest), size.alias("n_bytes"), (size - F.octet_length(kept)).cast("long").alias("n_removed"), F.coalesce("c.n", F.lit(0)).cast("long").alias("n_spans"), kept.alias("kept"))

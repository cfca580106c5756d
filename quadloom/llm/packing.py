"""Packing of token sequences by best-two-fit.

Documents are tokenized where they are read and cut into pieces of at most ``capacity`` tokens. Which
pieces share a sequence depends on their lengths alone, so the packing is computed over the counts of
lengths (at most ``capacity`` numbers, whatever the size of the corpus) as patterns, each used by many
sequences: take the largest length left, fill greedily with the largest that fits, then replace the
smallest piece of the pattern by two unpacked ones that fill its place and the gap more tightly, as long
as that helps. Pieces of one length are interchangeable: each gets a number among its like from counts
per task, and the pattern and place that this number stands for. Nothing but counts goes to the driver.

Defined cases: a null or empty text is its end token alone; control strings inside texts are handled as
the tokenizer has it by default; a document of exactly ``capacity`` tokens is not cut; repeated rows are
packed each; an empty table gives no piece; columns of the input are not passed on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import Recent, held, stored, utf8

CAPACITY = 4096
END_ID = 1
#: Encoded words that a worker remembers in each of two generations (about 190 bytes a word), and the longest of them.
REMEMBERED = 700_000
LONGEST_KEY = 64
#: Bytes of ids that a task holds before it sends them on.
SENT = 1 << 22

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Encoder:
    """Ids of a text as bytes (little-endian, 32 bits), word by word through a table.

    Words stand between ASCII white space, which the tokenizer drops and never joins across. A text with
    a control string is encoded whole, since those are looked for before words. The tokenizer lowers letters, so
    words are remembered in lower case."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Recent(remembered)
        self.control = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, encoded as one text and parted after each token that ends a word."""
        if not words:
            return []
        ids = np.frombuffer(self._encode([b" ".join(words)])[0], "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):  # a letter that its lower case takes apart
            return self._encode(words)
        raw, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _fresh(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not met lately."""
        stems, rest = [], []
        for w in new:
            # a letter before a single mark: the tokenizer cuts between them
            (stems if w[-1] in b".," and w[-2:-1].isalpha() else rest).append(w)
        found: dict[bytes, bytes] = {}
        if stems:
            parts = {w[:-1] for w in stems}.union((b".", b","))
            found = {p: x for p in parts if (x := self.known.find(p)) is not None}
            rest += parts.difference(found, rest)
        letters = [w for w in rest if w.isalpha() or w.decode("utf-8", "replace").isalpha()]
        others = list(set(rest).difference(letters))
        found.update(zip(letters, self._encode_words(letters), strict=True))
        found.update(zip(others, self._encode(others), strict=True))
        for w in stems:
            found[w] = found[w[:-1]] + found[w[-1:]]
        return found

    def of(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in self.control):
            return self._encode([text])[0]
        if b"\xcc" not in text and b"\xcd" not in text:  # no accent of its own that a letter's case may decide on
            text = text.lower()
        words = text.split()
        got = list(map(self.known.young.get, words))
        if None in got:
            missing = {w for w, x in zip(words, got, strict=True) if x is None}
            found = {w: x for w in missing if (x := self.known.old.get(w)) is not None}
            if len(found) < len(missing):
                found |= self._fresh([w for w in missing if w not in found])
            got = [found[w] if x is None else x for w, x in zip(words, got, strict=True)]
            for w, x in found.items():
                if len(w) <= LONGEST_KEY:
                    self.known.keep(w, x)
        return b"".join(got)


def cut_pieces(docs: DataFrame, path: str, capacity: int, key: str, text: str, with_ids: bool,
               remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents, with the number of each among those of its length in its task."""
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batches):
        of = held(("packing", path, remembered), lambda: Encoder(path, remembered)).of
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows, size = [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = of(body.as_py()) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    size += len(own)
                    length = len(own) // 4
                    rows.append((doc, n, at // 4, length, zlib.crc32(own), part, seen[length]) + (own,) * with_ids)
                    seen[length] += 1
                if with_ids and size > SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(key).cast("long"), utf8(text)).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def two_fit(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths with anything left whose sum is largest, above ``more_than`` and within ``room``."""
    at_most = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    a = np.flatnonzero(left[: min(room, len(left))])
    if not len(a):
        return None
    b = at_most[np.minimum(room - a, len(left) - 1)]
    alone = (b == a) & (left[a] < 2)
    b = np.where(alone, at_most[a - 1], b)
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    return (int(a[best]), int(b[best])) if total[best] > more_than else None


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``({length: times}, sequences)`` for all pieces, each filled by best-two-fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        use: dict[int, int] = {}
        gap = capacity
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            length = int(fits[-1])
            n = min(gap // length, int(left[length])) if use else 1
            use[length] = use.get(length, 0) + n
            left[length] -= n
            gap -= n * length
        while gap and sum(use.values()) > 1:
            small = min(use)
            pair = two_fit(left, gap + small, small)
            if pair is None:
                break
            use[small] -= 1
            left[small] += 1
            if not use[small]:
                del use[small]
            for x in pair:
                use[x] = use.get(x, 0) + 1
                left[x] -= 1
            gap += small - sum(pair)
        # the same pattern again, as often as there are pieces for it
        times = 1 + min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * (times - 1)
        out.append((use, times))
    return out


class Places:
    """Sequence and offset for the n-th piece of each length."""

    def __init__(self, found: list[tuple[dict[int, int], int]]):
        spots: dict[int, list[tuple[int, int, int, int]]] = {}
        given: dict[int, int] = {}
        first = 0
        for use, times in found:
            at = 0
            for length in sorted(use, reverse=True):
                n = use[length]
                spots.setdefault(length, []).append((given.get(length, 0), n, first, at))
                given[length] = given.get(length, 0) + n * times
                at += n * length
            first += times
        self.spots = {k: np.array(v, np.int64) for k, v in spots.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            spots, length = self.spots[int(lengths[own[0]])], lengths[own[0]]
            spot = spots[np.searchsorted(spots[:, 0], ranks[own], side="right") - 1]
            k = ranks[own] - spot[:, 0]
            seq[own] = spot[:, 2] + k // spot[:, 1]
            off[own] = spot[:, 3] + k % spot[:, 1] * length
        return seq, off


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False,
         remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids`` as
    little-endian 32-bit numbers, one row for each piece."""
    pieces = stored(cut_pieces(docs, path, capacity, key, text, with_ids, remembered), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n"), "bases")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(patterns(counts, capacity)))

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        seq, off = places.value.of(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    # a row for each task and length, which no bound holds: dealt with the pieces, not broadcast
    ranked = pieces.join(base.drop("n").hint("merge"), ["length", "part"]).withColumn("p", place("length", F.col("base") + F.col("nth")))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset"]
    return ranked.select(*out, *["ids"] * with_ids)

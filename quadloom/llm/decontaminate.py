"""Benchmark decontamination by a generalised suffix automaton of test items.

The items, as words, become one automaton; each document is streamed through it word by word, and the
automaton's state tells the longest run of words, ending here, that stands in some item. A run of
WINDOW words or more is contamination; so is an item of fewer words that occurs whole. What is hit is
removed from the text, and a document of which too large a share is hit is removed altogether.

Items are dealt by a hash into batches of about BATCH_WORDS words. Spark tasks build the batches' automata, as
flat arrays, and write them to the shared folder; one at a time is broadcast, some 50 bytes a word. More
batches mean more passes over the documents; each pass is written before the next, and at the end the
findings of a document are united.

Defined cases: null or empty texts have no words, are never hit and, as items, have no window; items
without an id are no items; repeated items count once; repeated documents are judged each alone; other
columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import free_name, held, stored, utf8

#: Consecutive words of an item that make a hit.
WINDOW = 10
#: Words of items in one automaton, about: a task takes some hundred bytes a word to build it.
BATCH_WORDS = 500_000
#: Runs of the characters that words are of.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Words are runs of digits, letters a-z and all that is not ASCII. Positions of bytes stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"
FOUND_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items that own each window.

    Nearly all states have one way on, which two arrays hold; the others' are in ``more``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.word, self.to, self.link, self.length = (array("i", [x]) for x in (-1, -1, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        own = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for name, words in items]
        for _, words in own:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._own(own)

    def _after(self, v: int, w: int) -> int:
        """The state after ``v`` and a word, -1 if there is none."""
        if self.word[v] == w:
            return self.to[v]
        ways = self.more.get(v)
        return -1 if ways is None else ways.get(w, -1)

    def _lead(self, v: int, w: int, to: int) -> None:
        if self.word[v] in (w, -1):
            self.word[v], self.to[v] = w, to
        else:
            self.more.setdefault(v, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        for kept, x in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            kept.append(x)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """State of the run ``p`` + ``w``, which so far shares ``q`` with longer runs."""
        if self.length[p] + 1 == self.length[q]:
            return q
        part = self._state(self.length[p] + 1, self.link[q])
        self.word[part], self.to[part] = self.word[q], self.to[q]
        if q in self.more:
            self.more[part] = dict(self.more[q])
        self.link[q] = part
        while p >= 0 and self._after(p, w) == q:
            self._lead(p, w, part)
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        known = self._after(last, w)
        if known >= 0:
            return self._split(last, w, known)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and (q := self._after(p, w)) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, q)
        return new

    def _own(self, items: list[tuple[str, list[int]]]) -> None:
        """For each state: its ancestor that holds windows, that ancestor's items, and the nearest
        state, itself or above, that is a whole short item."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.anchor = array("i", [-1]) * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.anchor[v] = -1 if self.length[v] < self.window else v if self.length[up] < self.window else self.anchor[up]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, words in items:
            v, n = 0, 0
            for w in words:
                v, n = self.step(v, n, w)
                if n >= self.window:
                    self.items.setdefault(self.anchor[v], set()).add(name)
            if 0 < len(words) < self.window:
                self.short.setdefault(v, (len(words), set()))[1].add(name)
        self.above = array("i", [-1]) * len(order)
        for v in order[1:]:
            self.above[v] = v if v in self.short else self.above[self.link[v]]
        self.start = {w: self._after(0, i) for w, i in self.numbers.items()}

    def step(self, v: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest run of the items that ends with the word."""
        t = self._after(v, w)
        while t < 0 and v:
            v = self.link[v]
            n = self.length[v]
            t = self._after(v, w)
        return (0, 0) if t < 0 else (t, n + 1)

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit stretches of words as ``[first, last]``, in order, and the items that occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        start, above, window, step, numbers = self.start, self.above, self.window, self.step, self.numbers
        v = n = 0
        for i, w in enumerate(words):
            if not v:
                if w not in start:
                    continue
                v, n = start[w], 1
            elif w in numbers:
                v, n = step(v, n, numbers[w])
            else:
                v = n = 0
                continue
            if n >= window:
                found |= self.items[self.anchor[v]]
                self._add(spans, i - window + 1, i)
            u = above[v]
            while u >= 0:
                size, names = self.short[u]
                if size <= n:
                    found |= names
                    self._add(spans, i - size + 1, i)
                u = above[self.link[u]]
        return spans, found

    @staticmethod
    def _add(spans: list[list[int]], first: int, last: int) -> None:
        while spans and spans[-1][1] >= first - 1:
            first = min(first, spans.pop()[0])
        spans.append([first, last])


def automata(items: DataFrame, window: int, item_id: str, text: str, batch_words: int) -> tuple[DataFrame, int]:
    """``batch, data``: the automata of all items, built in tasks, and the number of batches."""
    own = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text"))
    own = own.withColumn("n", F.regexp_count("text", F.lit(WORD))).where("n > 0")
    batches = -(-(own.agg(F.sum("n")).first()[0] or 0) // batch_words)

    def build(t: pa.Table) -> pa.Table:
        named = [(n, words_of(x)) for n, x in zip(t["name"].to_pylist(), t["text"].to_pylist(), strict=True)]
        return pa.table({"batch": t["batch"][:1], "data": pa.array([pickle.dumps(Automaton(named, window))], pa.binary())})

    dealt = own.select("name", utf8("text").alias("text"), F.pmod(F.xxhash64("name", "text"), F.lit(max(1, batches))).cast("int").alias("batch"))
    return stored(dealt.groupBy("batch").applyInArrow(build, "batch int, data binary"), "automata"), batches


def passes(spark, items: DataFrame, window: int, item_id: str, text: str, batch_words: int) -> Iterator:
    """For each batch a function that gives the worker's automaton; one without items if there is none."""
    table, batches = automata(items, window, item_id, text, batch_words)
    any_ = False
    for batch in range(batches):
        row = table.where(F.col("batch") == batch).first()  # one automaton
        if row is not None:
            any_ = True
            yield _loader(spark, bytes(row["data"]))
    if not any_:
        yield _loader(spark, pickle.dumps(Automaton([], window)))


def _loader(spark, data: bytes):
    shared, key = spark.sparkContext.broadcast(data), ("decontaminate", uuid.uuid4().hex)
    return lambda: held(key, lambda: pickle.loads(shared.value))  # pickled by the tasks of this run


def finding(words: list[bytes], spans: list[list[int]], items: set[str]) -> dict:
    return {"n_words": len(words), "n_hit": sum(b - a + 1 for a, b in spans), "items": sorted(items), "spans": [{"first": a, "last": b} for a, b in spans]}


def finder(load):
    """A column function from text to what the items hit in it; spans are in words."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        auto, out = load(), []
        for t in texts:
            words = words_of(t.as_py())
            out.append(finding(words, *auto.find(words)))
        return pa.array(out, FOUND_TYPE)

    find = find.asNondeterministic()  # so that a filter above doesn't run it twice

    def of(col: str | Column) -> Column:
        return find(utf8(col))

    return of


def united(parts: Column) -> Column:
    """One finding from those of several batches: items joined, spans merged."""
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p["spans"]))))
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last")))
        )
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"] - 1), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(spans, empty, merge)
    hit = F.aggregate(merged, F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p["items"]))))
    return F.struct(F.element_at(parts, 1)["n_words"].alias("n_words"), hit.alias("n_hit"), items.alias("items"), merged.alias("spans"))


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", batch_words: int = BATCH_WORDS, name: str = "found") -> DataFrame:
    """``docs`` with a struct ``found``: n_words, n_hit, items (sorted as strings), spans (of words)."""
    loads = passes(docs.sparkSession, items, window, item_id, item_text, batch_words)
    load, more = next(loads), next(loads, None)
    if more is None:
        return docs.withColumn(name, finder(load)(text))
    # rows get a number that stays, and each batch writes its findings under it
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id")), "rows")
    own, parts = F.col("row")[text], None
    while load is not None:
        found = stored(rows.select("id", finder(load)(own).alias("f")).where("f.n_words > 0"), "findings")
        parts = found if parts is None else parts.unionByName(found)
        load, more = more, next(loads, None)
    parts = parts.groupBy("id").agg(F.collect_list("f").alias("fs")).select("id", united(F.col("fs")).alias("f"))
    nothing = F.lit(None).cast(f"struct<{FOUND.replace(' long', ':long').replace(' array', ':array')}>")
    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    out = rows.join(parts, "id", "left").withColumn("f", F.coalesce("f", none, nothing))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != name), F.col("f").alias(name))


def cutter(load):
    """A column function from text to its counts and, where it is hit, the text without the hit spans."""
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("text", pa.string())])

    @F.arrow_udf("n_words long, n_hit long, text string")
    def cut(texts: pa.Array) -> pa.Array:
        auto, out = load(), []
        for t in texts:
            t = t.as_py()
            words = words_of(t)
            spans, _ = auto.find(words)
            left = without(t, spans).decode("utf-8", "replace") if spans else None
            out.append({"n_words": len(words), "n_hit": sum(b - a + 1 for a, b in spans), "text": left})
        return pa.array(out, kind)

    return lambda col: cut.asNondeterministic()(utf8(col))


def remover():
    """A column function from text and spans of words to the text without them.

    A span goes from its first word's first byte to the first byte of the next word that stays, so
    that words on either side don't run together."""

    @F.arrow_udf("string")
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            out.append(without(text, [(c["first"], c["last"]) for c in cut]).decode("utf-8", "replace") if text and cut else None)
        return pa.array(out, pa.string())

    return lambda text, spans: remove(utf8(text), spans)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    flat, starts, at = text.translate(WORD_BYTES), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(text))
    out, done = [], 0
    for first, last in spans:
        out.append(text[done : starts[first]])
        done = starts[last + 1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text", batch_words: int = BATCH_WORDS) -> DataFrame:
    """Documents with hit spans cut out; those hit in more than ``max_coverage`` of their words go.

    Columns stay as they are; ``text`` and, where there is one, ``n_chars`` follow the cut. With one batch
    of items a text is read and cut in one pass."""
    name = free_name(docs, "found")
    loads = passes(docs.sparkSession, items, window, item_id, item_text, batch_words)
    load, more = next(loads), next(loads, None)
    if more is None:
        found = docs.withColumn(name, cutter(load)(text))
    else:
        found = stored(find_items(docs, items, window, text, item_id, item_text, batch_words, name), "found")
        left = F.when(F.col(name)["n_hit"] > 0, remover()(text, F.col(name)["spans"]))
        found = found.withColumn(name, F.struct(F.col(name)["n_words"].alias("n_words"), F.col(name)["n_hit"].alias("n_hit"), left.alias("text")))
    f = F.col(name)
    kept = found.where(f["n_hit"] <= max_coverage * f["n_words"]).withColumn(text, F.when(f["n_hit"] > 0, f["text"]).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(f["n_hit"] > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)

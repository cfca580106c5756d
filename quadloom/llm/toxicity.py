"""Toxicity by noisy-channel deobfuscation.

A word may be written with digits and signs for letters, with letters repeated, with its letters set
apart, or with a letter masked. What it may have been is a lattice; Viterbi finds the likeliest reading
under a trigram model of characters counted over the whole corpus. The restored words are scored.

* Model of characters: every task counts the trigrams of its texts, the counts are summed; the model has
  at most SYMBOLS ** 3 numbers, whatever the size of the corpus.
* Words that speak for toxic texts are learnt from at most MAX_PER_LABEL labelled documents of each
  label (the first by a hash of their id), by document counts of restored words and their beginnings.
  Three quarters of them give the words' weights, a quarter fits the logistic curve from a document's
  evidence to its score; where either part lacks a label, all of them do both. A text without any evidence
  scores at most NEUTRAL, whatever the share of toxic labels: few labels condemn nothing.
* Each sign of a masked stretch may be any letter or, at a word's edge readily, nothing. Stretches of any
  length are decoded in arrays, all letters at once.
* Letters set apart are runs of single characters, in which a masked one may be a vowel; words broken into
  longer pieces stay as they are.
* Signs at a word's edge, in words without a letter too, are letters or nothing, as the model has it;
  digits of a word without a letter may stay. Other punctuation around a word is taken off.
* A word of any length is decoded, once a worker if it is short; plain words have one reading and need
  no lattice. Lattices are made and decoded in a stream, that keeps the paths from where they part.

Only the text enters a score. Defined cases: null and empty texts have no evidence and get the score of
that; repeated labels of an id count once, the larger holds; labels other than 0 and 1 and null ids are
passed over; without labels of both kinds every score is the share of toxic ones, NEUTRAL at most (0
where there are none); other columns are passed on.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import Recent, free_name, held, stored, utf8

#: Symbols of the character model: 0 stands between words, 1 to 26 are a to z, the rest other letters.
SYMBOLS = 64
#: Labelled documents used at most, of each label; documents that a word must be in; words kept at most.
MAX_PER_LABEL = 20_000
MIN_DOCS = 5
MAX_WORDS = 50_000
#: Least evidence (a log of odds) that a word is kept for, and letters of a beginning.
MIN_WEIGHT = 2.0
STEM = 5
#: The most that a text without evidence scores.
NEUTRAL = 0.45
#: Tokens that a worker remembers in each of two generations.
REMEMBERED = 150_000
#: Characters of the longest token remembered, and places after which a decoder settles what all paths share.
LONGEST_KEY = 48
SETTLE = 64

#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
VOWELS = "aeiou"
#: Costs of the channel, as logs of chances: a letter written as itself costs nothing.
SWAPPED, REPEATED, MASKED, APART = -1.0, -1.5, -2.5, -1.0
#: Costs of a run of a sign that stands for nothing, which it may at a word's edge, and of ``!`` at the end.
DROPPED, EXCLAIMED = -5.0, -1.0
#: Cost of a masked sign between letters that stands for nothing.
UNMASKED = -8.0
LETTERS = 26

_EDGE = ".,;:?\"'()[]{}<>…«»¿¡-_#%&~`^/\\="
_SIGNS = "".join(c for c in LEET if not c.isdigit()) + "*"
_TWICE = re.compile(r"(.)\1")
_SPACED = re.compile(rf"([{re.escape(_SIGNS)}]*)(\w(?:[^\w\s]\w){{2,}})([{re.escape(_SIGNS)}]*)", re.UNICODE)


def symbol(c: str) -> int:
    """Number of a character in the model; 0 for what is no letter."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    return 27 + o % (SYMBOLS - 27) if c.isalpha() else 0


class Symbols:
    """The same for whole texts: one table for the characters of two bytes, the rest by rule."""

    def __init__(self):
        self.table = np.array([symbol(c if len(c) == 1 else c[0]) for c in (chr(i).lower() for i in range(0x10000))], np.uint32)

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return np.where(codes < 0x10000, self.table[np.minimum(codes, 0xFFFF)], 27 + codes % (SYMBOLS - 27))


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts."""

    def count(batches):
        table, total = Symbols(), np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    s = np.concatenate([[0, 0], table.of(t.as_py()), [0, 0]]).astype(np.int64)
                    idx = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    if len(idx) < 20_000:
                        u, n = np.unique(idx, return_counts=True)
                        total[u] += n
                    else:
                        total += np.bincount(idx, minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(text).mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["i"]] = r["n"]
    return out


class CharModel:
    """Trigram model, smoothed with bigrams and single characters."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)
        self.log = np.log(p3).astype(np.float32)

    def reader(self) -> list:
        return self.log.reshape(-1).tolist()


class Masked(NamedTuple):
    """Places of a lattice that each offer every letter, or nothing at a cost; ``final`` if none follows."""

    size: int
    nothing: float
    final: bool


class Decoder:
    """Words as they were meant."""

    def __init__(self, logs: list[float]):
        self.logs = logs
        self.grid = np.array(logs, np.float64).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        self.letters = np.ascontiguousarray(self.grid[:, :, 1 : LETTERS + 1])
        self.likeliest = self.letters.max(axis=2)

    def unmasked(self, best: dict[tuple[int, int], tuple[float, str]], run: Masked) -> dict[tuple[int, int], tuple[float, str]]:
        """The best paths through a masked stretch, from those before it: a maximum over arrays of states
        for each place, and what it came from to read the letters back. At the end only the best is kept,
        which is at once the one without letters if no letter could be worth more."""
        none = -np.inf
        if run.final:
            bare, state = max((s + run.size * run.nothing + self.grid[k][0], k) for k, (s, _) in best.items())
            if bare >= max(s + MASKED + self.likeliest[k] for k, (s, _) in best.items()) + (run.size - 1) * max(run.nothing, MASKED):
                return {state: (best[state][0] + run.size * run.nothing, best[state][1])}
        score = np.full((SYMBOLS, SYMBOLS), none)
        for state, (s, _) in best.items():
            score[state] = s
        came = []
        for _ in range(run.size):
            a, b = np.flatnonzero(score.max(axis=1) > none), np.flatnonzero(score.max(axis=0) > none)
            at = np.ix_(a, b)
            ahead = score[at][:, :, None] + self.letters[at]
            by = ahead.argmax(axis=0)
            said = np.full((SYMBOLS, SYMBOLS), none)
            said[b, 1 : LETTERS + 1] = np.take_along_axis(ahead, by[None], axis=0)[0] + MASKED
            frm = np.full((SYMBOLS, SYMBOLS), -1, np.int8)
            frm[b, 1 : LETTERS + 1] = a[by]
            kept = score + run.nothing
            frm[kept >= said] = -1
            score = np.maximum(said, kept)
            came.append(frm)
        if run.final:
            ends = [np.unravel_index(int((score + self.grid[:, :, 0]).argmax()), score.shape)]
        else:
            ends = np.argwhere(score > none)
        out = {}
        for x, y in ends:
            letters, state = [], (int(x), int(y))
            for frm in reversed(came):
                before = int(frm[state])
                if before >= 0:
                    letters.append(chr(96 + state[1]))
                    state = (before, state[0])
            out[int(x), int(y)] = (float(score[x, y]), best[state][1] + "".join(reversed(letters)))
        return out

    def viterbi(self, lattice: Iterable[list[tuple[str, float]] | Masked]) -> str:
        """The likeliest path: each place of the lattice offers strings with their costs."""
        logs = self.logs
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        settled: list[str] = []
        for place, options in enumerate(lattice, 1):
            if isinstance(options, Masked):
                best = self.unmasked(best, options)
                continue
            ahead: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in best.items():
                for text, cost in options:
                    x, y, s = a, b, score + cost
                    for c in text:
                        z = symbol(c)
                        s += logs[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                    old = ahead.get((x, y))
                    if old is None or s > old[0]:
                        ahead[x, y] = (s, said + text)
            best = ahead
            if place % SETTLE == 0:
                shared = os.path.commonprefix([said for _, said in best.values()])
                settled.append(shared)
                best = {k: (s, said[len(shared) :]) for k, (s, said) in best.items()}
        settled.append(max((s + logs[(x * SYMBOLS + y) * SYMBOLS], said) for (x, y), (s, said) in best.items())[1])
        return "".join(settled)

    @staticmethod
    def lattice(word: str, gaps: bool = False) -> Iterator[list[tuple[str, float]] | Masked]:
        i, fixed = 0, []
        first, last = 0, len(word)  # between them, the word without what is no letter or digit at its edges
        while first < last and not word[first].isalnum():
            first += 1
        while first < last and not word[last - 1].isalnum():
            last -= 1
        number = not any(map(str.isalpha, word))
        while i < len(word):
            c, n, inner = word[i], 1, first <= i < last
            while i + n < len(word) and word[i + n] == c:
                n += 1
            i += n
            if c in LEET:
                readings = [(x, SWAPPED) for x in LEET[c]]
            elif c == "*":
                if not gaps:
                    if fixed:
                        yield [("".join(x for x, _ in fixed), sum(cost for _, cost in fixed))]
                        fixed = []
                    yield Masked(n, UNMASKED if inner else REPEATED / n, i == len(word))
                    continue
                readings = [("", REPEATED), *((x, MASKED) for x in VOWELS)]
            elif c.isalpha():
                readings = [(c, 0.0)]
            else:
                readings = [("", 0.0)]
            if n > 1 and c != "*":
                readings = [(x * k, cost + (0.0 if k == n else REPEATED)) for x, cost in readings for k in (1, 2)]
            if c in LEET and not inner:
                readings.append(("", EXCLAIMED if c == "!" and i == len(word) else DROPPED))
            elif number and c.isdigit():
                readings.append((c * n, 0.0))
            if gaps and i < len(word):
                readings += [(x + " ", cost + APART) for x, cost in readings]
            if len(readings) == 1:  # places with one reading are one place
                fixed.append(readings[0])
                continue
            if fixed:
                yield [("".join(x for x, _ in fixed), sum(cost for _, cost in fixed))]
                fixed = []
            yield readings
        if fixed:
            yield [("".join(x for x, _ in fixed), sum(cost for _, cost in fixed))]

    def word(self, token: str) -> str:
        """A token in lower case without its marks, restored."""
        w = unicodedata.normalize("NFC", token).lower().strip(_EDGE)
        if w.isalpha() and not _TWICE.search(w):
            return w
        if not w.strip("*"):
            return ""
        if spaced := _SPACED.fullmatch(w):
            w = spaced[1] + spaced[2][::2] + spaced[3]
        return self.viterbi(self.lattice(w))

    def apart(self, letters: list[str]) -> list[str]:
        """Words of letters that were set apart by spaces."""
        w = "".join(letters).lower()
        if not w.strip("*"):
            return []
        return self.viterbi(self.lattice(w, gaps=True)).split()


def tokens_of(text: str, decode_apart) -> set[str]:
    """Distinct tokens of a text; runs of three and more single characters add what they may spell."""
    words = text.split()
    out = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    i = 0
    while i + 2 < len(single):
        n = 1
        while i + n < len(single) and single[i + n] == single[i] + n:
            n += 1
        if n >= 3:
            out.update(decode_apart(words[single[i] : single[i] + n]))
        i += n
    return out


def features_of(word: str) -> list[str]:
    return [word, word[:STEM] + "+"] if len(word) > STEM else [word]


class Weights(dict):
    """Evidence of each token: decoded when first met, then remembered, in two generations."""

    def __init__(self, decoder: Decoder, weights: dict[str, float]):
        super().__init__()
        self.decoder, self.weights = decoder, weights
        self.old: dict[str, float] = {}

    def __missing__(self, token: str) -> float:
        found = self.old.get(token)
        if found is None:
            get = self.weights.get
            found = max(get(f, 0.0) for f in features_of(self.decoder.word(token)))
        if len(token) <= LONGEST_KEY:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[token] = found
        return found

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The strongest word's evidence, and that of all others together."""
        if not text:
            return 0.0, 0.0
        got = [x for x in map(self.__getitem__, tokens_of(text, self.decoder.apart)) if x]
        return (max(got), sum(got) - max(got)) if got else (0.0, 0.0)


def chosen_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of a bounded number of labelled documents that are not held out."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    own = own.where(~held_out("doc_id")).withColumn("h", F.xxhash64("doc_id", F.lit("toxicity")))
    return own.where("toxic = 1").orderBy("h").limit(MAX_PER_LABEL).union(own.where("toxic = 0").orderBy("h").limit(MAX_PER_LABEL))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """All that scoring needs, of bounded size."""

    def __init__(self, logs: np.ndarray, weights: dict[str, float], curve: tuple[float, float, float]):
        self.logs, self.weights, self.curve = logs, weights, curve

    def score(self, top: np.ndarray, rest: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.log1p(rest), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of all texts and of the labels that are not held out."""
    spark = docs.sparkSession
    logs = CharModel(count_trigrams(docs, text)).log
    picked = stored(chosen_labels(labels), "labels")
    # at most 2 * MAX_PER_LABEL rows of two numbers
    some = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")
    some = stored(some.dropDuplicates(["doc_id"]).select("text", "toxic", (F.pmod("h", F.lit(4)) == 0).alias("fit")), "labelled")
    totals = {(r["fit"], r["toxic"]): r["n"] for r in some.groupBy("fit", "toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = (sum(n for (_, t), n in totals.items() if t == label) for label in (1, 0))
    if not n_bad or not n_good:
        share = min(NEUTRAL, n_bad / max(1, n_bad + n_good))
        return Model(logs, {}, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    parted = all(totals.get((part, label)) for part in (True, False) for label in (1, 0))
    learn, fit = (some.where("not fit"), some.where("fit")) if parted else (some, some)
    bad, good = (totals[False, 1], totals[False, 0]) if parted else (n_bad, n_good)
    shared_logs = spark.sparkContext.broadcast(logs)

    def words(batches):
        decoder = Decoder(shared_logs.value.reshape(-1).tolist())
        known = Recent(REMEMBERED)
        for b in batches:
            out, kinds = [], []
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for w in tokens_of(t or "", decoder.apart):
                    own = known.find(w)
                    if own is None:
                        own = features_of(decoder.word(w))
                        if len(w) <= LONGEST_KEY:
                            known.keep(w, own)
                    found.update(own)
                out += found
                kinds += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kinds, pa.int32())], ["f", "toxic"])

    counted = learn.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(words, "f string, toxic int")
    counted = counted.groupBy("f").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).where(F.col("n1") >= MIN_DOCS)
    weight = F.log((F.col("n1") + 0.5) / (bad + 1)) - F.log((F.col("n0") + 0.5) / (good + 1))
    kept = counted.select("f", weight.alias("w"), "n1").where(F.col("w") >= MIN_WEIGHT).orderBy(F.col("w").desc(), F.col("n1").desc(), "f").limit(MAX_WORDS)
    weights = {r["f"]: r["w"] for r in kept.collect()}
    model = Model(logs, weights, (0.0, 0.0, 0.0))
    fit = fit.select("toxic", evidence(model, spark)(F.col("text")).alias("e")).select("toxic", "e.top", "e.rest").toPandas()
    a, b, c = fit_curve(fit["top"].to_numpy(float), fit["rest"].to_numpy(float), fit["toxic"].to_numpy(float))
    model.curve = (min(a, math.log(NEUTRAL / (1 - NEUTRAL))), b, c)
    return model


def fit_curve(top: np.ndarray, rest: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    x, w = np.stack([np.ones_like(top), top, np.log1p(rest)], axis=1), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), grad)
    return float(w[0]), float(w[1]), float(w[2])


def evidence(model: Model, spark):
    shared, key = spark.sparkContext.broadcast((model.logs, model.weights)), uuid.uuid4().hex
    kind = pa.struct([("top", pa.float64()), ("rest", pa.float64())])

    def tables() -> Weights:
        logs, weights = shared.value
        return Weights(Decoder(logs.reshape(-1).tolist()), weights)

    @F.arrow_udf("top double, rest double")
    def of(texts: pa.Array) -> pa.Array:
        found = held(("toxicity", key), tables).evidence
        return pa.array([dict(zip(("top", "rest"), found(t.as_py()), strict=True)) for t in texts], kind)

    return of.asNondeterministic()  # a filter above must not run it again


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for texts likelier to be toxic."""
    a, b, c = model.curve
    own = free_name(docs, "evidence")
    found = docs.withColumn(own, evidence(model, docs.sparkSession)(F.col(text)))
    line = F.lit(a) + F.lit(b) * F.col(own)["top"] + F.lit(c) * F.log1p(F.col(own)["rest"])
    return found.withColumn(name, 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))).drop(own)

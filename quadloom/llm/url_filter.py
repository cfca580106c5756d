"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions: features, labels and the trees as nested conditions are columns of
the scan, and training is a few small aggregations. Labelled URLs are those that a rule decides, at most
about MAX_TRAIN of them (drawn by a hash of the URL), reduced to counts of equal binned features. Each
level of a tree is one grouped sum of gradients by node, feature and bin; only those sums, a bounded
number, reach the driver.

Features: length, depth of the path, share of digits, entropy of characters, parameters, labels of the
host, and of the host's last label how often it stands in all pages and, in the training URLs, the share
of blocked ones. These come from a table of all last labels that is joined to the pages.

Defined cases: a null URL, or one without ``://``, has an empty host and path, meets no rule and is
judged by its (empty) features; without labelled URLs of both kinds the verdict is that of the one kind,
or allow; repeated rows are judged alike; other columns are passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import lower_ascii, stored

MAX_TRAIN = 100_000
BINS = 16
TREES = 8
DEPTH = 3
RATE = 0.4
RIDGE = 1.0

NAMES = ("length", "depth", "digits", "entropy", "params", "labels", "suffix_n", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: str) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Text and verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    each = F.array_distinct(F.split(text, ""))

    def share(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.when(n > 0, F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + share(c))).otherwise(0.0)


def with_features(pages: DataFrame, url: str, rules: list[Rule]) -> DataFrame:
    """``host``, ``path``, the rule, and the features that need no training."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    out = out.withColumn("_hit", longest_rule(rules, F.col("host"), F.col("path")))
    return out.withColumns(
        {
            "_length": F.length(text).cast("double"),
            "_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
            "_digits": F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text)).otherwise(0.0),
            "_entropy": entropy(text),
            "_params": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
            "_labels": F.when(F.col("host") != "", F.size(F.split("host", r"\."))).otherwise(0).cast("double"),
            "_suffix": suffix_of(F.col("host")),
        }
    )


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def suffix_table(pages: DataFrame, url: str, labelled: DataFrame, prior: float) -> DataFrame:
    """``_suffix, _suffix_n, _suffix_rate`` of every last label of the pages."""
    every = pages.groupBy(suffix_of(host_of(url)).alias("_suffix")).agg(F.count("*").alias("n"))
    known = labelled.groupBy("_suffix").agg(F.count("*").alias("known"), F.sum("y").alias("blocked"))
    rate = F.coalesce((F.col("blocked") + prior) / (F.col("known") + 1), F.lit(prior))
    table = every.join(known, "_suffix", "left").select("_suffix", F.log1p("n").alias("_suffix_n"), rate.alias("_suffix_rate"))
    return stored(table, "suffixes")  # of known size, so that a small one is broadcast


def with_suffixes(rows: DataFrame, table: DataFrame | None) -> DataFrame:
    if table is None:
        return rows.withColumns({"_suffix_n": F.lit(0.0), "_suffix_rate": F.lit(0.0)})
    return rows.drop("_suffix_n", "_suffix_rate").join(table, "_suffix", "left")


@dataclass(frozen=True)
class Split:
    feature: str
    above: float


def tree_value(tree: tuple) -> Column:
    """A tree ``(split, low, high)`` or leaf as a column."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    split, low, high = tree
    return F.when(F.col("_" + split.feature) > split.above, tree_value(high)).otherwise(tree_value(low))


def node_of(tree: tuple | None, at: int = 1) -> Column:
    """Number of the open leaf a row is in."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    split, low, high = tree
    return F.when(F.col("_" + split.feature) > split.above, node_of(high, 2 * at + 1)).otherwise(node_of(low, 2 * at))


def grow(rows: DataFrame, margin: Column, edges: dict[str, list[float]]) -> tuple | float:
    """One tree from sums of gradients, level by level. ``rows``: the features, ``y`` and ``w``."""
    p = 1 / (1 + F.exp(-margin))
    base = rows.withColumns({"g": (F.col("y") - p) * F.col("w"), "h": p * (1 - p) * F.col("w")})
    tree: tuple | float | None = None
    leaves: dict[int, float] = {}
    for level in range(DEPTH):
        each = F.array(*(F.struct(F.lit(k).alias("f"), bin_of("_" + name, edges[name]).alias("b")) for k, name in enumerate(NAMES)))
        sums = base.select(node_of(tree).alias("node"), "g", "h", F.inline(each)).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        splits: dict[int, tuple[float, Split, float, float]] = {}
        for node in {r["node"] for r in sums}:
            own = [r for r in sums if r["node"] == node]
            total_g = sum(r["g"] for r in own if r["f"] == 0)
            total_h = sum(r["h"] for r in own if r["f"] == 0)
            leaves[node] = RATE * total_g / (total_h + RIDGE)
            for k, name in enumerate(NAMES):
                g = h = 0.0
                bins = sorted((r["b"], r["g"], r["h"]) for r in own if r["f"] == k)
                for b, bg, bh in bins[:-1]:
                    g, h = g + bg, h + bh
                    gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                    if gain > 1e-6 and (node not in splits or gain > splits[node][0] + 1e-9):
                        splits[node] = (gain, Split(name, edges[name][b]), RATE * g / (h + RIDGE), RATE * (total_g - g) / (total_h - h + RIDGE))
        if not splits:
            break
        for node, (_, _, low, high) in splits.items():
            leaves[2 * node], leaves[2 * node + 1] = low, high
        tree = replaced(tree, 1, splits)
    return filled(tree, 1, leaves)


def replaced(tree, at: int, splits: dict):
    if isinstance(tree, tuple):
        return tree[0], replaced(tree[1], 2 * at, splits), replaced(tree[2], 2 * at + 1, splits)
    return (splits[at][1], None, None) if at in splits else None


def filled(tree, at: int, leaves: dict[int, float]):
    if isinstance(tree, tuple):
        return tree[0], filled(tree[1], 2 * at, leaves), filled(tree[2], 2 * at + 1, leaves)
    return leaves.get(at, 0.0)


def bin_of(column: str, edges: list[float]) -> Column:
    """Number of the edges below a value."""
    return sum(((F.col(column) > e).cast("int") for e in edges), F.lit(0))


@dataclass
class Model:
    suffixes: DataFrame | None
    start: float
    trees: list

    def margin(self) -> Column:
        return sum((tree_value(t) for t in self.trees), F.lit(self.start))


def train(pages: DataFrame, url: str, rules: list[Rule]) -> Model:
    """Trees that tell blocked from allowed URLs, where rules do."""
    labelled = with_features(pages.select(url), url, rules).where("_hit is not null").withColumn("y", (F.col("_hit.verdict") == "block").cast("double"))
    whole = labelled.agg(F.count("*").alias("n"), F.sum("y").alias("blocked")).first()
    n, blocked = whole["n"], whole["blocked"] or 0.0
    if not n or blocked in (0.0, float(n)):
        return Model(None, 1.0 if n and blocked else -1.0, [])
    some = labelled.where(F.pmod(F.xxhash64(url), F.lit(1 << 30)) < int(min(1.0, MAX_TRAIN / n) * (1 << 30)))
    prior = blocked / n
    suffixes = suffix_table(pages, url, some, prior)
    columns = ["_" + name for name in NAMES]
    rows = with_suffixes(some, suffixes).select(*columns, "y")
    cuts = [i / BINS for i in range(1, BINS)]
    marks = rows.agg(*(F.percentile_approx(c, cuts, 1000).alias(c) for c in columns)).first()
    edges = {name: sorted(set(marks["_" + name])) for name in NAMES}
    # equal bins are one row: a value stands for its bin by the bin's upper edge
    binned = [F.element_at(F.array(*map(F.lit, [*edges[name], math.inf])), bin_of("_" + name, edges[name]) + 1).alias("_" + name) for name in NAMES]
    small = stored(rows.select(*binned, "y").groupBy(*columns, "y").agg(F.count("*").cast("double").alias("w")), "urls")
    model = Model(suffixes, math.log(prior / (1 - prior)), [])
    for _ in range(TREES):
        model.trees.append(grow(small, model.margin(), edges))
    return model


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's score, which replace such columns."""
    model = train(pages, url, rules)
    out = with_suffixes(with_features(pages, url, rules), model.suffixes).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    out = out.withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))})
    return out.drop("_hit", "_suffix", *("_" + n for n in NAMES))

"""Near-duplicate documents by MinHash with tensored banding.

COLLECTIONS collections of PER_COLLECTION minhashes each are computed, and every pair of collections
makes one table key: COLLECTIONS * (COLLECTIONS - 1) / 2 tables of 2 * PER_COLLECTION minhashes out of
about the square root as many computed ones. Two sets meet if at least two collections agree. At
similarity 0.8 with 18 collections of 3, two sets fail to meet with a chance of 5 in 100,000, at 0.85
of 1 in a million; what meets is verified on full sets of 64-bit shingle fingerprints.

Work follows distinct sets, not documents: equal sets are one node. Key rows are made only of
collections that another node shares. A bucket is never turned into all its pairs:

* every member is compared with the bucket's leader, the member that agrees most with others, so a
  group of copies hangs on its original after one comparison each;
* then only buckets whose other members lie in different components go on. Small ones (``block`` members, BLOCK if not given)
  verify the pairs that no component joins yet. Larger ones are united where they share members, which
  gives families of texts made from one another; the sets of a family are dealt out in pairs of blocks of
  BLOCK_SHINGLES, and a block finds the similar sets of different components through an index of its
  shingles, on full sets, starting from those outside its largest component.

So no candidate is capped; comparisons that could join nothing new are left out.

Defined cases: a text of fewer words than a shingle is one shingle of all its words; null texts and
texts without words have no shingle and link with nothing; rows that share an id are one document;
rows without an id are kept and linked with nothing; other columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import components, stored, utf8

COLLECTIONS = 18
PER_COLLECTION = 3
BLOCK = 64
BLOCK_SHINGLES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(x) for x in (30, 27, 31)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S[0])) * _M1
    x = (x ^ (x >> _S[1])) * _M2
    return x ^ (x >> _S[2])


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of a text; A-Z are lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Hashes:
    """Minhashes of a set, 32 bits each."""

    def __init__(self, collections: int, per: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, (collections * per, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, (collections * per, 1), np.uint64)

    def of(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 2**64 - 1, np.uint64)
        for i in range(0, len(s), 4096):
            least = np.minimum(least, (s[i : i + 4096] * self.a + self.b).min(axis=1))
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(width: int, collections: int, per: int):
    hashes = Hashes(collections, per)
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("mins", pa.list_(pa.int32()))])

    @F.arrow_udf("n long, digest binary, mins array<int>")
    def of(texts: pa.Array) -> pa.Array:
        from xxhash import xxh3_128_digest

        out = []
        for t in texts:
            s = shingle_set(t.as_py(), width)
            out.append({"n": len(s), "digest": xxh3_128_digest(s.tobytes()), "mins": hashes.of(s) if len(s) else None})
        return pa.array(out, kind)

    return of.asNondeterministic()  # a filter above must not run it again


def sets(width: int):
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return of.asNondeterministic()


def alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes of two sets that may be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def find_groups(docs: DataFrame, width: int = 5, percent: int = 80, collections: int = COLLECTIONS, per: int = PER_COLLECTION, key: str = "doc_id", text: str = "text", block: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row: similarity is at least ``percent`` / 100."""
    signed = docs.select(F.col(key).cast("long").alias("id"), signatures(width, collections, per)(utf8(text)).alias("s"))
    signed = stored(signed.select("id", "s.*"), "signatures")
    usable = signed.where("id is not null and n > 0")
    # one node for each set
    nodes = usable.groupBy("digest").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("mins").alias("mins"), F.count("*").alias("copies"))
    nodes = stored(nodes, "nodes")
    live = stored(shared_collections(nodes, per), "live")
    members = stored(bucket_members(live), "members")
    links = bucket_links(docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("text")), members, width, percent, block or BLOCK)
    # rows of one id belong together, too
    same = usable.join(nodes.where("copies > 1").select("digest", F.col("id").alias("node")), "digest", "left").select("id", F.coalesce("node", "id").alias("node"))
    same = same.where("id <> node").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("c"))
    odd = same.where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b"))
    odd = odd.union(same.join(nodes.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("a"), "b"))
    roots = components(links.select("a", "b").union(odd))
    out = signed.join(nodes.where("copies > 1").select("digest", F.col("id").alias("node")), "digest", "left").withColumn("node", F.when(F.col("n") > 0, F.coalesce("node", "id")).otherwise(F.col("id")))
    out = out.join(stored(roots.select(F.col("id").alias("node"), "root"), "roots"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "node"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def shared_collections(nodes: DataFrame, per: int) -> DataFrame:
    """Nodes with the collections that other nodes share, and how many share them in all."""
    starts = F.sequence(F.lit(0), F.size("mins") - per, F.lit(per))
    collected = F.transform(starts, lambda at: F.xxhash64(F.slice("mins", at + 1, F.lit(per))))
    each = nodes.select("id", "n", F.posexplode(collected).alias("i", "v"))
    counts = stored(each.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    return each.join(counts, ["i", "v"]).groupBy("id", "n").agg(F.sum("c").alias("pop"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs")).where(F.size("vs") > 1)


def bucket_members(live: DataFrame) -> DataFrame:
    """Members of the buckets of two and more: bucket, node, size, and the bucket's leader."""
    firsts = F.transform("vs", lambda x, k: F.transform(F.slice("vs", k + 2, F.size("vs")), lambda y: F.xxhash64(x["i"], x["v"], y["i"], y["v"])))
    rows = live.select("id", "n", "pop", F.explode(F.flatten(firsts)).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.max(F.struct("pop", (-F.col("id")).alias("neg"), "n")).alias("h")).where("c > 1")
    heads = stored(heads.select("bucket", "c", (-F.col("h.neg")).alias("leader"), F.col("h.n").alias("leader_n")), "heads")
    return rows.join(heads, "bucket")


def bucket_links(texts: DataFrame, members: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Verified links that connect what the buckets can connect."""
    pairs = members.where(F.col("id") != F.col("leader")).where(alike(F.col("n"), F.col("leader_n"), percent))
    pairs = stored(ordered(pairs.select(F.col("leader").alias("x"), F.col("id").alias("y"))).distinct(), "pairs")
    rest = members.where("id <> leader and c > 2").select("bucket", "id", "n", "pop")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(rest.select("id")).distinct()
    wanted = stored(texts.join(ids, "id", "left_semi").select("id", sets(width)("text").alias("s")), "sets")
    links = stored(verified(pairs, wanted, percent), "verified")
    roots = stored(components(links), "roots")
    rest = stored(rest.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rest")
    open_ = rest.groupBy("bucket").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rest = stored(rest.join(stored(open_.select("bucket", "c"), "open"), "bucket"), "rest")
    small = rest.where(F.col("c") <= block).groupBy("bucket").agg(F.collect_list(F.struct("id", "n", "root")).alias("xs"))
    more = small.select(F.explode(block_pairs(percent)).alias("p")).select("p.x", "p.y")
    more = stored(ordered(more).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.union(verified(more, wanted, percent))
    large = rest.where(F.col("c") > block)
    return links if large.isEmpty() else links.union(family_links(large, wanted, percent))


def family_links(large: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Links between components among the members of large buckets."""
    # what a component has in a bucket is one row: its members need no further uniting
    parts = stored(large.select("bucket", "root").distinct(), "parts")
    heads = stored(parts.groupBy("bucket").agg(F.min("root").alias("head")), "heads")
    families = components(parts.join(heads, "bucket").where("root <> head").select(F.col("root").alias("a"), F.col("head").alias("b")).distinct())
    families = families.select(F.col("root").alias("family"), F.col("id").alias("root"))
    rows = stored(large.select("id", "n", "root").distinct().join(families, "root"), "families")
    blocks = rows.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    rows = rows.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(wanted, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "root", "s")

    def compare(t: pa.Table) -> pa.Table:
        ids, root, block = (t[c].to_numpy() for c in ("id", "root", "block"))
        sets = t["s"].combine_chunks()
        values, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(sets).to_numpy())])
        n = np.diff(ends)
        _, shingle = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)[np.argsort(shingle, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(shingle))])
        names, counts = np.unique(root, return_counts=True)
        main, apart = names[counts.argmax()], t["one"][0].as_py() != t["two"][0].as_py()
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for i in np.flatnonzero(root != main):
            own = shingle[ends[i] : ends[i + 1]]
            both = np.bincount(np.concatenate([owner[starts[u] : starts[u + 1]] for u in own]), minlength=len(n))
            ok = (both * 100 >= (n + n[i] - both) * percent) & (root != root[i])
            if apart:
                ok &= block != block[i]
            for j in np.flatnonzero(ok):  # one link for each pair of components
                found.setdefault((min(root[i], root[j]), max(root[i], root[j])), (min(ids[i], ids[j]), max(ids[i], ids[j])))
        x, y = zip(*found.values(), strict=True) if found else ((), ())
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return rows.groupBy("family", "one", "two").applyInArrow(compare, "a long, b long")


def block_pairs(percent: int) -> Column:
    """Pairs of a small block that no component joins yet."""

    def with_later(x: Column, k: Column) -> Column:
        later = F.filter(F.slice("xs", k + 2, F.size("xs")), lambda y: (y["root"] != x["root"]) & alike(x["n"], y["n"], percent))
        return F.transform(later, lambda y: F.struct(x["id"].alias("x"), y["id"].alias("y")))

    return F.flatten(F.transform("xs", with_later))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def verified(pairs: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    left = wanted.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = wanted.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int | None = None) -> DataFrame:
    """One document of each group, the one with the smallest id; of repeated rows of it, one."""
    groups = stored(find_groups(docs, width, percent, block=block), "groups")
    out = docs.join(groups.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = stored(groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return out.select(*docs.columns)
    # of rows that share an id, the one with the least text
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("r")).select("doc_id", "r.*")
    return out.join(twice, "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))

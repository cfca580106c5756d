"""Chains of alignments as a prefix tree: each message runs once through each branch it needs.

Many channels read one topic, and most of them use the same few alignments. What a channel asks for is a
chain, its input and its output alignment; chains that begin alike share that beginning. A message is
joined with the chains of its topic, one row for each topic, and translated along the branches of the tree
that these chains take, row-local. Only then is it copied to channels, by topic and chain.

So the work of translation follows messages and distinct chains, not channels, and the plan the
alignments of the tree. Blank nodes that rules make are named after the message itself, since a chain's
result is one graph whoever reads it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadloom.operators import nested
from quadloom.operators.translate import translate_large
from quadloom.plans.lineage import cut_lineage
from quadloom.plans.rules import IDENTITY, RuleBook

Key = tuple[str, str]
#: Bytes of a table that may be copied to every executor.
BROADCAST_BYTES = 32 << 20


@dataclass
class Branch:
    """A beginning that chains share: its last alignment, the chains that end here, those that go on."""

    key: Key | None
    depth: int
    chains: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    after: dict[Key, Branch] = field(default_factory=dict)

    def walk(self):
        """All branches below, each after the one it goes on from."""
        for branch in self.after.values():
            yield self, branch
            yield from branch.walk()


def prefix_tree(chains: list[tuple[Key, ...]]) -> Branch:
    """Tree of numbered chains. The identity takes up its place in a chain and leads to a branch of its own."""
    root = Branch(None, 0)
    for n, chain in enumerate(chains):
        at = root
        at.chains.append(n)
        for depth, key in enumerate(chain, 1):
            at = at.after.setdefault(tuple(key), Branch(tuple(key), depth))
            at.chains.append(n)
        at.ends.append(n)
    return root


def bounded_by_bytes(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only where the bytes of its rows, as text, stay within ``most``."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def distinct_chains(channels: DataFrame) -> list[tuple[Key, Key]]:
    """Chains in use: configuration, as many as pairs of alignments and not as channels."""
    rows = channels.select("inp_name", "inp_version", "out_name", "out_version").distinct().collect()
    return sorted(((r[0], r[1]), (r[2], r[3])) for r in rows)


def _number(channels: DataFrame, chains: list[tuple[Key, Key]]) -> Column:
    """Number of a channel's chain."""
    pair = F.concat_ws("\u0001", "inp_name", "inp_version", "out_name", "out_version")
    numbers = F.create_map(*[F.lit(x) for n, (i, o) in enumerate(chains) for x in ("\u0001".join((*i, *o)), n)])
    return F.try_element_at(numbers, pair)


def translate_branches(msgs: DataFrame, book: RuleBook, chains: list[tuple[Key, ...]], wanted: str) -> DataFrame:
    """Nested messages with an array column ``wanted`` of chain numbers, to one row for each of them:
    ``chain`` and its ``triples``. Row-local; a branch that a message doesn't need costs nothing for it."""
    tree = prefix_tree(chains)
    out = msgs.withColumn("_b0", F.col("triples"))
    place: dict[int, str] = {id(tree): "_b0"}
    results = [(n, "_b0") for n in tree.ends]
    for number, (before, branch) in enumerate(tree.walk(), 1):
        source = place[id(before)]
        if branch.key == IDENTITY:
            place[id(branch)] = source
        else:
            mine = F.arrays_overlap(wanted, F.array(*[F.lit(n) for n in branch.chains]))
            program = book.program([IDENTITY] * (branch.depth - 1) + [branch.key])
            out = nested.apply_program(out.withColumn("triples", F.col(source)), program, mine)
            place[id(branch)] = f"_b{number}"
            out = out.withColumn(place[id(branch)], F.col("triples"))
        results += [(n, place[id(branch)]) for n in branch.ends]
    made = F.array(*[F.struct(F.lit(n).alias("chain"), F.col(c).alias("triples")) for n, c in sorted(results)])
    rest = [c for c in msgs.columns if c not in ("triples", wanted)]
    mine = F.transform(wanted, lambda n: F.element_at(made, n + 1))
    return out.select(*rest, F.inline(mine)).select(*rest, "triples", "chain")


def translate_by_chains(msgs: DataFrame, channels: DataFrame, book: RuleBook, limit: int | None = None, cut=cut_lineage) -> DataFrame:
    """Messages that carry a ``topic``, once for each distinct chain of the channels that read it.

    With ``limit``, messages of more triples are written once and translated in the relational form, chain
    by chain; without it, and in streams, every message is rewritten inside its row."""
    chains = distinct_chains(channels)
    if not chains:
        return msgs.where("false").withColumn("chain", F.lit(0))
    wanted = channels.select(F.col("source").alias("topic"), _number(channels, chains).alias("n")).groupBy("topic").agg(F.array_sort(F.collect_set("n")).alias("_wanted"))
    asked = msgs.join(bounded_by_bytes(wanted), "topic").select(*msgs.columns, "_wanted")
    if limit is None:
        return translate_branches(asked, book, chains, "_wanted")
    small = F.size("triples") <= limit
    parts = [translate_branches(asked.where(small), book, chains, "_wanted")]
    large = cut(asked.where(~small))
    if not large.isEmpty():
        for n, chain in enumerate(chains):
            mine = large.where(F.array_contains("_wanted", n)).drop("_wanted")
            program = book.program(chain)
            done = translate_large(mine, program, cut) if program.active else mine
            parts.append(done.withColumn("chain", F.lit(n)).select(*parts[0].columns))
    return reduce(DataFrame.unionByName, parts)


def to_channels(translated: DataFrame, channels: DataFrame) -> DataFrame:
    """Translated messages copied to every channel of their topic and chain. A copy is a message of its own."""
    chains = distinct_chains(channels)
    side = channels.select(
        F.col("source").alias("topic"), _number(channels, chains).alias("chain") if chains else F.lit(0).alias("chain"),
        F.col("id").alias("channel_id"), "sink", F.col("uuid").alias("channel_uuid"),
    )
    out = translated.join(bounded_by_bytes(side), ["topic", "chain"])
    return out.withColumn("msg_id", F.concat_ws("/", F.col("channel_id").cast("string"), "msg_id")).drop("chain")


def apply_channels(msgs: DataFrame, channels: DataFrame, book: RuleBook, limit: int | None = None, cut=cut_lineage) -> DataFrame:
    """Translate a batch or stream of nested messages for all channels, each chain once a message."""
    return to_channels(translate_by_chains(msgs, channels, book, limit, cut), channels)

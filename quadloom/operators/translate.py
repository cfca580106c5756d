"""Translation of messages: alignments, chains, channels, and the choice between the two forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from quadloom import vocab as V
from quadloom.operators import nested, payload as P, relational
from quadloom.plans.bits import key_bits, with_flags
from quadloom.plans.lineage import cut_lineage
from quadloom.plans.rules import Program, RuleBook
from quadloom.terms import TRIPLE, empty_meta, to_long

#: Largest graph, in triples, that is rewritten inside its row.
NESTED_LIMIT = 256


def translate_quads(quads: DataFrame, program: Program, msgs: DataFrame | None = None, cut=cut_lineage) -> DataFrame:
    """Translate the payloads of long quads; everything outside the payload is untouched."""
    if not program.active:
        return quads
    triples = P.payload(quads).select(*relational.KEY)
    if msgs is None and any(s.plan.unconditional for s in program.active):
        msgs = quads.select("msg_id").distinct()
    return P.with_payload(quads, relational.apply_program(triples, program, msgs, cut))


def translate_small(msgs: DataFrame, program: Program) -> DataFrame:
    """Row-local translation of nested messages."""
    return nested.apply_program(msgs, program)


def translate_large(msgs: DataFrame, program: Program, cut=cut_lineage) -> DataFrame:
    """Relational translation of nested messages, returned nested again.

    The input is already one row per message, so gathering the result per message is as large as
    the rows it came from plus what the rules insert."""
    # Written once: the steps read it several times, and it may come from parsed text.
    triples = cut(msgs.select("msg_id", F.inline_outer("triples")).where(F.col("s").isNotNull()).dropDuplicates())
    done = relational.apply_program(triples, program, msgs.select("msg_id"), cut)
    graphs = done.groupBy("msg_id").agg(F.collect_list(F.struct("s", "p", "o")).alias("triples"))
    empty = F.array().cast(T.ArrayType(TRIPLE))
    rest = msgs.drop("triples").join(graphs, "msg_id", "left")
    return rest.withColumn("triples", F.coalesce("triples", empty)).select(*msgs.columns)


def translate(msgs: DataFrame, program: Program, limit: int = NESTED_LIMIT, cut=cut_lineage) -> DataFrame:
    """Translate nested messages, each in the form that suits its size.

    The split is a row-local test; only messages above ``limit`` triples take part in a shuffle, and
    without any such message the relational plan is left out."""
    if not program.active:
        return msgs
    small = F.size("triples") <= limit
    large = msgs.where(~small)
    if large.select("msg_id").isEmpty():
        return translate_small(msgs, program)
    return translate_small(msgs.where(small), program).unionByName(translate_large(large, program, cut))


def translate_chain(msgs: DataFrame, book: RuleBook, keys, **options) -> DataFrame:
    """Ad-hoc translation by a list of alignments; an unknown one fails before anything runs."""
    return translate(msgs, book.program(keys), **options)


def nest_quads(quads: DataFrame, limit: int = NESTED_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Split long quads by message size: nested rows for messages up to ``limit`` quads, and the
    long quads of the others. Sizes are counted with map-side combine, and only rows of messages
    within the limit are moved and gathered."""
    quads = quads.where(F.col("msg_id").isNotNull())
    sizes = quads.groupBy("msg_id").agg(F.count("*").alias("n"))
    few, many = (sizes.where(c).select("msg_id") for c in (F.col("n") <= limit, F.col("n") > limit))
    # most rows are told by the bits of the messages; only where both have one is the message looked up
    flagged = with_flags(quads, _few=key_bits(few), _many=key_bits(many))
    unsure = flagged.where("_few and _many").drop("_few", "_many")
    small = flagged.where("not _many").drop("_few", "_many").unionByName(unsure.join(few, "msg_id", "left_semi"))
    large = flagged.where("not _few").drop("_few", "_many").unionByName(unsure.join(many, "msg_id", "left_semi"))
    # moved as they are: gathered before, rows would be sorted once more
    rows = small.repartition("msg_id").groupBy("msg_id").agg(F.collect_list(F.struct("g", "s", "p", "o")).alias("q"))
    g, triples, meta = P.split_nested(F.col("q"))
    nested_rows = rows.select("msg_id", g.alias("payload_g"), triples.alias("triples"), meta.alias("meta"))
    return nested_rows, large


def translate_mixed(quads: DataFrame, program: Program, limit: int = NESTED_LIMIT, cut=cut_lineage) -> DataFrame:
    """Translate long quads with the nested form for small messages and the relational one for the
    rest. Worth it for programs with many steps: the nested part shuffles once in all."""
    small, large = nest_quads(quads, limit)
    done = translate_small(small, program)
    return to_long(done).unionByName(translate_quads(cut(large), program, cut=cut))


def messages_from_triples(df: DataFrame, graph: str = V.DEFAULT_GRAPH) -> DataFrame:
    """Nested messages from ``msg_id, triples`` rows."""
    return df.select("msg_id", F.lit(graph).alias("payload_g"), "triples", empty_meta().alias("meta"))

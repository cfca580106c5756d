"""Registry of rule sets and channels, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

KEY = ["name", "version"]


def key_hash(name: Column | str = "name", version: Column | str = "version") -> Column:
    return F.md5(F.concat_ws(":", F.md5(name), F.md5(version)))


def content_hash(text: Column | str) -> Column:
    """Hash of a rule document up to white space."""
    return F.md5(F.trim(F.regexp_replace(text, r"\s+", " ")))


def number_rows(df: DataFrame, by: Column, start: int = 0, out: str = "id") -> DataFrame:
    """Consecutive ids in the order of an md5 column.

    Rows are ranked inside 4096 hash ranges and shifted by the sizes of the ranges before, so the
    only thing computed in one task is the running sum over those 4096 counts."""
    keyed = df.withColumn("_h", by).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    joined = keyed.withColumn("_r", rank).join(F.broadcast(offsets), "_b")
    return joined.withColumn(out, F.col("_off") + F.col("_r") + start).drop("_h", "_b", "_r", "_off")


def next_id(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def add_verdicts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Verdict per new rule set: ``created``, ``already`` (same content) or ``conflict``.

    Equal rule sets in one batch count once; of different ones under one key a single one is
    created, picked by content hash so that a rerun picks the same."""
    hashed = new.withColumn("_hash", content_hash("source_text")).dropDuplicates([*KEY, "_hash"])
    old = existing.select(*KEY, content_hash("source_text").alias("_old"))
    first = hashed.groupBy(*KEY).agg(F.min("_hash").alias("_first"))
    reference = F.coalesce("_old", "_first")
    verdict = (
        F.when(F.col("_hash") != reference, "conflict").when(F.col("_old").isNull(), "created").otherwise(F.lit("already"))
    )
    joined = hashed.join(first, KEY).join(old, KEY, "left")
    return joined.withColumn("verdict", verdict).select(*new.columns, "verdict")


def add_alignments(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the accepted rule sets appended under new ids, and the verdicts."""
    verdicts = add_verdicts(existing, new)
    accepted = verdicts.where("verdict = 'created'").drop("verdict")
    rows = number_rows(accepted, key_hash(), next_id(existing))
    return existing.unionByName(rows.withColumn("id", F.col("id").cast(existing.schema["id"].dataType)).select(*existing.columns)), verdicts


def channel_refs(channels: DataFrame) -> DataFrame:
    """``name, version, id`` of every use of an alignment, input or output side, once per channel."""
    inp = channels.select(F.col("inp_name").alias("name"), F.col("inp_version").alias("version"), "id")
    out = channels.select(F.col("out_name").alias("name"), F.col("out_version").alias("version"), "id")
    return inp.unionByName(out).distinct()


def channel_counts(channels: DataFrame) -> DataFrame:
    """Number of channels using each alignment on either side."""
    return channel_refs(channels).groupBy(*KEY).agg(F.count("*").alias("n_channels"))


def delete_verdicts(existing: DataFrame, keys: DataFrame, channels: DataFrame) -> DataFrame:
    """Verdict per key: ``blocked`` by a channel, ``missing`` or ``deleted``."""
    used = channel_refs(channels).select(*KEY).distinct().withColumn("used", F.lit(True))
    known = existing.select(*KEY).distinct().withColumn("known", F.lit(True))
    verdict = F.when(F.col("used"), "blocked").when(F.col("known"), "deleted").otherwise(F.lit("missing"))
    return keys.select(*KEY).distinct().join(used, KEY, "left").join(known, KEY, "left").select(*KEY, verdict.alias("verdict"))


def delete_alignments(existing: DataFrame, keys: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    verdicts = delete_verdicts(existing, keys, channels)
    return existing.join(verdicts.where("verdict = 'deleted'").select(*KEY), KEY, "left_anti").select(*existing.columns), verdicts


def find_alignment(alignments: DataFrame, name: str, version: str) -> DataFrame:
    return alignments.where((F.col("name") == name) & (F.col("version") == version))


def find_channel(channels: DataFrame, channel_id: int) -> DataFrame:
    return channels.where(F.col("id") == channel_id)


def alignment_info(alignments: DataFrame) -> DataFrame:
    """Listing without the rule text, with a one-line description."""
    desc = F.format_string("[%s] [%s] : %s -> %s", "name", "version", "source_onto", "target_onto")
    return alignments.drop("source_text").withColumn("desc_id", desc)


def channel_info(channels: DataFrame) -> DataFrame:
    def side(name: str, version: str) -> Column:
        named = F.concat(F.lit("{"), F.col(name), F.lit("}:"), F.col(version))
        return F.when(F.col(name) == "", "{identity}").otherwise(named)

    desc = F.concat(
        F.col("source"), F.lit(" ⇛ ⟪ "), side("inp_name", "inp_version"), F.lit(" ⇒ "),
        side("out_name", "out_version"), F.lit(" ⟫ ⇛ "), F.col("sink"),
    )
    return channels.withColumn("desc_id", desc)


def sink_conflicts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New channels whose sink is taken by an existing channel or by an earlier new one."""
    taken = new.join(existing.select("sink").distinct(), "sink", "left_semi").select(*new.columns)
    first = new.groupBy("sink").agg(F.min("uuid").alias("_first"))
    repeated = new.join(first, "sink").where(F.col("uuid") > F.col("_first")).select(*new.columns)
    return taken.unionByName(repeated).dropDuplicates(["uuid"])


def channel_defaults(new: DataFrame) -> DataFrame:
    """Consumer group and parallelism of new channels: a fresh group for broker type KK when none is
    given, none for MM, at least one worker."""
    group = F.when(
        F.col("chan_type") == "KK", F.coalesce(F.nullif(F.trim("consumer_group"), F.lit("")), F.col("uuid"))
    ).otherwise(F.lit(""))
    return new.withColumn("consumer_group", group).withColumn(
        "parallelism", F.greatest(F.coalesce("parallelism", F.lit(1)), F.lit(1))
    )


def add_channels(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the accepted channels appended, and the refused ones. ``new`` has a ``uuid``."""
    refused = sink_conflicts(existing, new)
    accepted = channel_defaults(new.join(refused.select("uuid"), "uuid", "left_anti"))
    rows = number_rows(accepted.drop("id"), F.md5("uuid"), next_id(existing))
    rows = rows.withColumn("id", F.col("id").cast(existing.schema["id"].dataType))
    return existing.unionByName(rows.select(*existing.columns)), refused


def delete_channels(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id"), "id", "left_anti").select(*existing.columns)


class Registry:
    """Registry tables in a folder. Every change writes a new snapshot; readers use the last
    complete one, so a change that is cut off leaves the registry as it was."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _snapshots(self, table: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = []
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
            if name.startswith("snapshot-") and fs.exists(mark):
                done.append(int(name.split("-")[1]))
        return sorted(done)

    def read(self, table: str) -> DataFrame:
        found = self._snapshots(table)
        if not found:
            raise ValueError(f"registry has no table {table}")
        return self.spark.read.parquet(f"{self.root}/{table}/snapshot-{found[-1]:06d}")

    def write(self, table: str, df: DataFrame) -> None:
        found = self._snapshots(table)
        number = found[-1] + 1 if found else 0
        # of two writers with the same number the second fails, and may read and write anew
        df.write.mode("errorifexists").parquet(f"{self.root}/{table}/snapshot-{number:06d}")

    def add_alignments(self, new: DataFrame) -> DataFrame:
        table, verdicts = add_alignments(self.read("alignment"), new)
        self.write("alignment", table)
        return verdicts

    def delete_alignments(self, keys: DataFrame) -> DataFrame:
        table, verdicts = delete_alignments(self.read("alignment"), keys, self.read("channel"))
        self.write("alignment", table)
        return verdicts

    def add_channels(self, new: DataFrame) -> DataFrame:
        table, refused = add_channels(self.read("channel"), new)
        self.write("channel", table)
        return refused

    def delete_channels(self, ids: DataFrame) -> None:
        self.write("channel", delete_channels(self.read("channel"), ids))

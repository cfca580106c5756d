"""Which keys a table has, as bits: rows whose key is surely not among them need no shuffle.

A key has one bit by its hash. The bits are or-ed before they are shuffled, and take 32 MB at most
however many keys there are; as these grow, more rows look as if they had one, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 28
#: Bits of a row, as Spark's bitmaps have them.
BLOCK = 1 << 15


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def key_bits(keys: DataFrame, key: str = "msg_id") -> DataFrame:
    """``block, words`` of all keys, null included: a bitmap as 512 whole numbers, as these are read without a copy."""
    at = keys.select(_place(key).alias("at"))
    bits = at.groupBy((F.col("at") / BLOCK).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % BLOCK).alias("bits"))

    def word(i: Column) -> Column:
        return F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")

    return bits.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), word).alias("words"))


def _bit(words: Column, at: Column) -> Column:
    """One bit of a bitmap: bytes stand in order, the first bit of a byte is its lowest."""
    place = (7 - (at / 8).cast("int") % 8) * 8 + at % 8
    return F.getbit(F.get(words, (at / 64).cast("int")), place.cast("int")) == 1


def with_flags(df: DataFrame, key: str = "msg_id", **sets: DataFrame) -> DataFrame:
    """A column for each of ``sets``, given by :func:`key_bits`: false where the key is surely not among them.
    The bits are copied to every executor."""
    columns = df.columns
    df = df.withColumn("_at", _place(key).cast("int"))
    at = F.col("_at")
    for name, bits in sets.items():
        blocks = bits.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
        flag = F.coalesce(_bit(F.col("_words"), at % BLOCK), F.lit(False))
        df = df.join(F.broadcast(blocks), F.shiftright("_at", 15) == F.col("_block"), "left").withColumn(name, flag).drop("_block", "_words")
    return df.select(*columns, *sets)

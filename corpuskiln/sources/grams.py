"""An index of the trigrams that a file's texts hold, as bitmaps: a file that lacks one of a word's trigrams doesn't hold the word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A trigram is one of so many bits, by its hash; two that share a bit cost a needless read, never a hit.
SIZE, BITS = 3, 1 << 20
SCHEMA = "file string, what string, bucket bigint, bits binary"


def bits_of(text: Column) -> Column:
    """The distinct bits of a lower-cased text's trigrams."""
    letters = F.split(text, "")
    places = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - SIZE), lambda i: F.pmod(F.xxhash64(*[F.get(c, i + k) for k in range(SIZE)]), F.lit(BITS)))
    one = F.transform(F.array(letters), lambda c: F.when(F.size(c) >= SIZE, F.array_distinct(places(c))).otherwise(F.array().cast("array<bigint>")))
    return F.get(one, F.lit(0))


def build(rows: DataFrame, texts: dict[str, Column], file_col: str) -> DataFrame:
    """SCHEMA of rows that know their file: for each file and column at most BITS / 32768 bitmaps of 4 KB."""
    each = F.array(*[F.struct(F.lit(name).alias("what"), bits_of(F.lower(F.coalesce(c, F.lit("")))).alias("bits")) for name, c in texts.items()])
    held = rows.select(F.col(file_col).alias("file"), F.explode(each).alias("t")).select("file", "t.what", F.explode("t.bits").alias("bit"))
    return held.groupBy("file", "what", F.bitmap_bucket_number(F.col("bit")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit"))).alias("bits"))


def may_hold(index: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """(file) of files of which one of the columns has all trigrams of a lower-cased query of at least SIZE letters."""
    spark = index.sparkSession
    asked = spark.range(1).select(F.explode(bits_of(F.lit(query))).alias("bit")).select(F.bitmap_bucket_number(F.col("bit")).alias("bucket"), F.bitmap_bit_position(F.col("bit")).alias("at"))
    asked = F.broadcast(asked)  # as many rows as the query has letters
    here = index.where(F.col("what").isin(columns)).join(asked, "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = here.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0)
    return found.groupBy("file", "what").agg(F.count("*").alias("n")).join(F.broadcast(asked.agg(F.count("*").alias("all"))), F.col("n") == F.col("all")).select("file").distinct()

"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of the small side, and parts of a hot key, in a salted join.
SALTS = 16
#: Steps of a sample's hash.
HASHES = 1 << 30


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def salted_left_join(big: DataFrame, small: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left join on ``key``, unique in ``small``, with the rows of a hot key spread over ``salts`` tasks by a hash of ``spread``.

    The small side is repeated ``salts`` times; it is never broadcast.
    """
    a = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("shuffle_hash"), [key, "_salt"], "left").drop("_salt")


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows at most, and all if there are no more: those whose hash of ``key`` is below the bound that lets
    so many pass. Nothing is sorted or gathered, and the rows stay where they are; equal keys go together."""
    total = rows.count()
    return rows if total <= size else rows.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(HASHES)) < int(HASHES * size / total))


def words(text: Column, pattern: str) -> Column:
    """All matches as an array; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))

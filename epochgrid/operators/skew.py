"""Joins of a side with hot keys: a key that holds a large share of all rows is cut by its count before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in ``PARTS`` of all rows is hot; there are fewer than ``PARTS`` of them, which bounds what is broadcast.
PARTS = 2048


def hot_keys(counts: DataFrame, key: str, count: str, parts: int = PARTS) -> DataFrame:
    """(key, salts) of each key with more than one in ``parts`` of the sum of ``count``; marked for broadcast."""
    share = F.col(count) * parts / F.col("__all")
    total = counts.agg(F.sum(count).alias("__all"))
    return F.broadcast(counts.crossJoin(F.broadcast(total)).filter(share > 1).select(key, F.ceil(share).cast("int").alias("__salts")))


def salted_join(large: DataFrame, small: DataFrame, key: str, hot: DataFrame, how: str = "inner", by: Column | None = None) -> DataFrame:
    """The join of ``large`` with ``small`` on ``key``; a hot key's rows of ``large`` are cut, those of ``small`` go to each part.

    ``by`` says into which part a row falls (its source partition by default); the result doesn't depend on it. Null keys match none.
    """
    salts = F.coalesce("__salts", F.lit(1))
    cut = F.pmod(F.spark_partition_id().cast("bigint") if by is None else F.xxhash64(by), salts).cast("int")
    left = large.join(hot, key, "left").withColumn("__salt", cut).drop("__salts")
    right = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")

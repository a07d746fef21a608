"""Upserts as joins of a snapshot with new rows; the result is the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """The next snapshot with ``change`` (``same``, ``updated``, ``inserted``). Policies by column: ``new`` overwrites, also with
    null; ``fill`` takes the new value if there is one; ``keep`` the old one if there is one. A key must come once on each side;
    rows without a key are left out."""

    def value(c: str, how: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        both = {"new": b, "fill": F.coalesce(b, a), "keep": F.coalesce(a, b)}[how]
        return F.when(F.col(f"n.{key}").isNull(), a).otherwise(both).alias(c)

    o, n = old.filter(F.col(key).isNotNull()).alias("o"), new.filter(F.col(key).isNotNull()).alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    values = [value(c, how) for c, how in policy.items()]
    change = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "same").otherwise("updated")
    return j.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *values, change.alias("change"))


def first_filled(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: of each column the first value in order that isn't null."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


PART = 1000


def part_of(member: Column, count: Column, size: int = PART) -> Column:
    """The part a member of a group falls into, so that parts have about ``size`` members at most; the same in every run."""
    return (F.conv(F.substring(F.md5(member), 1, 8), 16, 10).cast("bigint") % F.ceil(count / size)).cast("int")


def listed(rows: DataFrame, keys: list[str], member: str, size: int = PART) -> DataFrame:
    """(keys, part, members, list): the different members of each group, in order, joined by commas. A group is cut into parts of
    about ``size`` members, so no list grows with the data; most groups have one part, number 0. Null keys form groups too."""
    different = rows.select(*keys, F.col(member).alias("__m")).filter(F.col("__m").isNotNull()).distinct()
    counts = different.groupBy(*keys).agg(F.count("*").alias("__n")).select(F.struct(*keys).alias("__k"), "__n")
    cut = different.join(counts, F.struct(*keys).eqNullSafe(F.col("__k"))).withColumn("part", part_of(F.col("__m"), F.col("__n"), size))
    return cut.groupBy(*keys, "part").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("__m")), ",").alias("list"))


def replaced(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """The next state where each touched key's rows are deleted and those of ``new`` take their place; a touched key without new rows
    has none. New rows of keys that aren't touched are left out. ``touched`` has the column ``key``, nulls in it touch nothing."""
    keys = touched.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(new.join(keys, key, "left_semi"))


def stamped(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], seen: str) -> DataFrame:
    """The next state of rows named by several keys: new ones come in, known ones take the new values and the later ``seen``, the rest
    stay. Of new rows with equal keys the last seen counts; rows with a null key are left out."""
    filled = " and ".join(f"`{k}` is not null" for k in keys)
    one = new.filter(filled).groupBy(*keys).agg(F.max_by(F.struct(*values, seen), F.struct(F.col(seen), F.to_json(F.struct(*values)))).alias("n"))
    both = old.filter(filled).select(*keys, F.struct(*values, seen).alias("o")).join(one, keys, "full")
    picked = [F.when(F.col("n").isNotNull(), F.col(f"n.{v}")).otherwise(F.col(f"o.{v}")).alias(v) for v in values]
    return both.select(*keys, *picked, F.greatest(f"o.{seen}", f"n.{seen}").alias(seen))

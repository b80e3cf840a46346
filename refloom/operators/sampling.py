"""Samples that depend on a seed and the rows' keys alone: nested for every size, equal wherever they are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: int | str) -> Column:
    """A random place for a key: the first half of a digest of seed and key, which other engines compute as well."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 16)


def nested_sample(df: DataFrame, strata: list[str], key: str, k: int, seed: int | str = 42) -> DataFrame:
    """The first k of every stratum in seeded order; the sample of k holds that of any smaller one.

    The engine turns the rank filter into a limit before the shuffle, so a stratum with a third of all rows sends k rows
    from each task.
    """
    w = Window.partitionBy(*strata).orderBy(order_key(F.col(key), seed), key)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def quota_sample(df: DataFrame, stratum: str, key: str, quotas: dict, seed: int | str = 42) -> DataFrame:
    """As many of each stratum as its quota says."""
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy(stratum).orderBy(order_key(F.col(key), seed), key)
    kept = df.filter(q[F.col(stratum)].isNotNull()).withColumn("__k", F.row_number().over(w))
    return kept.filter(F.col("__k") <= F.least(q[F.col(stratum)], F.lit(max(quotas.values())))).drop("__k")


def shards(df: DataFrame, column: str, n: int) -> DataFrame:
    """P5: distinct values in n contiguous runs of about equal length; value and shard.

    For values of the calendar (months), of which there are few: they are ranked in one task.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.withColumn("shard", F.ntile(n).over(Window.orderBy(column)))


def seeded_take(df: DataFrame, key: str, k: int, seed: int | str = 42) -> DataFrame:
    """The first k rows in seeded order, by a top-k that never sorts all rows in one place."""
    return df.orderBy(order_key(F.col(key), seed), *[F.col(c) for c in df.columns]).limit(k)


def first_file_owns(df: DataFrame, file: str, period: str) -> DataFrame:
    """Of a period that stands in several files the rows of the first file by name."""
    owners = df.groupBy(period).agg(F.min(file).alias(file))
    return df.join(owners, [period, file], "left_semi")

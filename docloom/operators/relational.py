"""Relational helpers with an explicit order: latest row by key, first by order, anti joins, unions with fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``; other columns as in that row."""
    columns = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def known(df: DataFrame, seen: DataFrame, key: str, new: bool = True) -> DataFrame:
    """Rows whose key is not (or is) among those seen."""
    return df.join(seen.select(key).distinct(), key, "left_anti" if new else "left_semi")


def head(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def counts_with_fill(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Counts by key on both sides, zero where a key is missing."""
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias(names[0]))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias(names[1]))
    return left.join(right, key, "full_outer").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])

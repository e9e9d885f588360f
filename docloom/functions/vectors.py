"""Vectors as arrays; zero norms give a similarity of 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """F60."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def maxsim(query: Column, passage: Column) -> Column:
    """sum over the query's vectors of the best dot product with a vector of the passage."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(passage, lambda p: dot(q, p)))), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def sparse_dot(query: Column, passage: Column) -> Column:
    """dot product of two maps from term to weight."""
    return F.aggregate(F.map_entries(query), F.lit(0.0), lambda s, e: s + e["value"].cast("double") * F.coalesce(passage[e["key"]].cast("double"), F.lit(0.0)))


def fit_dimension(a: Column, size: int) -> Column:
    """A vector cut or padded with zeros to ``size``."""
    return F.when(F.size(a) >= size, F.slice(a, 1, size)).otherwise(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), size - F.size(a))))


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """counts of tokens by hash, the same in every run."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


def similarity_pairs(df: DataFrame, group: list[str], key: str, vector: str) -> DataFrame:
    """cosine of each pair of rows of a group, the first key before the second; a group is a page or section, not a table."""
    a = df.select(*group, F.col(key).alias("a_id"), F.col(vector).alias("_a"))
    b = df.select(*group, F.col(key).alias("b_id"), F.col(vector).alias("_b"))
    return a.join(b, group).where("a_id < b_id").select(*group, "a_id", "b_id", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def seeded_vector(texts: pd.Series, size: int = 64) -> pd.Series:
    """unit vectors that depend on the text alone, from a generator seeded with the sum of its code points; null for null."""
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        v = np.random.RandomState(sum(map(ord, t)) % (2**31 - 1)).randn(size).astype(np.float32)
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return pd.Series(out, dtype="object")


def fallback_vector(c: Column, size: int = 64) -> Column:
    """F51 as a column function."""
    return F.pandas_udf(lambda s: seeded_vector(s, size), "array<float>")(c)


def batches(values: Column, size: int) -> Column:
    """an array cut into arrays of ``size``; the last may be shorter."""
    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / F.lit(size)).cast("int") - 1), lambda k: F.slice(values, k * size + 1, size))
    return F.when(n > 0, cut)

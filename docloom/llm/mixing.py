"""Mixing sources to target shares of the total size by Poisson replication.

Each document gets a uniform number from a seeded hash; its number of copies is the inverse of a Poisson distribution,
cut at the source's cap, at that number. The rate of a source is its mean repetition, set so that the copies reach the
source's share of the total. Sizes are tokens of a public tokenizer whose rank file is a parameter and is sent to the workers.

The total is that of all sources with a target. A source whose cap does not let it reach its share gives every document
as often as the cap allows, and ``shares`` reports what is short; with ``keep_shares`` the total is lowered instead until
every source reaches its share.

The rates are fitted in the workers on the tokens by source and by bin of the uniform number, at most BINS rows a source; a
few numbers for each source of the targets come to the driver, and these sources must be at most MAX_SOURCES. The thresholds
of the inverse are set on bin edges, so that the shares reported are exactly those of the copies made.

A null text has no tokens and null or unknown sources have no target: neither is used. Repeated document rows are mixed
as rows. A source without documents keeps its target and reaches a share of zero.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut_lineage

BINS = 4096
MAX_SOURCES = 10_000
#: Rank file and pre-tokenizer pattern; any tiktoken rank file can be named instead.
TOKENIZER = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published split pattern of cl100k_base.
PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    """cl100k_base where its file is in the local cache, when asked by that name; otherwise the rank file at ``path``."""
    import tiktoken

    if path == "cl100k_base":
        return tiktoken.get_encoding(path)
    shipped = SparkFiles.get(os.path.basename(path))  # sent by token_count, so that no worker needs the file at its own path
    with open(shipped if os.path.exists(shipped) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(spark: SparkSession, text: F.Column, tokenizer: str = TOKENIZER) -> F.Column:
    if os.path.exists(tokenizer):
        spark.sparkContext.addFile(tokenizer)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(tokenizer).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def _bin(key: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BINS)).cast("int")


def poisson_tails(rate: float, cap: int) -> list[float]:
    """P(copies >= k) for k = 1..cap of a Poisson distribution; exact for large rates too, as terms are taken by their logarithm."""
    if not rate:
        return [0.0] * cap
    tails, below = [], 0.0
    for k in range(cap):
        below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        tails.append(max(0.0, 1 - below))
    return tails


def fit(tokens: list[float], want: float, cap: int) -> tuple[float, list[int]]:
    """Rate and thresholds in bins: a document with bin b has as many copies as thresholds above b. An infinite rate: all at the cap."""
    running = [0.0]
    for v in tokens:
        running.append(running[-1] + v)
    if want >= cap * running[-1]:
        return math.inf, [BINS] * cap

    def edges(rate: float) -> list[int]:
        return [round(t * BINS) for t in poisson_tails(rate, cap)]

    def reached(rate: float) -> float:
        return sum(running[e] for e in edges(rate))

    low, high = 0.0, 1.0
    while reached(high) < want:  # ends, as all tails go to one
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < want else (low, middle)
    # the search ends at a step of one edge; of its two sides the nearer to the wanted size
    best = min((low, high), key=lambda r: abs(reached(r) - want))
    return best, edges(best)


FITTED = "source string, target_share double, max_repeats int, rate double, cuts array<int>, source_tokens double, wanted_tokens double, mixed_tokens double, copies long"


def _fitted(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, tokenizer: str, seed: int, total: float | None, keep_shares: bool) -> list:
    """One row (FITTED) for each source of the targets."""
    spark = docs.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null").dropDuplicates(["source"]).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = {r.source: (float(r.target_share), int(r.max_repeats or 1)) for r in rows}
    known = docs.where(F.col(text).isNotNull()).join(F.broadcast(targets.where("source is not null and target_share is not null").select(F.col("source").alias("_goal")).distinct()), F.col(source) == F.col("_goal"), "left_semi")
    counted = known.select(F.col(source).alias("source"), _bin(key, seed).alias("bin"), token_count(spark, F.col(text), tokenizer).alias("tokens"))
    binned = cut_lineage(counted.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    have = {r.source: float(r.tokens) for r in binned.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    usable = {s: t for s, t in goal.items() if have.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    aim = total if total is not None else sum(have[s] for s in usable)
    if keep_shares and usable:
        aim = min(aim, min(have[s] * cap / share for s, (share, cap) in usable.items()))

    def one(bins: pd.DataFrame) -> pd.DataFrame:
        s = bins["source"].iloc[0]
        share, cap = goal[s]
        tokens, counts = [0.0] * BINS, [0] * BINS
        for b, t, n in zip(bins["bin"], bins["tokens"], bins["docs"]):
            tokens[b], counts[b] = float(t), int(n)
        rate, cuts = fit(tokens, share * aim, cap) if s in usable else (0.0, [])
        row = (s, share, cap, rate, cuts, sum(tokens), share * aim, sum(sum(tokens[:e]) for e in cuts), sum(sum(counts[:e]) for e in cuts))
        return pd.DataFrame([row], columns=[c.split()[0] for c in FITTED.split(", ")])

    found = {r.source: r for r in binned.groupBy("source").applyInPandas(one, FITTED).collect()}
    return [found[s] if s in found else Row(source=s, target_share=share, max_repeats=cap, rate=0.0, cuts=[], source_tokens=0.0, wanted_tokens=share * aim, mixed_tokens=0.0, copies=0) for s, (share, cap) in sorted(goal.items())]


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 17, total: float | None = None, keep_shares: bool = False) -> DataFrame:
    """The mixed corpus, globally shuffled: key, source, copy_no (from 1), shuffle_key, text."""
    fitted = _fitted(docs, targets, key, text, source, tokenizer, seed, total, keep_shares)
    # as many rows as the targets, which are bounded
    limits = docs.sparkSession.createDataFrame([(r.source, list(r.cuts)) for r in fitted], "_source string, _cuts array<int>")
    given = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(source).alias("source"), F.col(text).alias("text"), _bin(key, seed).alias("_bin"))
    picked = given.join(F.broadcast(limits), F.col("source") == F.col("_source")).withColumn("_n", F.size(F.filter("_cuts", lambda e: e > F.col("_bin")))).where("_n > 0")
    exploded = picked.select(key, "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), "text")
    mixed = exploded.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy_no")))
    # a random key spreads hot sources evenly, so a hash exchange and a sort of each part shuffle the whole
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key").select(key, "source", "copy_no", "shuffle_key", "text")


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 17, total: float | None = None, keep_shares: bool = False) -> DataFrame:
    """For each source its target and what the mixture reaches: tokens, share, what is short of the target, copies, most copies of a document, rate."""
    fitted = _fitted(docs, targets, key, text, source, tokenizer, seed, total, keep_shares)
    whole = sum(r.mixed_tokens for r in fitted)
    rows = [
        (r.source, r.target_share, r.max_repeats, r.source_tokens, r.wanted_tokens, r.mixed_tokens, max(0.0, r.wanted_tokens - r.mixed_tokens), r.mixed_tokens / whole if whole else 0.0, r.copies, sum(e > 0 for e in r.cuts), r.rate)
        for r in fitted
    ]
    schema = "source string, target_share double, max_repeats int, source_tokens double, wanted_tokens double, mixed_tokens double, short_tokens double, actual_share double, copies long, most_copies int, rate double"
    return docs.sparkSession.createDataFrame(rows, schema)

"""Answer metrics (prediction against ground truth) as Column expressions, and their aggregates.

Null or empty on either side scores 0 unless stated. NOT_FOUND matches only itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import alnum_tokens

_BLANK = "[ \t\n\r\f]+"
# Weights of the headline score.
HEADLINE = {"llm_judge": 0.40, "containment": 0.25, "numeric_em": 0.25, "token_f1": 0.10}


def _plain(c: Column) -> Column:
    """Lower case, punctuation dropped, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\n\r\f]", ""))


def _guard(p: Column, g: Column, score: Column) -> Column:
    absent = (F.upper(F.trim(p)) == "NOT_FOUND") | (F.upper(F.trim(g)) == "NOT_FOUND")
    same = F.upper(F.trim(p)) == F.upper(F.trim(g))
    return F.when(p.isNull() | g.isNull() | (p == "") | (g == ""), 0.0).when(absent, same.cast("double")).otherwise(F.coalesce(score, F.lit(0.0)))


def exact_match(p: Column, g: Column) -> Column:
    """E1."""
    return _guard(p, g, (_plain(p) == _plain(g)).cast("double"))


def _items(c: Column) -> Column:
    parts = F.split(F.lower(c), r"[,;\n•|]|\band\b")
    return F.array_distinct(F.transform(F.filter(parts, lambda s: F.trim(s) != ""), _plain))


def set_exact_match(p: Column, g: Column) -> Column:
    """Equal sets of the parts between commas, semicolons, line breaks, bullets, bars and the word and."""
    a, b = _items(p), _items(g)
    return _guard(p, g, ((F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)).cast("double"))


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\n\r\f]", ""), _BLANK), lambda w: w != "")


def token_scores(p: Column, g: Column) -> Column:
    """struct(precision, recall, f1): distinct common words over all words of each side."""
    a, b = words(p), words(g)
    common = F.size(F.array_intersect(a, b)).cast("double")
    precision, recall = common / F.nullif(F.size(a), F.lit(0)), common / F.nullif(F.size(b), F.lit(0))
    f1 = 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    return F.struct(_guard(p, g, precision).alias("precision"), _guard(p, g, recall).alias("recall"), _guard(p, g, f1).alias("f1"))


def _numbers(c: Column) -> Column:
    bare = F.regexp_replace(c, "[,$€£]", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"([-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))"), 1), lambda s: s.try_cast("double"))


def numeric_match(p: Column, g: Column, tolerance: float = 0.01) -> Column:
    """Share of the gold numbers that some predicted number meets; without gold numbers the set match."""
    a, b = _numbers(p), _numbers(g)
    met = F.filter(b, lambda n: F.exists(a, lambda m: (F.abs(m - n) / F.greatest(F.abs(n), F.lit(1e-6)) <= tolerance) | (F.abs(m - n) <= 1e-4)))
    share = F.size(met).cast("double") / F.nullif(F.size(b), F.lit(0))
    return F.when(p.isNull() | g.isNull() | (p == "") | (g == ""), 0.0).when(F.size(b) == 0, set_exact_match(p, g)).otherwise(F.coalesce(share, F.lit(0.0)))


def char_similarity(p: Column, g: Column) -> Column:
    """E5: 1 - edit distance over the longer length; 1 if both are blank."""
    a, b = F.lower(F.trim(F.coalesce(p, F.lit("")))), F.lower(F.trim(F.coalesce(g, F.lit(""))))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def containment(p: Column, g: Column) -> Column:
    """Either text, without punctuation, lies in the other."""
    a, b = _plain(p), _plain(g)
    return F.when(p.isNull() | g.isNull() | (a == "") | (b == ""), 0.0).otherwise((a.contains(b) | b.contains(a)).cast("double"))


def answer_match(p: Column, g: Column) -> Column:
    """Gold contained in the prediction, or at least half of the gold's distinct words in it."""
    a, b = F.array_distinct(alnum_tokens(p)), F.array_distinct(alnum_tokens(g))
    share = F.size(F.array_intersect(a, b)) / F.nullif(F.size(b), F.lit(0))
    return F.coalesce(F.lower(p).contains(F.lower(g)) | (share >= 0.5), F.lit(False))


def headline(scores: dict[str, Column], weights: dict[str, float] = HEADLINE) -> Column:
    """E9; a missing field is an error that names it."""
    missing = [k for k in weights if k not in scores]
    if missing:
        raise KeyError(missing[0])
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + scores[k] * w
    return out


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l_score(p: str | None, g: str | None) -> float:
    a, b = (p or "").lower().split(), (g or "").lower().split()
    common = _lcs(a, b) if a and b else 0
    return 2 * common / (len(a) + len(b)) if common else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(p: pd.Series, g: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words."""
    return pd.Series([rouge_l_score(a, b) for a, b in zip(p, g)], dtype="float64")


def _edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(T.LongType())
def word_edits(p: pd.Series, g: pd.Series) -> pd.Series:
    """Edit distance over words, for word error rates."""
    return pd.Series([_edits((a or "").split(), (b or "").split()) for a, b in zip(p, g)], dtype="int64")


def bleu_counts(p: Column, g: Column, n: int) -> Column:
    """struct(match, total) of the n-grams of a prediction, clipped by those of one reference."""
    grams = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(c, i, n)))).otherwise(F.array().cast("array<string>"))
    a, b = grams(words(p)), grams(words(g))
    times = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    matched = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))
    return F.struct(matched.cast("long").alias("match"), F.size(a).cast("long").alias("total"))


def scored(predictions: DataFrame, prediction: str, gold: str) -> DataFrame:
    """The rows with exact_match, set_em, token_f1, numeric_em, char_similarity and containment of one prediction column."""
    p, g = F.col(prediction), F.col(gold)
    return predictions.withColumns({
        "exact_match": exact_match(p, g), "set_em": set_exact_match(p, g), "token_f1": token_scores(p, g)["f1"], "token_precision": token_scores(p, g)["precision"],
        "numeric_em": numeric_match(p, g), "char_similarity": char_similarity(p, g), "containment": containment(p, g),
    })


def _clipped(a: list[str], b: list[str], n: int) -> tuple[int, int]:
    """As ``bleu_counts`` for two lists of words."""
    if len(a) < n:
        return 0, 0
    own = Counter(zip(*(a[i:] for i in range(n))))
    other = Counter(zip(*(b[i:] for i in range(n)))) if len(b) >= n else {}
    return sum(min(v, other[x]) for x, v in own.items() if x in other), len(a) - n + 1


def corpus_bleu(df: DataFrame, p: str = "p", g: str = "g") -> DataFrame:
    """Corpus BLEU-4 in one row from counts summed over all rows; a match of zero counts as 0.1 of a total (first smoothing), no totals give 0."""
    names = [f"{c}{n}" for n in range(1, 5) for c in ("match", "total")] + ["lp", "lg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int | None] = [0] * 8 + [None, None]
        seen = False
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = True
                for k, x in ((8, a), (9, b)):
                    if x is not None:
                        sums[k] = (sums[k] or 0) + len(x)
                for n in range(1, 5):
                    match, total = _clipped(a or [], b or [], n)
                    sums[2 * n - 2] += match
                    sums[2 * n - 1] += total
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in sums], names=names)

    counts = df.select(words(F.col(p)).alias("p"), words(F.col(g)).alias("g")).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    s = counts.agg(*[F.sum(c).alias(c) for c in names])
    logs = F.lit(0.0)
    for n in range(1, 5):
        total = F.greatest(F.col(f"total{n}"), F.lit(1))
        logs = logs + F.log(F.when(F.col(f"match{n}") > 0, F.col(f"match{n}")).otherwise(F.lit(0.1)) / total) / 4
    brevity = F.when(F.col("lp") >= F.col("lg"), 1.0).otherwise(F.exp(1 - F.col("lg") / F.greatest(F.col("lp"), F.lit(1))))
    return s.select(F.when(F.coalesce(F.col("match1"), F.lit(0)) > 0, brevity * F.exp(logs)).otherwise(0.0).alias("bleu"), "lp", "lg")


def cider(df: DataFrame, key: str, p: str, g: str, most: int = 4) -> DataFrame:
    """(key, cider) with one reference each: mean over n of the cosine of TF-IDF weights of n-grams, document frequencies over
    the references, times ten. N-grams are joined by equality and summed by row.
    """
    def grams(c: Column, n: int) -> Column:
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(F.lit(f"{n}:"), F.array_join(F.slice(c, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    base = df.select(key, words(F.col(p)).alias("_p"), words(F.col(g)).alias("_g"))
    many = lambda c: F.concat(*[grams(F.col(c), n) for n in range(1, most + 1)])
    long = base.select(key, F.lit("p").alias("side"), F.explode(many("_p")).alias("gram")).unionByName(base.select(key, F.lit("g").alias("side"), F.explode(many("_g")).alias("gram")))
    tf = long.groupBy(key, "gram").agg(F.sum((F.col("side") == "p").cast("double")).alias("tp"), F.sum((F.col("side") == "g").cast("double")).alias("tg"))
    df_ = tf.where("tg > 0").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n_docs = base.agg(F.log(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")).alias("log_n"))
    idf = F.col("log_n") - F.log(F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)).cast("double"))
    w = tf.join(df_, "gram", "left").crossJoin(F.broadcast(n_docs)).select(key, F.split_part("gram", F.lit(":"), F.lit(1)).alias("n"), (F.col("tp") * idf).alias("wp"), (F.col("tg") * idf).alias("wg"))  # one row
    each = w.groupBy(key, "n").agg(F.sum(F.least("wp", "wg") * F.col("wg")).alias("dot"), F.sqrt(F.sum(F.col("wp") ** 2)).alias("np"), F.sqrt(F.sum(F.col("wg") ** 2)).alias("ng"))
    score = each.groupBy(key).agg((10 * F.sum(F.coalesce(F.col("dot") / F.nullif(F.col("np") * F.col("ng"), F.lit(0.0)), F.lit(0.0))) / most).alias("cider"))
    lengths = base.select(key, F.exp(-((F.size("_p") - F.size("_g")) ** 2) / 72.0).alias("_l"))
    return lengths.join(score, key, "left").select(key, (F.coalesce("cider", F.lit(0.0)) * F.col("_l")).alias("cider"))

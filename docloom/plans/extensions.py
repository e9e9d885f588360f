"""Replaceable steps: encoders, readers, judges and rankers behind small interfaces with offline defaults.

A model call is a function from a batch of strings to a list; it runs in an Arrow function that loads the model once a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import ranking as R


def call_model(load: Callable[[], Callable[[list[str]], list]], returns: T.DataType) -> Callable[[Column], Column]:
    """A column function from ``load``, which is called once a worker and gives the function for a batch."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(["" if t is None else t for t in texts]))

    return run


def offline_encoder(c: Column, size: int = 64) -> Column:
    """Default encoder: hashed token counts, never labelled with a model's name."""
    return V.hashed_embedding(X.entity_tokens(c), size)


def answer_ladder(*answers: Column) -> Column:
    """Q18: the first answer that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(a) != "", a) for a in answers])


def rerank(ranking: DataFrame, score: Column | None = None, k: int = 10) -> DataFrame:
    """Q17: the ranking as it is when there is no scorer, else ordered by the new score."""
    return R.ranked(ranking.drop("rank") if score is None else ranking.drop("rank", "score").withColumn("score", score), k)


def arms(rankings: dict[str, DataFrame], fused: dict[str, list[str]], k: int = 50) -> DataFrame:
    """Q16: all arms in one table with the arm as a column; ``fused`` names arms made of others by rank fusion."""
    ranked = {name: R.ranked(scores, k) for name, scores in rankings.items()}
    ranked |= {name: R.ranked(R.rrf([ranked[p] for p in parts]), k) for name, parts in fused.items()}
    out = None
    for name, df in ranked.items():
        one = df.select(F.lit(name).alias("arm"), "query_id", "item_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


# ---- models by name -------------------------------------------------------------------------------------------------


class Encoders:
    """Q23: encoders by key. Each has the text put before queries and passages, the size of its vectors, and a function from a
    column to vectors; vectors are cut or padded to a common size where asked. ``hashed`` is the offline default.
    """

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[[Column], Column], int, str, str]] = {}
        self.add("hashed", offline_encoder, 64)

    def add(self, key: str, encode: Callable[[Column], Column], size: int, query_prefix: str = "", passage_prefix: str = "") -> None:
        self._known[key] = (encode, size, query_prefix, passage_prefix)

    def encode(self, key: str, c: Column, query: bool = False, size: int | None = None) -> Column:
        """Vectors of a column under an encoder; an unknown key is an error that names the known ones."""
        if key not in self._known:
            raise KeyError(f"no encoder {key}; known: {', '.join(sorted(self._known))}")
        encode, own, before_query, before_passage = self._known[key]
        prefix = before_query if query else before_passage
        vector = encode(F.concat(F.lit(prefix), F.coalesce(c, F.lit(""))) if prefix else c)
        return V.fit_dimension(vector, size) if size and size != own else vector


def mean_pooled(vectors: Column, size: int) -> Column:
    """Q23: mean of an array of token vectors of ``size``; zeros for none."""
    n = F.greatest(F.size(vectors), F.lit(1))
    zero = F.array_repeat(F.lit(0.0), size)
    return F.transform(F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double"))), lambda x: x / n)


def cached_calls(asked: DataFrame, cache: DataFrame, call: Callable[[Column], Column], model: str) -> tuple[DataFrame, DataFrame]:
    """(answers, what is new for the cache). A prompt is asked once, however many rows have it, and only if it is unknown.

    ``asked`` has row_id and prompt, ``cache`` key and response; the key is the MD5 of model and prompt. A call that gives null
    leaves the prompt as its own answer and out of the cache.
    """
    keyed = asked.withColumn("key", F.md5(F.concat(F.lit(f"{model}:"), F.coalesce("prompt", F.lit("")))))
    fresh = keyed.select("key", "prompt").dropDuplicates(["key"]).join(cache, "key", "left_anti").select("key", call(F.col("prompt")).alias("response")).where("response is not null")
    known = cache.select("key", "response").dropDuplicates(["key"]).unionByName(fresh)
    return keyed.join(known, "key", "left").select("row_id", F.coalesce("response", "prompt").alias("response")), fresh


# ---- judges ---------------------------------------------------------------------------------------------------------


def offline_judge(query: Column, answer: Column, gold: Column) -> Column:
    """The token F1 of answer and gold, in place of a judge that is not there; 0 for an empty answer, 1 for an equal one."""
    from docloom.operators import answers as A

    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", 0.0).when(A.exact_match(answer, gold) == 1, 1.0).otherwise(A.token_scores(answer, gold)["f1"]) + F.lit(0.0) * F.length(F.coalesce(query, F.lit("")))


def judged(answers: DataFrame, judges: dict[str, Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """Scores of several judges beside each other, a column for each; a judge is a function of query, answer and gold."""
    return answers.select("*", *[j(F.col("query"), F.col("answer"), F.col("gold")).alias(name) for name, j in judges.items()])


def score_means(scores: DataFrame, names: list[str]) -> DataFrame:
    """Mean and number of the scores of each judge; nulls count nowhere. Rows: judge, mean, n."""
    one = scores.agg(*[F.struct(F.avg(c).alias("mean"), F.count(c).alias("n")).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("judge"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.n").alias("n")) for c in names])).alias("r")).select("r.*")


# ---- captions -------------------------------------------------------------------------------------------------------


def caption_similarity(caption: Column, context: Column) -> Column:
    """Q21, last tier: words of both as a share of the smaller set, 0 for an empty side. A model is put in its place as a column function."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[ \t\n\r\f]+"), lambda w: w != ""))
    a, b = words(caption), words(context)
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def rewritten(caption: Column, context: Column, rewrite: Callable[[Column, Column], Column], least: float = 0.20, similarity: Callable[[Column, Column], Column] = caption_similarity) -> Column:
    """Q22: a caption as it is, or rewritten where it is less similar to its context than ``least``; a rewrite of null keeps it."""
    return F.when(similarity(caption, context) < least, F.coalesce(rewrite(caption, context), caption)).otherwise(caption)


# ---- hybrid retrievers ----------------------------------------------------------------------------------------------


def hybrid(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, encode: Callable[[Column], Column] = offline_encoder, k: int = 50) -> DataFrame:
    """Q11, Q12: rank fusion of BM25 without logarithm and the cosine of an encoder's vectors; a model's encoder makes it Q12.

    Both rankings are cut at ``k`` before they are fused; ties go by item_id.
    """
    asked = R.asked_tokens(queries, query_key, X.entity_tokens(query_text))
    posted, stats = R.asked_index(docs, key, X.entity_tokens(text), asked)
    sparse = R.ranked(R.bm25(posted, asked, stats, log_idf=False).withColumn("score", F.round("score", 9)), k)
    items = docs.select(F.col(key).alias("item_id"), encode(F.col(text)).alias("vector"))
    dense = R.dense_top(items, queries.select(F.col(query_key).alias("query_id"), encode(F.col(query_text)).alias("vector")), k)
    return R.ranked(R.rrf([sparse, dense]), k)

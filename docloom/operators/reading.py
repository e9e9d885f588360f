"""Extractive answers: windows of sentences, the best sentence, spans of a value, the last cell of the best row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X

# The form of a candidate span and of a year.
SPAN = r"\b(?:[$€£]?\d[\d,.]*%?|\d{4}|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
YEAR = re.compile(r"\b20\d{2}\b")
_SPAN = re.compile(SPAN, re.ASCII)


def sentence_windows(c: Column | str, size: int = 3) -> Column:
    """Each sentence of more than five signs with the ``size`` - 1 that follow it, as one text; fewer at the end."""
    s = X.window_sentences(c)
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, i, size), " "))


def best_window(query: Column, text: Column, size: int = 3) -> Column:
    """The first window that holds most of the distinct query tokens; null without a sentence."""
    asked = X.entity_tokens(query)
    windows = F.when(F.size(X.window_sentences(text)) > 0, sentence_windows(text, size))
    scored = F.transform(windows, lambda w, i: F.struct(F.size(F.array_intersect(asked, X.entity_tokens(w))).alias("n"), (-i).alias("first"), w.alias("w")))
    return F.when(F.size(asked) == 0, F.get(X.window_sentences(text), F.lit(0))).otherwise(F.array_max(scored)["w"])


def spans(query: Column, window: Column) -> Column:
    """Distinct numbers and capitalised names of a window, over one sign long, that are no token of the query; in order."""
    asked = X.entity_tokens(query)
    found = F.regexp_extract_all(window, F.lit(SPAN), 0)
    return F.array_distinct(F.filter(found, lambda s: ~F.array_contains(asked, F.lower(s)) & (F.length(s) > 1)))


def answer_span(query: Column, text: Column) -> Column:
    """the first new span of the best window, else its first sentence with a token that is not asked, else the window.

    A text without a sentence gives its first 200 signs, a null text null.
    """
    w = best_window(query, text)
    asked = X.entity_tokens(query)
    fresh = F.filter(X.split_sentences(w, 6), lambda s: F.size(F.array_except(X.entity_tokens(s), asked)) > 0)
    return F.when(w.isNull(), F.substring(text, 1, 200)).otherwise(F.coalesce(F.get(spans(query, w), F.lit(0)), F.get(fresh, F.lit(0)), w))


def _in_order(query: str | None, window: str | None, found: list[str]) -> str | None:
    """Spans by the years of the query: for each year the nearest span of the window, then the others; at most five."""
    if window is None or not len(found):
        return None
    found = list(found)
    years = YEAR.findall(query or "")
    ordered: list[str] = []
    if len(years) >= 2:
        places = {s: window.find(s) for s in found}
        for at in (window.find(y) for y in years):
            if at >= 0:
                near = min(found, key=lambda s: abs(places[s] - at))
                if near not in ordered:
                    ordered.append(near)
    return ", ".join((ordered + [s for s in found if s not in ordered])[:5])


@F.pandas_udf(T.StringType())
def order_spans(query: pd.Series, window: pd.Series, found: pd.Series) -> pd.Series:
    """F29 with several values: see ``_in_order``; the order depends on places already taken."""
    return pd.Series([_in_order(q, w, f if f is not None else []) for q, w, f in zip(query, window, found)], dtype="object")


def best_sentence(query: Column, text: Column) -> Column:
    """the first sentence of more than ten signs with the greatest Jaccard index of its tokens and the query's; else 300 signs."""
    s = X.split_sentences(text, 11)
    cut = F.transform(s, lambda x: F.struct(x.alias("s"), X.entity_tokens(x).alias("own")))  # each cut once

    def best(asked: Column) -> Column:
        met = F.transform(cut, lambda x: F.struct(F.size(F.array_intersect(asked, x["own"])).alias("both"), F.size(x["own"]).alias("n"), x["s"].alias("s")))
        score = lambda x: F.when(x["n"] > 0, x["both"] / (F.size(asked) + x["n"] - x["both"])).otherwise(F.lit(-1.0))
        return F.array_max(F.transform(met, lambda x, i: F.struct(score(x).alias("n"), (-i).alias("first"), x["s"].alias("s"))))["s"]

    return F.when(F.size(s) > 0, F.get(F.transform(F.array(X.entity_tokens(query)), best), F.lit(0))).otherwise(F.substring(text, 1, 300))


def last_cell(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """F32: for each (query_id, table_id) of ``asked`` (with query_tokens) the last cell of the row that shares most tokens.

    The row text is its label and values; a table that shares none gives no row. Ties go to the first row.
    """
    rows = cells.groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "raw_value"))).alias("c"), F.max("row_label").alias("row_label"))
    tokens = X.entity_tokens(F.concat_ws(" ", F.col("row_label"), F.array_join(F.transform("c", lambda x: x["raw_value"]), " ")))
    rows = rows.select("table_id", "row_id", tokens.alias("tokens"), F.element_at("c", -1)["raw_value"].alias("cell"))
    hits = rows.join(asked, "table_id").withColumn("overlap", F.size(F.array_intersect("tokens", "query_tokens"))).where("overlap > 0")
    best = hits.groupBy("query_id", "table_id").agg(F.max("overlap").alias("overlap"), F.min_by(F.struct("row_id", "cell"), F.struct(-F.col("overlap"), F.col("row_id"))).alias("b"))
    return best.select("query_id", "table_id", "b.row_id", "b.cell", "overlap")


def first_answer(raw: Column, enhanced: Column, not_found: tuple[str, ...] = ("NOT_FOUND",)) -> Column:
    """Q20: the answer to the query as asked; where it is empty or not found, that to the query with its directive."""
    missing = F.coalesce(F.trim(raw), F.lit("")).isin("", *not_found)
    return F.when(missing, F.coalesce(enhanced, raw)).otherwise(raw)


def any_chunk_oracle(answers: DataFrame, matches: Column) -> DataFrame:
    """For each query whether any gold chunk gives a matching answer; ``answers`` has one row for each query and chunk."""
    return answers.groupBy("query_id").agg(F.max(F.coalesce(matches, F.lit(False)).cast("int")).alias("oracle"), F.count(F.lit(1)).alias("n_chunks"))


def gold_chunks(chunks: DataFrame, gold: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Distinct (query_id, key) of the chunks whose id holds a gold id (query_id, gold_id), be it equal, a prefix or inside.

    Instead of comparing each id with each gold id, both meet by the last signs of the gold id, as many as the largest power of two
    in its length: an id asks with its parts of these few sizes, and the gold ids it meets are compared in full.
    """
    wanted = gold.where("gold_id is not null and gold_id <> ''").distinct()
    named = wanted.select("gold_id").distinct()
    size = F.pow(F.lit(2.0), F.floor(F.log2(F.length("gold_id").cast("double")))).cast("int")
    anchors = named.withColumn("_n", size).withColumn("_end", F.right("gold_id", F.col("_n")))
    sizes = sorted(r[0] for r in anchors.select("_n").distinct().collect())
    ids = chunks.select(key).where(F.col(key).isNotNull()).distinct()

    def pieces(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.substr(F.col(key), i, F.lit(n)))
        return F.when(F.length(key) >= n, cut).otherwise(F.array().cast("array<string>"))

    if not sizes:
        return chunks.select(key).limit(0).crossJoin(gold.select("query_id").limit(0)).select("query_id", key)
    met = ids.select(key, F.explode(F.array_distinct(F.concat(*map(pieces, sizes)))).alias("_end")).join(anchors, "_end")
    return met.where(F.col(key).contains(F.col("gold_id"))).select(key, "gold_id").distinct().join(wanted, "gold_id").select("query_id", key).distinct()


def ranked_chunks(ranking: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks of a ranking with their rank kept; ids that are not there are dropped."""
    return ranking.join(chunks.dropDuplicates([key]), ranking["item_id"] == chunks[key])


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each left row with the first right row of its keys in a stated order, or none."""
    w = W.partitionBy(*keys).orderBy(*order)
    return left.join(right.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), keys, "left")

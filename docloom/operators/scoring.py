"""Scores of fields, pages, cells and runs, as Column expressions and plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric as N
from docloom.functions import text as X

# Names under which runs report the parts of the headline score.
METRIC_NAMES = {
    "llm_judge": ["llm_judge", "judge", "llm_judge_score"], "containment": ["containment", "contains"], "numeric_em": ["numeric_em", "numeric_exact_match"], "token_f1": ["token_f1", "f1"],
}
CITATION_FIELDS = ["row_label", "column_label", "table_id", "section_path", "page", "bbox"]


def resolved(df: DataFrame, names: dict[str, list[str]] = METRIC_NAMES) -> DataFrame:
    """The metrics of a saved run under their own names, the first known alias first; a run without one is an error."""
    out = df
    for name, aliases in names.items():
        there = [F.col(a).cast("double") for a in aliases if a in df.columns]
        missing = F.raise_error(F.lit(f"no value for {name} under any of {', '.join(aliases)}")).cast("double")
        out = out.withColumn(f"_{name}", F.coalesce(*there, missing))
    return out.select(*[c for c in df.columns if all(c not in a for a in names.values())], *[F.col(f"_{n}").alias(n) for n in names])


def capped_by_oracle(score: Column, oracle: Column, retrieved: Column) -> Column:
    """Where nothing was retrieved, a score is at most half of the oracle's. A null flag counts as retrieved."""
    return F.when(F.coalesce(retrieved, F.lit(True)), score).otherwise(F.least(score, oracle * 0.5))


def page_metrics(ranking: DataFrame, gold: DataFrame, per_page: DataFrame) -> DataFrame:
    """Hit at 1, 3, 5 and 10, reciprocal rank and NDCG at 10 of pages.

    ``ranking`` has query_id, doc, page and rank from 1, ``gold`` query_id, doc and page, ``per_page`` doc, page and n chunks. The ideal
    ranking has as many relevant chunks as lie on the gold pages, at most ten. A query without gold pages scores 0.
    """
    pages = gold.select("query_id", "doc", "page").distinct()
    hits = ranking.where("rank <= 10").join(pages.withColumn("_rel", F.lit(1)), ["query_id", "doc", "page"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = pages.join(per_page, ["doc", "page"], "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_gold"))
    every = ranking.select("query_id").union(gold.select("query_id")).distinct().join(hits, "query_id", "left").join(ideal, "query_id", "left")
    most = F.least(F.coalesce("n_gold", F.lit(0)), F.lit(10)).cast("int")
    idcg = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0)))
    at = lambda k: F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"hit_{k}")
    return every.select("query_id", *map(at, (1, 3, 5, 10)), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / idcg, F.lit(0.0)).alias("ndcg_10"))


def overlap_retrieval(ranking: DataFrame, k: int = 5) -> DataFrame:
    """Recall at ``k`` and reciprocal rank for rows (query_id, rank, elements, gold_elements): a hit shares an element."""
    hit = F.when(F.arrays_overlap("elements", "gold_elements"), F.col("rank"))
    return ranking.groupBy("query_id").agg(F.min(hit).alias("_first")).select("query_id", F.coalesce((F.col("_first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"))


def cell_match(found: Column, gold: Column) -> Column:
    """Equal but for case and outer blanks, or the same base value within 1e-4 in one category (plain numbers fit any)."""
    a, b = F.lower(F.trim(found)), F.lower(F.trim(gold))
    x, y = N.unit_value(a), N.unit_value(b)
    category = (x["category"] == y["category"]) | (x["category"] == "dimensionless") | (y["category"] == "dimensionless")
    return F.coalesce((F.coalesce(found, F.lit("")) != "") & ((a == b) | F.coalesce((F.abs(x["base_value"] - y["base_value"]) < 1e-4) & category, F.lit(False))), F.lit(False))


def citation_complete(**fields: Column) -> Column:
    """Every one of the named fields is there and not blank."""
    full = F.lit(True)
    for c in fields.values():
        full = full & F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    return full


def index_report(results: DataFrame, by: str = "query_type") -> DataFrame:
    """Rates by question type and overall; ``results`` has hit, exact, complete and degenerate as booleans."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    out = results.rollup(by).agg(F.count(F.lit(1)).alias("total_queries"), rate("exact").alias("cell_exact_match"), rate("hit").alias("hit_rate_at_5"), rate("complete").alias("citation_completeness"), rate("degenerate").alias("degeneration"))
    return out.withColumn(by, F.coalesce(by, F.lit("ALL")))


def flat_field(gold: Column, found: Column) -> Column:
    """1 if both are empty, equal, or one holds the other after normalisation; 0 otherwise."""
    a, b = X.normalize_key(F.coalesce(gold, F.lit(""))), X.normalize_key(F.coalesce(found, F.lit("")))
    return F.when((a == "") | (b == ""), ((a == "") & (b == "")).cast("double")).otherwise((a.contains(b) | b.contains(a)).cast("double"))


def _prf(tp: Column, fp: Column, fn: Column, gold_empty: Column, found_empty: Column) -> Column:
    p, r = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)), F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    one = F.when(gold_empty & found_empty, 1.0).when(gold_empty | found_empty, 0.0)
    return F.struct(F.coalesce(one, p).alias("precision"), F.coalesce(one, r).alias("recall"), F.coalesce(one, f).alias("f1"))


def set_field(gold: Column, found: Column) -> Column:
    """Precision, recall and F1 of two arrays as sets of normalised strings; both empty is 1."""
    keys = lambda c: F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != ""), lambda s: X.normalize_key(s)))
    a, b = keys(gold), keys(found)
    both = F.size(F.array_intersect(a, b))
    return _prf(both, F.size(b) - both, F.size(a) - both, F.size(a) == 0, F.size(b) == 0)


def key_specs(gold: Column, found: Column) -> Column:
    """Precision, recall and F1 of two maps: a key of both whose value agrees counts, one whose value does not is wrong.

    Of keys that are equal after normalisation the last one counts.
    """
    let = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731 - computed once, however often f names it
    entries = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(X.normalize_key(e["key"]).alias("key"), X.normalize_key(F.coalesce(e["value"], F.lit(""))).alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda other: other["key"] == e["key"]))
    norm = lambda m: let(entries(m), lambda es: F.map_from_entries(last(es)))

    def score(a: Column, b: Column) -> Column:
        keys, others = F.map_keys(a), F.map_keys(b)
        shared = F.array_intersect(keys, others)
        right = F.size(F.filter(shared, lambda k: a[k].contains(b[k]) | b[k].contains(a[k])))
        return let(right, lambda n: _prf(n, F.size(others) - n, F.size(keys) - F.size(shared), F.size(keys) == 0, F.size(others) == 0))

    return let(norm(gold), lambda a: let(norm(found), lambda b: score(a, b)))


def percent_fault(computed: Column, gold: Column) -> Column:
    """Match, else sign_flip, else scale_100, else formula."""
    bare = F.regexp_replace(F.trim(gold), "%", "")
    value = F.when(bare.rlike("^[-+]?[0-9]+([.][0-9]+)?$"), bare.cast("double"))
    near = lambda x, y: F.coalesce(F.abs(x - y) < 0.05, F.lit(False))
    match = F.coalesce(N.numeric_match(computed, value), F.lit(False))
    return F.when(match, "match").when(near(computed, -value), "sign_flip").when(near(computed * 100, value) | near(computed / 100, value), "scale_100").otherwise("formula")


def routed_report(results: DataFrame) -> DataFrame:
    """For each intent and overall the number of queries and the shares of retrieval, oracle, end-to-end hits and false positives."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    wrong = F.round(F.avg((F.col("answered") & ~F.col("retrieved")).cast("double")), 6)
    right = F.round(F.avg((F.col("answered") & F.col("retrieved")).cast("double")), 6)
    out = results.rollup("intent").agg(F.count(F.lit(1)).alias("n"), share("retrieved").alias("retrieval"), share("oracle").alias("oracle"), right.alias("e2e"), wrong.alias("false_positive"))
    return out.withColumn("intent", F.coalesce("intent", F.lit("ALL")))


def cell_grid_match(gold: DataFrame, found: DataFrame) -> DataFrame:
    """For each table the share of gold cells (table_id, row_no, col_no, cell) that the found grid repeats at the same place."""
    both = gold.join(found.select("table_id", "row_no", "col_no", F.col("cell").alias("_found")), ["table_id", "row_no", "col_no"], "left")
    same = F.coalesce(F.lower(F.trim("cell")) == F.lower(F.trim("_found")), F.lit(False))
    return both.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(same.cast("double")).alias("rate"))


def duplicates(elements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that repeat an earlier row's keys, with the first of them."""
    first = elements.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return elements.join(first, keys).where(F.col(order) != F.col("first")).select(order, "first")


def gap_columns(words: DataFrame, group: list[str], left: str, right: str, key: str, n: str) -> DataFrame:
    """Column of each word from the ``n`` - 1 widest gaps between neighbours from left to right; ``n`` is a column of the row.

    Gaps of a row count as cuts in order of width, ties from the left; the column number counts the cuts up to the word.
    """
    w = W.partitionBy(*group).orderBy(left, right, key)
    gaps = words.withColumn("_gap", F.col(left) - F.max(right).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_at", F.row_number().over(w))
    widest = F.row_number().over(W.partitionBy(*group).orderBy(F.desc_nulls_last("_gap"), "_at"))
    cut = gaps.withColumn("_cut", (F.col("_gap") > 0) & (widest < F.col(n)))
    return cut.withColumn("column_no", F.sum(F.coalesce(F.col("_cut"), F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_gap", "_at", "_cut")

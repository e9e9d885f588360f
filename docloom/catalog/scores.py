"""Scores of fields, pages, cells and runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.functions import text as X
from docloom.operators import scoring as C

query = Catalog()

_N = "lower(replace(replace(replace(trim(coalesce({c}, ''), ' '), '-', ''), '_', ''), ' ', ''))"


def _norm(c: str) -> str:
    return _N.replace("{c}", c)


@query("SELECT l_returnflag AS model, round(avg(l_discount), 6) AS all_mean, coalesce(round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END), 6), 0) AS spec_mean, sum((l_linestatus = 'F')::INT)::BIGINT AS n_spec FROM lineitem GROUP BY 1")
def spec_slice_means(t):
    """A slice's mean beside that of all, in one pass."""
    spec = F.col("l_linestatus") == "F"
    return t("lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.round(F.avg("l_discount"), 6).alias("all_mean"), F.coalesce(F.round(F.avg(F.when(spec, F.col("l_discount"))), 6), F.lit(0.0)).alias("spec_mean"), F.sum(spec.cast("int")).alias("n_spec"))


@query("SELECT coalesce(l_returnflag, 'ALL') AS op, CASE WHEN grouping(l_quantity > 25) = 1 THEN 'ALL' WHEN l_quantity > 25 THEN 'multi' ELSE 'single' END AS kind, count(*) AS n, round(avg(l_discount), 6) AS rate FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_quantity > 25))")
def operation_breakdown(t):
    """A10: by operation, and by single or multiple, from one scan with grouping sets."""
    li = t("lineitem").select(F.col("l_returnflag").alias("op"), F.when(F.col("l_quantity") > 25, "multi").otherwise("single").alias("kind"), "l_discount")
    sets = li.groupingSets([["op"], ["kind"]], "op", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("rate"))
    return sets.select(F.coalesce("op", F.lit("ALL")).alias("op"), F.coalesce("kind", F.lit("ALL")).alias("kind"), "n", "rate")


@query("SELECT coalesce(zone_class, 'none') AS class, sum(coalesce(char_len, 0))::BIGINT AS chars, count(*) AS n FROM medcore_text_gt_flat GROUP BY 1")
def class_sums(t):
    """A13."""
    return t("medcore_text_gt_flat").groupBy(F.coalesce("zone_class", F.lit("none")).alias("class")).agg(F.sum(F.coalesce("char_len", F.lit(0))).cast("long").alias("chars"), F.count(F.lit(1)).alias("n"))


@query("SELECT model, round(avg(v), 6) AS macro FROM (SELECT event_type AS model, unnest([avg(value), avg((value > 10)::INT), avg((user_id % 2)::INT)]) AS v FROM events GROUP BY event_type) GROUP BY model")
def macro_fields(t):
    """Mean over fields of their means."""
    m = t("events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("a"), F.avg((F.col("value") > 10).cast("int")).alias("b"), F.avg((F.col("user_id") % 2).cast("int")).alias("c"))
    return m.select("model", F.round((F.col("a") + F.col("b") + F.col("c")) / 3, 6).alias("macro"))


@query("SELECT source, length(text) AS n_chars, coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+-[ \\t\\n\\r\\f]+[\\p{L}\\p{N}_]+'), lambda m: length(m))), 0)::BIGINT AS flagged, doc_id FROM documents WHERE text IS NOT NULL")
def hyphen_fraction(t):
    """Characters in hyphen-and-space spans against all characters of a text."""
    d = t("documents").where("text is not null")
    spans = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+-[ \t\n\r\f]+[\p{L}\p{N}_]+"), 0)
    return d.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.aggregate(F.transform(spans, lambda m: F.length(m).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("flagged"))


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def confidence_range(t):
    """A22."""
    return t("events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, count(*) AS n, round(count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0), 9) AS per_second, round(avg((event_type = 'view')::INT), 6) AS cache_hit_rate FROM events GROUP BY user_id")
def throughput(t):
    """Events a second and the share of hits."""
    e = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("us"), F.round(F.avg((F.col("event_type") == "view").cast("int")), 6).alias("cache_hit_rate"))
    return e.select("user_id", "n", F.round(F.col("n") / F.nullif(F.col("us") / 1e6, F.lit(0.0)), 9).alias("per_second"), "cache_hit_rate")


@query("SELECT p_brand AS model, round(sum(l_quantity * p_retailprice), 2) AS cost, round(avg(l_tax), 6) AS latency FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def token_cost(t):
    """Amounts times the price of their kind."""
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("model")).agg(F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("cost"), F.round(F.avg("l_tax"), 6).alias("latency"))


@query("WITH z AS (SELECT DISTINCT id, doc_name, page, bbox_norm FROM medcore_text_gt_flat WHERE bbox_norm IS NOT NULL), f AS (SELECT page, bbox_norm, min(id) AS first, count(*) AS n FROM z WHERE page IS NOT NULL GROUP BY ALL) SELECT id, first FROM z JOIN f USING (page, bbox_norm) WHERE n > 1 AND id <> first")
def duplicate_boxes(t):
    """A27."""
    z = t("medcore_text_gt_flat").where("bbox_norm is not null").select("id", "doc_name", "page", "bbox_norm").distinct()
    return C.duplicates(z, ["page", "bbox_norm"], "id")


@query("SELECT a.l_orderkey AS k, a.l_linenumber AS line, round(a.l_tax + o.o_totalprice, 4) AS both FROM lineitem a JOIN orders o ON a.l_orderkey = o.o_orderkey AND a.l_shipdate > o.o_orderdate AND o.o_orderstatus = a.l_linestatus")
def merged_scores(t):
    """Two score tables merged on several keys."""
    a, o = t("lineitem"), t("orders").withColumnRenamed("o_orderstatus", "l_linestatus")
    j = a.join(o, (a["l_orderkey"] == o["o_orderkey"]) & (a["l_linestatus"] == o["l_linestatus"]) & (a["l_shipdate"] > o["o_orderdate"]))
    return j.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.round(F.col("l_tax") + F.col("o_totalprice"), 4).alias("both"))


@query("SELECT round(0.40 * avg(l_tax) + 0.25 * avg(l_discount) + 0.25 * avg(l_discount) + 0.10 * avg(l_tax), 8) AS headline, l_linestatus AS run FROM lineitem GROUP BY l_linestatus")
def headline_of_run(t):
    """A run's metrics under other names than the score's own."""
    from docloom.operators.answers import headline

    runs = t("lineitem").groupBy(F.col("l_linestatus").alias("run")).agg(F.avg("l_tax").alias("judge"), F.avg("l_discount").alias("contains"), F.avg("l_discount").alias("numeric_exact_match"), F.avg("l_tax").alias("f1"))
    r = C.resolved(runs)
    return r.select("run", F.round(headline({c: F.col(c) for c in ("llm_judge", "containment", "numeric_em", "token_f1")}), 8).alias("headline"))


@query("WITH p AS (SELECT DISTINCT query_id, ground_truth AS g, e2e_prediction AS p, oracle_prediction AS o, retrieval_success AS r FROM predictions), s AS (SELECT query_id, r, coalesce(contains(lower(p), lower(g)), false)::INT::DOUBLE AS e, coalesce(contains(lower(o), lower(g)), false)::INT::DOUBLE AS o FROM p) SELECT query_id, CASE WHEN coalesce(r, true) THEN e ELSE least(e, o * 0.5) END AS score FROM s")
def capped_scores(t):
    """E11."""
    p = t("predictions").select("query_id", "ground_truth", "e2e_prediction", "oracle_prediction", "retrieval_success").distinct()
    has = lambda c: F.coalesce(F.lower(c).contains(F.lower("ground_truth")), F.lit(False)).cast("double")
    return p.select("query_id", C.capped_by_oracle(has("e2e_prediction"), has("oracle_prediction"), F.col("retrieval_success")).alias("score"))


_CH = "c AS (SELECT chunk_id, regexp_replace(min(doc_filename), '[.]pdf$', '') AS doc, min(page) AS page, min(length(text)) AS n FROM chunks WHERE page IS NOT NULL AND doc_filename IS NOT NULL GROUP BY chunk_id)"


@query(
    f"WITH {_CH}, q AS (SELECT DISTINCT query_id, doc_stem AS doc, (length(query) % 40 + 1)::INT AS page FROM predictions WHERE query IS NOT NULL AND doc_stem IS NOT NULL), r AS (SELECT q.query_id, c.doc, c.page, row_number() OVER (PARTITION BY q.query_id ORDER BY abs(c.page - q.page - 1), c.n, c.chunk_id) AS rank FROM q JOIN c ON q.doc = c.doc), "
    "pg AS (SELECT doc, page, count(*) AS n FROM c GROUP BY ALL), h AS (SELECT r.query_id, min(rank) AS first, sum(1.0 / log2(rank + 1.0)) AS dcg FROM r JOIN q ON r.query_id = q.query_id AND r.doc = q.doc AND r.page = q.page WHERE rank <= 10 GROUP BY 1), i AS (SELECT q.query_id, coalesce(sum(n), 0) AS n FROM q LEFT JOIN pg USING (doc, page) GROUP BY 1) "
    "SELECT q.query_id, coalesce((first <= 1)::INT, 0)::DOUBLE AS hit_1, coalesce((first <= 3)::INT, 0)::DOUBLE AS hit_3, coalesce((first <= 5)::INT, 0)::DOUBLE AS hit_5, coalesce((first <= 10)::INT, 0)::DOUBLE AS hit_10, round(coalesce(1.0 / first, 0), 8) AS mrr, round(coalesce(dcg / nullif(list_sum(list_transform(range(1, least(i.n, 10)::INT + 1), lambda x: 1.0 / log2(x + 1.0))), 0), 0), 8) AS ndcg_10 FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN h USING (query_id) LEFT JOIN i USING (query_id)"
)
def page_metrics(t):
    """Chunks of the asked file ranked by their distance to the page after the gold page."""
    c = t("chunks").where("page is not null and doc_filename is not null").groupBy("chunk_id").agg(F.regexp_replace(F.min("doc_filename"), "[.]pdf$", "").alias("doc"), F.min("page").alias("page"), F.min(F.length("text")).alias("n"))
    q = t("predictions").where("query is not null and doc_stem is not null").select("query_id", F.col("doc_stem").alias("doc"), (F.length("query") % 40 + 1).cast("int").alias("gold")).distinct()
    # a file may be asked for by a tenth of all questions and hold a tenth of all chunks: the ten best of a page and of a gold page do
    place = [F.abs(F.col("page") - F.col("gold") - 1), "n", "chunk_id"]
    first = lambda df, by, order: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("rank <= 10")
    near = first(c, ["doc", "page"], ["n", "chunk_id"]).drop("rank")
    of_page = first(q.select("doc", "gold").distinct().join(near, "doc"), ["doc", "gold"], place).drop("rank")
    ranking = first(q.join(of_page, ["doc", "gold"]), ["query_id"], place)
    m = C.page_metrics(ranking.select("query_id", "doc", "page", "rank"), q.withColumnRenamed("gold", "page"), c.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n")))
    return m.withColumns({"mrr": F.round("mrr", 8), "ndcg_10": F.round("ndcg_10", 8)})


@query("WITH c AS (SELECT DISTINCT chunk_id, doc_filename, source_element_indices AS e FROM chunks WHERE source_element_indices IS NOT NULL AND doc_filename IS NOT NULL), g AS (SELECT doc_filename, [arg_min(e, (chunk_id, e))[-1]] AS gold FROM c GROUP BY 1), r AS (SELECT doc_filename AS query_id, row_number() OVER (PARTITION BY doc_filename ORDER BY chunk_id DESC, e DESC) AS rank, list_has_any(e, gold) AS hit FROM c JOIN g USING (doc_filename)) SELECT query_id, coalesce((min(CASE WHEN hit THEN rank END) <= 5)::INT, 0)::DOUBLE AS recall_5, round(coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0), 8) AS mrr FROM r GROUP BY 1")
def overlap_retrieval(t):
    """Chunks of a file in reverse order, asked for an element of the first."""
    c = t("chunks").where("source_element_indices is not null and doc_filename is not null").select("chunk_id", "doc_filename", F.col("source_element_indices").alias("elements")).distinct()
    gold = c.groupBy("doc_filename").agg(F.array(F.element_at(F.min_by("elements", F.struct("chunk_id", "elements")), -1)).alias("gold_elements"))
    w = W.partitionBy("doc_filename").orderBy(F.desc("chunk_id"), F.desc("elements"))
    r = c.withColumn("rank", F.row_number().over(w)).join(gold, "doc_filename").withColumnRenamed("doc_filename", "query_id")
    return C.overlap_retrieval(r).withColumn("mrr", F.round("mrr", 8))


@query(
    "WITH m AS (SELECT table_id, min(section_path) AS section_path, min(page) AS page FROM table_metadata GROUP BY 1), c AS (SELECT DISTINCT cell_id, row_label, column_label, table_id, raw_value, norm_string, bbox_json FROM table_cells), "
    "r AS (SELECT coalesce(column_label, 'none') AS query_type, coalesce(lower(trim(raw_value, ' ')) = lower(trim(norm_string, ' ')), false) AS exact, coalesce(trim(row_label, ' ') <> '', false) AND coalesce(trim(column_label, ' ') <> '', false) AND coalesce(trim(section_path, ' ') <> '', false) AND page IS NOT NULL AND coalesce(trim(bbox_json, ' ') <> '', false) AS complete, length(raw_value) > 12 AS degenerate FROM c LEFT JOIN m USING (table_id)) "
    "SELECT coalesce(query_type, 'ALL') AS query_type, count(*) AS total_queries, round(avg(exact::INT), 4) AS cell_exact_match, round(avg(complete::INT), 4) AS hit_rate_at_5, round(avg(complete::INT), 4) AS citation_completeness, round(avg(degenerate::INT), 4) AS degeneration FROM r GROUP BY ROLLUP (query_type)"
)
def index_report(t):
    """Cells with their citation and normal form, by column."""
    m = t("table_metadata").groupBy("table_id").agg(F.min("section_path").alias("section_path"), F.min("page").alias("page"))
    c = t("table_cells").select("cell_id", "row_label", "column_label", "table_id", "raw_value", "norm_string", "bbox_json").distinct().join(m, "table_id", "left")
    complete = C.citation_complete(row_label=F.col("row_label"), column_label=F.col("column_label"), table_id=F.col("table_id"), section_path=F.col("section_path"), page=F.col("page"), bbox=F.col("bbox_json"))
    same = F.coalesce(F.lower(F.trim("raw_value")) == F.lower(F.trim("norm_string")), F.lit(False))
    return C.index_report(c.select(F.coalesce("column_label", F.lit("none")).alias("query_type"), same.alias("exact"), complete.alias("hit"), complete.alias("complete"), (F.length("raw_value") > 12).alias("degenerate")))


@query("SELECT count(*) AS n, sum(exact::INT)::BIGINT AS exact FROM (SELECT DISTINCT cell_id, raw_value, norm_string, coalesce(raw_value, '') <> '' AND coalesce(lower(trim(raw_value, ' ')) = lower(trim(norm_string, ' ')), false) AS exact FROM table_cells)")
def cell_matches_plain(t):
    """Cells equal to their normal form by case and blanks; a lower bound of the match by units, which the tests cover."""
    c = t("table_cells").select("cell_id", "raw_value", "norm_string").distinct()
    by_unit = C.cell_match(F.col("raw_value"), F.col("norm_string"))
    plain = (F.coalesce("raw_value", F.lit("")) != "") & F.coalesce(F.lower(F.trim("raw_value")) == F.lower(F.trim("norm_string")), F.lit(False))
    return c.agg(F.count(F.lit(1)).alias("n"), F.sum((plain & by_unit).cast("int")).alias("exact"))


@query(f"SELECT DISTINCT query_id, CASE WHEN {_norm('ground_truth')} = '' OR {_norm('e2e_prediction')} = '' THEN ({_norm('ground_truth')} = '' AND {_norm('e2e_prediction')} = '')::INT::DOUBLE ELSE (contains({_norm('ground_truth')}, {_norm('e2e_prediction')}) OR contains({_norm('e2e_prediction')}, {_norm('ground_truth')}))::INT::DOUBLE END AS score FROM predictions")
def flat_fields(t):
    """E36."""
    return t("predictions").select("query_id", C.flat_field(F.col("ground_truth"), F.col("e2e_prediction")).alias("score")).distinct()


_SETS = f"s AS (SELECT table_id, list_distinct(list({_norm('column_label')}) FILTER (WHERE coalesce(column_label, '') <> '')) AS a, list_distinct(list({_norm('norm_string')}) FILTER (WHERE coalesce(norm_string, '') <> '')) AS b0 FROM table_cells GROUP BY 1), h AS (SELECT table_id, list_distinct(list_transform(header_schema_json::JSON::VARCHAR[], lambda x: {_norm('x')})) AS b FROM table_metadata), k AS (SELECT table_id, coalesce(a, []) AS a, coalesce(b, []) AS b, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS tp FROM s JOIN h USING (table_id))"


@query(f"WITH {_SETS}, p AS (SELECT table_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE tp / len(b) END AS precision, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE tp / len(a) END AS recall FROM k) SELECT table_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM p")
def set_fields(t):
    """Column labels of the cells of a table against its header."""
    cells = t("table_cells").groupBy("table_id").agg(F.collect_set("column_label").alias("a"))
    head = t("table_metadata").select("table_id", F.from_json("header_schema_json", "array<string>").alias("b"))
    j = cells.join(head, "table_id").select("table_id", C.set_field(F.col("a"), F.col("b")).alias("s"))
    return j.select("table_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def key_specs(t):
    """Values of each row against their normal forms, as maps; checked against a brute force in the tests."""
    from docloom.operators.tables import row_maps

    rows = row_maps(t("table_cells"), {"gold": "raw_value", "found": "norm_string"}).where("row_id is not null")
    return rows.select("row_id", C.key_specs(F.col("gold"), F.col("found")).alias("s")).select("row_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH c AS (SELECT DISTINCT cell_id, norm_numeric AS computed, CASE WHEN regexp_full_match(trim(raw_value, ' '), '[-+]?[0-9]+([.][0-9]+)?') THEN raw_value::DOUBLE END AS g, raw_value FROM table_cells WHERE norm_numeric IS NOT NULL AND NOT isnan(norm_numeric)), f AS (SELECT CASE WHEN coalesce(abs(computed - g) <= 0.01 OR abs(computed - g) / greatest(1.0, abs(g)) <= 0.001 OR abs(computed * 100 - g) <= 0.01 OR abs(computed - g * 100) <= 0.01, false) THEN 'match' WHEN coalesce(abs(computed + g) < 0.05, false) THEN 'sign_flip' WHEN coalesce(abs(computed * 100 - g) < 0.05 OR abs(computed / 100 - g) < 0.05, false) THEN 'scale_100' ELSE 'formula' END AS fault FROM c WHERE g IS NOT NULL) SELECT fault, count(*) AS n FROM f GROUP BY 1")
def percent_faults(t):
    """Stored numbers against those in the cells."""
    c = t("table_cells").where("norm_numeric is not null and not isnan(norm_numeric)").select("cell_id", "norm_numeric", "raw_value").distinct()
    plain = c.where(F.trim("raw_value").rlike("^[-+]?[0-9]+([.][0-9]+)?$"))
    return plain.groupBy(C.percent_fault(F.col("norm_numeric"), F.col("raw_value")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT DISTINCT query_id, coalesce(query_type, 'none') AS intent, coalesce(retrieval_success, false) AS r, coalesce(contains(lower(oracle_prediction), lower(ground_truth)), false) AS o, coalesce(contains(lower(e2e_prediction), lower(ground_truth)), false) AS a FROM predictions) SELECT coalesce(intent, 'ALL') AS intent, count(*) AS n, round(avg(r::INT), 6) AS retrieval, round(avg(o::INT), 6) AS oracle, round(avg((a AND r)::INT), 6) AS e2e, round(avg((a AND NOT r)::INT), 6) AS false_positive FROM p GROUP BY ROLLUP (intent)")
def routed_report(t):
    """E44."""
    has = lambda c: F.coalesce(F.lower(c).contains(F.lower("ground_truth")), F.lit(False))
    p = t("predictions").select("query_id", F.coalesce("query_type", F.lit("none")).alias("intent"), F.coalesce("retrieval_success", F.lit(False)).alias("retrieved"), has("oracle_prediction").alias("oracle"), has("e2e_prediction").alias("answered")).distinct()
    return C.routed_report(p)


@query("WITH c AS (SELECT DISTINCT table_id, row_id, cell_id, raw_value, norm_string FROM table_cells), g AS (SELECT table_id, coalesce(lower(trim(raw_value, ' ')) = lower(trim(norm_string, ' ')), false) AS same FROM c WHERE raw_value IS NOT NULL) SELECT table_id, count(*) AS n_cells, round(avg(same::INT), 6) AS rate FROM g GROUP BY 1")
def grid_exact_match(t):
    """Cells as written against their normal forms, place by place."""
    c = t("table_cells").select("table_id", F.col("row_id").alias("row_no"), F.col("cell_id").alias("col_no"), "raw_value", "norm_string").distinct()
    gold = c.where("raw_value is not null").select("table_id", "row_no", "col_no", F.col("raw_value").alias("cell"))
    found = c.select("table_id", "row_no", "col_no", F.col("norm_string").alias("cell"))
    return C.cell_grid_match(gold, found).withColumn("rate", F.round("rate", 6))


@query("WITH z AS (SELECT DISTINCT id, doc_name, page, (bbox_norm::JSON->>'x')::DOUBLE AS x, (bbox_norm::JSON->>'x')::DOUBLE + (bbox_norm::JSON->>'w')::DOUBLE AS r FROM medcore_text_gt_flat WHERE bbox_norm IS NOT NULL AND doc_name IS NOT NULL AND page IS NOT NULL), g AS (SELECT *, x - max(r) OVER (PARTITION BY doc_name, page ORDER BY x, r, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, row_number() OVER (PARTITION BY doc_name, page ORDER BY x, r, id) AS pos FROM z), c AS (SELECT *, coalesce(gap > 0 AND row_number() OVER (PARTITION BY doc_name, page ORDER BY gap DESC NULLS LAST, pos) < 3, false) AS cut FROM g) SELECT id, sum(cut::INT) OVER (PARTITION BY doc_name, page ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS column_no FROM c")
def gap_columns(t):
    """Three columns from the two widest gaps between the zones of a page."""
    box = F.from_json("bbox_norm", "x double, y double, w double, h double")
    z = t("medcore_text_gt_flat").where("bbox_norm is not null and doc_name is not null and page is not null").select("id", "doc_name", "page", box["x"].alias("x"), (box["x"] + box["w"]).alias("r"), F.lit(3).alias("n")).distinct()
    return C.gap_columns(z, ["doc_name", "page"], "x", "r", "id", "n").select("id", F.col("column_no").cast("long").alias("column_no"))


@query("WITH h AS (SELECT row_id, table_id, count(DISTINCT token) AS hits FROM (SELECT row_id, table_id, unnest(regexp_extract_all(lower(concat_ws(' ', row_label, column_label, raw_value)), '[a-z0-9]+')) AS token FROM table_cells) WHERE token IN ('steel', 'titanium', 'max') GROUP BY ALL) SELECT table_id, arg_max(row_id, (hits, row_id)) AS row_id, max(hits) AS hits FROM h GROUP BY 1")
def best_row_of_table(t):
    """A2: the row with most distinct query tokens, within each table by itself."""
    tokens = X.alnum_tokens(F.concat_ws(" ", F.col("row_label"), F.col("column_label"), F.col("raw_value")))
    k = t("table_cells").select("row_id", "table_id", F.explode(tokens).alias("token")).where(F.col("token").isin("steel", "titanium", "max"))
    h = k.groupBy("row_id", "table_id").agg(F.count_distinct("token").alias("hits"))
    return h.groupBy("table_id").agg(F.max_by("row_id", F.struct("hits", "row_id")).alias("row_id"), F.max("hits").alias("hits"))

"""Rankers, fusion, ranking metrics and the table store."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.catalog.texts import _CATEGORY, _SCALE, entity_sql
from docloom.functions import numeric as N
from docloom.functions import text as X
from docloom.operators import ranking as R
from docloom.operators import tables as T

query = Catalog()

_POSTED = f"d AS (SELECT doc_id, {entity_sql('text')} AS toks FROM documents), posted AS (SELECT doc_id AS item_id, unnest(toks) AS token, len(toks) AS dl FROM d), stats AS (SELECT count(*) AS n, avg(len(toks)) AS avg_dl FROM d), asked AS (SELECT question_id AS query_id, unnest({entity_sql('question')}) AS token FROM qa_bank), df AS (SELECT token, count(*) AS df FROM posted GROUP BY token)"
_TOP = "SELECT query_id, item_id, round(score, 8) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 10"
_BM25 = "s0 AS (SELECT query_id, item_id, sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / greatest(1.0, avg_dl)))) AS score FROM posted JOIN df USING (token) JOIN asked USING (token), stats, LATERAL (SELECT {idf} AS idf) GROUP BY ALL), s AS (SELECT * FROM s0)"
_LOG = _BM25.replace("{idf}", "ln((n - df + 0.5) / (df + 0.5) + 1)")
_RAW = _BM25.replace("{idf}", "greatest(0.0, (n - df + 0.5) / (df + 0.5))")


def _bank(t):
    """Postings of the tokens that the test items ask for, those tokens, and the size of the collection; the texts are cut once."""
    asked = R.asked_tokens(t("qa_bank"), "question_id", X.entity_tokens("question"))
    posted, stats = R.asked_index(t("documents"), "doc_id", X.entity_tokens("text"), asked)
    return posted, asked, stats


def _all_postings(t):
    return R.entity_postings(t("documents"), "doc_id", "text")


def _top(scores, k=10):
    """The first ``k`` by the score to nine decimals, shown with eight of the score itself."""
    top = R.ranked(scores.withColumnRenamed("score", "_score").withColumn("score", F.round("_score", 9)), k)
    return top.select("query_id", "item_id", F.round("_score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_POSTED} SELECT token, count(*) AS df, min(item_id) AS first_item FROM posted GROUP BY token")
def postings(t):
    return R.entity_postings(t("documents"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("item_id").alias("first_item"))


@query("SELECT token, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL) GROUP BY token")
def doc_freq(t):
    """A5."""
    return R.postings(t("documents"), "doc_id", X.alnum_tokens("text"), binary=False).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


@query(f"WITH {_POSTED}, {_LOG} {_TOP}")
def bm25_top10(t):
    """Q1, X6."""
    return _top(R.bm25(*_bank(t)))


@query(f"WITH {_POSTED}, {_RAW} {_TOP}")
def bm25_nolog_top10(t):
    return _top(R.bm25(*_bank(t), log_idf=False))


@query(f"WITH {_POSTED}, s AS (SELECT query_id, item_id, count(*)::DOUBLE AS score FROM posted JOIN asked USING (token) GROUP BY ALL) {_TOP}")
def overlap_top10(t):
    posted, asked, _ = _bank(t)
    return _top(R.overlap(posted, asked))


_TFIDF = "idf AS (SELECT token, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df, stats), norms AS (SELECT item_id, sqrt(sum(idf * idf)) AS nrm FROM posted JOIN idf USING (token) GROUP BY item_id), q AS (SELECT query_id, token, idf AS q FROM asked JOIN idf USING (token)), qn AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM q GROUP BY query_id), s AS (SELECT query_id, item_id, dot / (nrm * qn) AS score FROM (SELECT query_id, item_id, sum(idf * q) AS dot FROM posted JOIN idf USING (token) JOIN q USING (token) GROUP BY ALL) JOIN norms USING (item_id) JOIN qn USING (query_id))"


@query(f"WITH {_POSTED}, {_TFIDF} {_TOP}")
def tfidf_cosine_top10(t):
    _, asked, stats = _bank(t)
    return _top(R.tfidf(_all_postings(t), asked, stats))


_DENSE = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM v, (SELECT * FROM v WHERE vec_id % 20 = 0) q)"


def _dense(t):
    items = t("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    return items, items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


@query(f"WITH {_DENSE} {_TOP}")
def dense_top10(t):
    """Queries: every vector whose id is divisible by 20, against all."""
    top = R.dense_top(*_dense(t), 10)
    return top.select("query_id", "item_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DENSE}, r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s), g AS (SELECT query_id, item_id FROM s, embeddings a, embeddings b WHERE a.vec_id = query_id AND b.vec_id = item_id AND a.label = b.label AND query_id <> item_id), f AS (SELECT g.query_id, min(rank) AS first FROM g JOIN (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE query_id <> item_id) r ON r.query_id = g.query_id AND r.item_id = g.item_id GROUP BY g.query_id) SELECT query_id, (first <= 1)::INT::DOUBLE AS hit_1, (first <= 5)::INT::DOUBLE AS hit_5, (first <= 10)::INT::DOUBLE AS hit_10, round(1.0 / first, 6) AS mrr, round(CASE WHEN first <= 10 THEN 1 / log2(first + 1) ELSE 0 END, 6) AS ndcg_10 FROM f")
def hit_mrr_ndcg(t):
    """Nearest vectors of the same label, the query itself left out."""
    items, asked = _dense(t)
    # queries without another item of their label are none of the gold standard
    several = items.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and label is not null")
    first = R.first_relevant(items, asked)
    m = R.first_hit_metrics(asked.join(several, "label", "left_semi").select("query_id").distinct().join(first, "query_id", "left"))
    return m.select("query_id", "hit_1", "hit_5", "hit_10", F.round("mrr", 6).alias("mrr"), F.round("ndcg_10", 6).alias("ndcg_10"))


_RRF = "r1 AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM a QUALIFY rank <= 50), r2 AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM b QUALIFY rank <= 50)"


@query(f"WITH {_POSTED}, {_LOG.replace('s AS (SELECT * FROM s0)', 'a AS (SELECT * FROM s0)')}, b AS (SELECT query_id, item_id, count(*)::DOUBLE AS score FROM posted JOIN asked USING (token) GROUP BY ALL), {_RRF}, s AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL) {_TOP}")
def rrf_two_way(t):
    """Q9, U1, U2, X7."""
    posted, asked, stats = _bank(t)
    lists = [R.ranked(s.withColumn("score", F.round("score", 9)), 50) for s in (R.bm25(posted, asked, stats), R.overlap(posted, asked))]
    return _top(R.rrf(lists))


@query(f"WITH {_POSTED}, {_LOG.replace('s AS (SELECT * FROM s0)', 'a AS (SELECT * FROM s0)')}, b AS (SELECT query_id, item_id, count(*)::DOUBLE AS score FROM posted JOIN asked USING (token) GROUP BY ALL), {_TFIDF.replace(', s AS (SELECT', ', c AS (SELECT')}, {_RRF}, r3 AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM c QUALIFY rank <= 50), s AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY ALL) {_TOP}")
def rrf_three_way(t):
    posted, asked, stats = _bank(t)
    lists = [R.ranked(s.withColumn("score", F.round("score", 9)), 50) for s in (R.bm25(posted, asked, stats), R.overlap(posted, asked), R.tfidf(_all_postings(t), asked, stats))]
    return _top(R.rrf(lists))


@query("SELECT coalesce(query_type, 'ALL') AS query_type, avg(ok) AS recall, count(*) AS n FROM (SELECT coalesce(query_type, 'none') AS query_type, retrieval_success::INT AS ok FROM predictions WHERE retrieval_success IS NOT NULL) GROUP BY ROLLUP (query_type)")
def recall_by_type_rollup(t):
    """A8."""
    p = t("predictions").where("retrieval_success is not null").select(F.coalesce("query_type", F.lit("none")).alias("query_type"), F.col("retrieval_success").cast("int").alias("ok"))
    return p.rollup("query_type").agg(F.avg("ok").alias("recall"), F.count(F.lit(1)).alias("n")).withColumn("query_type", F.coalesce("query_type", F.lit("ALL")))


_INDEX = f"idx AS (SELECT DISTINCT row_id, table_id, unnest({entity_sql('z')}) AS token FROM (SELECT row_id, table_id, concat_ws(' ', row_label, column_label, raw_value) AS z FROM table_cells)), asked AS (SELECT DISTINCT query_id, unnest({entity_sql('query')}) AS token FROM (SELECT DISTINCT query_id, query FROM predictions WHERE try_cast(right(query_id, 7) AS BIGINT) % 20 = 0))"


@query(f"WITH {_INDEX} SELECT token, count(*) AS n_rows FROM idx GROUP BY token")
def entity_index(t):
    return T.row_tokens(t("table_cells")).groupBy("token").agg(F.count(F.lit(1)).alias("n_rows"))


def _asked(t):
    """These searches ask with every question whose number is divisible by 20, against all rows."""
    return t("predictions").where("try_cast(right(query_id, 7) as bigint) % 20 = 0").select("query_id", F.explode(X.entity_tokens("query")).alias("token")).distinct()


_EVERY = _INDEX.replace(" WHERE try_cast(right(query_id, 7) AS BIGINT) % 20 = 0", "")


@query(f"WITH {_EVERY}, h AS (SELECT query_id, row_id, table_id, count(DISTINCT token) AS hit_count FROM idx JOIN asked USING (token) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, row_id, table_id) AS rank FROM h QUALIFY rank <= 5")
def entity_lookup_top5(t):
    """Every question against all rows."""
    index = T.row_tokens(t("table_cells"))
    known = T.known_tokens(index, t("predictions").select("query_id", F.explode(X.entity_tokens("query")).alias("token")))
    return known.join(T.lookup_sets(index, known, 5), "key").select("query_id", "row_id", "table_id", "hit_count", F.col("rank").cast("long").alias("rank"))


_PRED = f"pred AS (SELECT chunk_id AS query_id, op, v::DOUBLE * coalesce({_SCALE}[u], 1.0) AS target, {_CATEGORY}[u] AS category FROM (SELECT DISTINCT chunk_id, regexp_extract(text, '([><]=?|=)[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([a-zA-Z°μµ%]+)?', 1) AS op, regexp_extract(text, '([><]=?|=)[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([a-zA-Z°μµ%]+)?', 2) AS v, lower(regexp_extract(text, '([><]=?|=)[ \\t\\n]*([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([a-zA-Z°μµ%]+)?', 3)) AS u FROM chunks) WHERE op <> '' AND {_CATEGORY}[u] IS NOT NULL UNION ALL SELECT 'over_' || category, '>=', lim, category FROM (VALUES ('voltage', 100.0::DOUBLE), ('power', 500.0), ('length', 1.0), ('memory', 64.0)) AS l(category, lim))"


@query(f"WITH {_PRED}, c AS (SELECT DISTINCT cell_id, table_id, norm_numeric, unit_category FROM table_cells), h AS (SELECT query_id, cell_id, table_id, norm_numeric FROM c JOIN pred ON unit_category = category AND CASE op WHEN '>' THEN norm_numeric > target WHEN '>=' THEN norm_numeric >= target WHEN '<' THEN norm_numeric < target WHEN '<=' THEN norm_numeric <= target ELSE norm_numeric = target END), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY norm_numeric, cell_id) AS rank FROM h QUALIFY rank <= 5) SELECT query_id, cell_id, rank, doc_name, page::BIGINT AS page FROM r JOIN table_metadata USING (table_id)")
def predicate_range_lookup(t):
    """T4."""
    p = t("chunks").select(F.col("chunk_id").alias("query_id"), N.predicate("text").alias("p")).where("p.op is not null").select("query_id", "p.op", "p.target", "p.category").distinct()
    limits = t("chunks").sparkSession.createDataFrame([("voltage", 100.0), ("power", 500.0), ("length", 1.0), ("memory", 64.0)], "category string, target double")
    p = p.unionByName(limits.select(F.concat(F.lit("over_"), "category").alias("query_id"), F.lit(">=").alias("op"), "target", "category"))
    cells = t("table_cells").select("cell_id", "table_id", "norm_numeric", "unit_category").distinct()
    return T.range_lookup(cells, t("table_metadata"), p, 5).select("query_id", "cell_id", F.col("rank").cast("long").alias("rank"), "doc_name", F.col("page").cast("long").alias("page"))


_CELL_SCORE = f"(5 * len(list_intersect({entity_sql('column_label')}, qt)) + len(list_intersect({entity_sql('raw_value')}, qt)) + 10 * len(list_intersect(list_intersect({entity_sql('column_label')}, qt), [{', '.join(repr(w) for w in T.DOMAIN_WORDS)}])))"


@query(f"WITH {_INDEX}, h AS (SELECT query_id, row_id, table_id, count(DISTINCT token) AS hit_count FROM idx JOIN asked USING (token) GROUP BY ALL), top AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, row_id, table_id) = 1), q AS (SELECT query_id, list(token) AS qt FROM asked GROUP BY query_id), c AS (SELECT DISTINCT row_id, table_id, cell_id, column_label, raw_value FROM table_cells) SELECT query_id, row_id, cell_id, {_CELL_SCORE}::BIGINT AS cell_score FROM top JOIN c USING (row_id, table_id) JOIN q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, row_id, table_id ORDER BY cell_score DESC, cell_id) = 1")
def best_cell(t):
    asked = _asked(t)
    top = T.lookup(T.row_tokens(t("table_cells")), asked, 1).select("query_id", "row_id", "table_id")
    tokens = asked.groupBy("query_id").agg(F.collect_list("token").alias("query_tokens"))
    cells = t("table_cells").select("row_id", "table_id", "cell_id", "column_label", "raw_value").distinct()
    return T.best_cell(cells, top.join(tokens, "query_id")).select("query_id", "row_id", "cell_id", F.col("cell_score").cast("long").alias("cell_score"))


@query("SELECT table_id, row_id, max(row_label) AS row_label, count(DISTINCT column_label) AS n_keys FROM table_cells WHERE column_label IS NOT NULL GROUP BY ALL")
def table_rows_kv(t):
    return T.row_maps(t("table_cells").dropDuplicates(["cell_id"])).select("table_id", "row_id", "row_label", F.size("row_kv").cast("long").alias("n_keys"))


_ROWS = "rows AS (SELECT table_id, row_id, max(row_label) AS row_label, string_agg(CASE WHEN trim(coalesce(raw_value, ''), ' ') <> '' THEN column_label || ' = ' || trim(raw_value, ' ') END, ' | ' ORDER BY cell_id) AS pairs, try_cast(regexp_extract(row_id, '_r([0-9]+)$', 1) AS INT) AS row_index FROM (SELECT DISTINCT table_id, row_id, row_label, cell_id, column_label, raw_value FROM table_cells) GROUP BY table_id, row_id)"


@query(f"WITH {_ROWS} SELECT table_id, row_id, lag(row_id) OVER w AS prev_row_id, lead(row_id) OVER w AS next_row_id, count(*) OVER (PARTITION BY table_id) AS total_rows, coalesce(max(CASE WHEN regexp_matches(lower(row_label), 'total|sum|average') THEN (coalesce(row_index, -1), row_id) END) OVER (PARTITION BY table_id), max((coalesce(row_index, -1), row_id)) OVER (PARTITION BY table_id))[2] AS summary_row_id, md5(concat_ws(' | ', 'Section: ' || section_path, 'Table: ' || table_id, 'Row: ' || row_label, coalesce(pairs, ''))) AS text_md5 FROM rows LEFT JOIN table_metadata USING (table_id) WINDOW w AS (PARTITION BY table_id ORDER BY row_index, row_id)")
def row_chunks_pointers(t):
    cells = t("table_cells").select("table_id", "row_id", "row_label", "cell_id", "column_label", "raw_value").distinct()
    return T.row_chunks(cells, t("table_metadata")).select("table_id", "row_id", "prev_row_id", "next_row_id", "total_rows", "summary_row_id", F.md5("text").alias("text_md5"))


@query(f"WITH {_INDEX}, {_ROWS}, q AS (SELECT DISTINCT query_id, CASE WHEN contains(lower(query), 'table') OR contains(lower(query), 'column') OR contains(lower(query), 'grid') THEN 'table' WHEN list_has_any({entity_sql('query')}, [{', '.join(repr(w) for w in X.PROSE_SIGNALS)}]) OR len(list_filter(regexp_split_to_array(lower(trim(query, ' ')), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')) > 5 THEN 'prose' ELSE 'table' END AS route FROM predictions WHERE try_cast(right(query_id, 7) AS BIGINT) % 20 = 0) SELECT route, count(*) AS n_queries, sum(hits)::BIGINT AS n_hits FROM (SELECT q.query_id, route, count(h.row_id) AS hits FROM q LEFT JOIN (SELECT query_id, row_id FROM (SELECT query_id, row_id, table_id, count(DISTINCT token) AS c FROM idx JOIN asked USING (token) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, row_id, table_id) <= 5) h ON h.query_id = q.query_id AND route = 'table' GROUP BY ALL) GROUP BY route")
def route_table_prose(t):
    """Q15: table questions go to the entity index, the rest is left to the passage ranker."""
    q = t("predictions").where("try_cast(right(query_id, 7) as bigint) % 20 = 0").select("query_id", X.query_intent("query").alias("route")).distinct()
    table_q = _asked(t).join(q.where("route = 'table'"), "query_id", "left_semi")
    hits = T.lookup(T.row_tokens(t("table_cells")), table_q, 5).select("query_id", "row_id")
    per = q.join(hits, "query_id", "left").groupBy("query_id", "route").agg(F.count("row_id").alias("hits"))
    return per.groupBy("route").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("hits").alias("n_hits"))

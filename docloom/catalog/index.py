"""Stores, rankers over sparse and token vectors, arms, answers and corpus scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.catalog.pages import _EL, _elements
from docloom.catalog.texts import WORDS_SQL, entity_sql
from docloom.functions import numeric as N
from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import answers as A
from docloom.operators import chunkers as C
from docloom.operators import elements as E
from docloom.operators import grids as G
from docloom.operators import ranking as R
from docloom.operators import reading as D
from docloom.operators import relational as L
from docloom.operators import tables as T
from docloom.plans import extensions as P
from docloom.session import cut_lineage

query = Catalog()

# ---- stores ---------------------------------------------------------------------------------------------------------


@query("WITH u AS (SELECT vec_id, label, 0 AS v FROM embeddings UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 3 = 0) SELECT vec_id, arg_max(label, v) AS label FROM u GROUP BY vec_id")
def upserted_points(t):
    """A third of the points is written again; the later write wins."""
    e = t("embeddings").select("vec_id", "label", F.lit(0).alias("v"))
    again = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("v"))
    return L.latest(e.unionByName(again), ["vec_id"], ["v"]).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def points_by_id(t):
    """A semi join, as the ids asked for may be many."""
    asked = t("events").where("event_type = 'error'").select(F.col("user_id").alias("vec_id"))
    return L.known(t("embeddings"), asked, "vec_id", new=False).select("vec_id", "label")


@query("SELECT count(*) AS n, count(embedding) AS n_vectors FROM embeddings")
def point_count(t):
    """S23."""
    return t("embeddings").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("n_vectors"))


_NESTED = "n0 AS (SELECT DISTINCT table_id, row_id, cell_id, row_label, raw_value FROM table_cells), n AS (SELECT table_id, row_id, max(coalesce(row_label, '')) AS row_label, list(coalesce(raw_value, '') ORDER BY cell_id, row_label, raw_value) AS vals FROM n0 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_id) - 1 AS row_no FROM n), h AS (SELECT table_id, header_schema_json::JSON::VARCHAR[] AS head FROM table_metadata)"


def _nested(t):
    c = t("table_cells").select("table_id", "row_id", "cell_id", "row_label", "raw_value").distinct()
    rows = c.groupBy("table_id", "row_id").agg(F.max(F.coalesce("row_label", F.lit(""))).alias("row_label"), F.array_sort(F.collect_list(F.struct("cell_id", "row_label", "raw_value"))).alias("c"))
    rows = rows.select("table_id", "row_id", F.struct("row_label", F.transform("c", lambda x: F.coalesce(x["raw_value"], F.lit(""))).alias("cell_values")).alias("r"))
    grid = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "r"))), lambda x: x["r"]).alias("rows"))
    return grid.join(t("table_metadata").select("table_id", F.from_json("header_schema_json", "array<string>").alias("column_headers")), "table_id")


@query(f"WITH {_NESTED}, x AS (SELECT table_id, table_id || '_r' || row_no AS row_id, row_label, head, vals, unnest(range(len(vals))) AS col_no FROM o JOIN h USING (table_id)) SELECT row_id || '_c' || col_no AS cell_id, row_id, row_label, coalesce(head[col_no + 1], 'Col_' || col_no) AS column_label, vals[col_no + 1] AS raw_value FROM x")
def ingested_cells(t):
    """Nested grids to cells; a cell beyond the header is Col_i."""
    cells, _ = T.explode_tables(_nested(t))
    return cells.select("cell_id", "row_id", "row_label", "column_label", "raw_value")


@query("SELECT DISTINCT cell_id, CASE WHEN regexp_matches(trim(raw_value, ' '), '^[+-]?[0-9]+([.][0-9]+)?[ \\t]*[a-zA-Z°μµ%]+$') THEN 'unit' WHEN regexp_matches(trim(raw_value, ' '), '^[+-]?[0-9]+([.][0-9]+)?$') THEN printf('%.4g', trim(raw_value, ' ')::DOUBLE) ELSE lower(trim(raw_value, ' ' || chr(9) || chr(10))) END AS norm FROM table_cells WHERE raw_value IS NOT NULL")
def unit_strings(t):
    """normal forms; of those with a unit only that they have one, as the tests cover their text."""
    c = t("table_cells").where("raw_value is not null").select("cell_id", "raw_value").distinct()
    has = F.trim("raw_value").rlike("^[+-]?[0-9]+([.][0-9]+)?[ \t]*[a-zA-Z°μµ%]+$")
    return c.select("cell_id", F.when(has, "unit").otherwise(N.unit_string("raw_value")).alias("norm"))


# ---- elements -------------------------------------------------------------------------------------------------------


@query(f"WITH {_EL} SELECT CASE WHEN type IN ('table', 'figure') THEN 'anchor' WHEN type IN ('abandon', 'header', 'footer', 'page_number') THEN 'ignored' ELSE 'other' END AS part, count(*) AS n FROM el GROUP BY 1")
def type_sets(t):
    """P1."""
    from docloom.operators import mesh as M

    part = F.when(F.col("type").isin(M.TABLES + M.FIGURES), "anchor").when(F.col("type").isin(M.IGNORED), "ignored").otherwise("other")
    return _elements(t).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EL} SELECT chunk_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY doc, type ORDER BY page, seq) AS n FROM el WHERE length(text) >= 20) WHERE n <= 3")
def source_elements(t):
    """The first three of each type of a document with at least twenty signs."""
    e = _elements(t).where("length(text) >= 20")
    return L.head(e, ["doc", "type"], [F.asc("page"), F.asc("seq")], 3).select("chunk_id")


@query("SELECT DISTINCT id, replace(gt_text, '�', '') AS content, NULL::VARCHAR AS table_markdown FROM medcore_text_gt_flat")
def completed_elements(t):
    """A missing key is null, replacement characters are dropped."""
    z = t("medcore_text_gt_flat").select("id", F.replace("gt_text", F.lit("�"), F.lit("")).alias("content")).distinct()
    return z.withColumn("table_markdown", F.lit(None).cast("string"))


@query(
    f"WITH {_EL}, x AS (SELECT doc, page, seq AS elem_idx, chunk_id AS element_id, CASE WHEN type = 'section_header' THEN 'title' WHEN type = 'text' THEN 'paragraph' ELSE type END AS type, x0, y0, x1, y1, text, (seq % 4)::INT AS ro FROM el), "
    "t AS (SELECT *, list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda l: starts_with(trim(l, ' '), '|') AND ends_with(trim(l, ' '), '|')), lambda l: length(l) - length(replace(l, '|', '')))) AS widths FROM x), "
    "s AS (SELECT doc, elem_idx::VARCHAR AS element, unnest([CASE WHEN type = 'figure' THEN 'schema_completeness' END, CASE WHEN x0 < 0 OR y0 < 0 OR x1 <= x0 OR y1 <= y0 THEN 'bbox_sanity' END, CASE WHEN type = 'table' AND (NOT (contains(text, '|') OR contains(text, '<table>')) OR len(widths) > 1) THEN 'table_integrity' END]) AS check_name FROM t), "
    "o AS (SELECT doc, page, max((ro <= prev)::INT) AS bad, count(DISTINCT ro) < count(*) AS twice FROM (SELECT *, lag(ro) OVER (PARTITION BY doc, page ORDER BY elem_idx) AS prev FROM x) GROUP BY ALL) "
    "SELECT DISTINCT check_name, doc, element FROM s WHERE check_name IS NOT NULL UNION SELECT 'reading_order', doc, 'page ' || page FROM o WHERE bad = 1 OR twice"
)
def element_checks(t):
    """E37 on chunks as elements: figures lack their caption and every fourth place in reading order is taken again. Text quality has a query of its own."""
    e = _elements(t)
    kind = F.when(F.col("type") == "section_header", "title").when(F.col("type") == "text", "paragraph").otherwise(F.col("type"))
    x = e.select("doc", F.col("seq").alias("elem_idx"), F.col("chunk_id").alias("element_id"), kind.alias("type"), "page", "bbox", (F.col("seq") % 4).cast("int").alias("reading_order"), F.array(F.lit("s")).alias("section_path"), "text", F.when(kind == "table", F.col("text")).alias("table_markdown"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("image_caption"))
    return E.element_checks(x).where("check_name <> 'text_quality'")


# ---- texts ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({WORDS_SQL.replace('{c}', 'text')})::BIGINT AS n_tokens FROM documents")
def token_counts(t):
    """F5."""
    return t("documents").select("doc_id", X.token_count("text").cast("long").alias("n_tokens"))


@query("SELECT DISTINCT chunk_id, lower(replace(replace(replace(trim(coalesce(parent_section, ''), ' '), '-', ''), '_', ''), ' ', '')) AS k, coalesce(nullif(trim(lower(regexp_replace(substring(parent_section, 1, 30), '[^a-zA-Z0-9]', '_', 'g')), '_'), ''), 'sec') AS slug FROM chunks WHERE parent_section IS NOT NULL")
def section_slugs(t):
    """F11, F13."""
    c = t("chunks").where("parent_section is not null").select("chunk_id", "parent_section").distinct()
    return c.select("chunk_id", X.normalize_key("parent_section").alias("k"), X.section_slug("parent_section").alias("slug"))


@query("SELECT DISTINCT chunk_id, regexp_replace(doc_filename, '[.]pdf$', '') || '_' || strategy || '_' || page || '_' || lpad(regexp_extract(chunk_id, '_([0-9]+)$', 1), 4, '0') AS name FROM chunks WHERE doc_filename IS NOT NULL AND page IS NOT NULL AND strategy IS NOT NULL AND regexp_matches(chunk_id, '_[0-9]{4}$')")
def chunk_names(t):
    """F14."""
    c = t("chunks").where("doc_filename is not null and page is not null and strategy is not null and chunk_id rlike '_[0-9]{4}$'")
    seq = F.regexp_extract("chunk_id", "_([0-9]+)$", 1).cast("int")
    return c.select("chunk_id", X.chunk_name(F.regexp_replace("doc_filename", "[.]pdf$", ""), F.col("strategy"), F.col("page"), seq).alias("name")).distinct()


# ---- rankers --------------------------------------------------------------------------------------------------------

_RANK = "SELECT query_id, item_id, round(score, 8) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 10"


def _top(scores, k=10):
    top = R.ranked(scores.withColumnRenamed("score", "_s").withColumn("score", F.round("_s", 9)), k)
    return top.select("query_id", "item_id", F.round("_s", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH p AS (SELECT doc_id AS item_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(k) AS token, len(k) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents)) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS avg_dl FROM documents), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1), a AS (SELECT DISTINCT question_id AS query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM qa_bank), s AS (SELECT query_id, item_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1.0, avg_dl)))) AS score FROM p JOIN df USING (token) JOIN a USING (token), st GROUP BY ALL) {_RANK}")
def bm25_words_top10(t):
    """Q3: words with their frequency."""
    d, q = t("documents"), t("qa_bank")
    posted = R.postings(d, "doc_id", X.alnum_tokens("text"), binary=False)
    stats = d.select(F.size(X.alnum_tokens("text")).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return _top(R.bm25(posted, R.asked_tokens(q, "question_id", X.alnum_tokens("question")), stats))


_SPARSE = "v AS (SELECT doc_id AS item_id, token AS term, ln(1 + count(*)) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL), q AS (SELECT question_id AS query_id, token AS term, ln(1 + count(*)) AS q_weight FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM qa_bank) GROUP BY ALL), s AS (SELECT query_id, item_id, sum(weight * q_weight) AS score FROM v JOIN q USING (term) GROUP BY ALL)"


def _sparse(t):
    posted = R.postings(t("documents"), "doc_id", X.alnum_tokens("text"), binary=False)
    items = posted.select("item_id", F.col("token").alias("term"), F.log1p(F.col("tf").cast("double")).alias("weight"))
    asked = R.postings(t("qa_bank"), "question_id", X.alnum_tokens("question"), binary=False)
    queries = asked.select(F.col("item_id").alias("query_id"), F.col("token").alias("term"), F.log1p(F.col("tf").cast("double")).alias("q_weight"))
    return items, queries


@query(f"WITH {_SPARSE} {_RANK}")
def sparse_top10(t):
    """Q4, Q6: dot products over an inverted index; the weights are those of an encoder, here log(1 + frequency)."""
    return _top(R.sparse(*_sparse(t)))


@query("WITH v AS (SELECT doc_id, map_from_entries(list((token, ln(1 + n)))) AS m FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents WHERE doc_id % 10 = 0) GROUP BY ALL) GROUP BY 1) SELECT doc_id, round(coalesce(m['the'], 0) * 2.0 + coalesce(m['pump'], 0) * 3.0, 8) AS score FROM v")
def sparse_dots(t):
    """F62 on maps: every tenth document is a query set against two terms."""
    p = R.postings(t("documents").where("doc_id % 10 = 0"), "doc_id", X.alnum_tokens("text"), binary=False)
    m = p.groupBy(F.col("item_id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("token", F.log1p(F.col("tf").cast("double"))))).alias("m"))
    q = F.create_map(F.lit("the"), F.lit(2.0), F.lit("pump"), F.lit(3.0))
    return m.select("doc_id", F.round(V.sparse_dot(q, F.col("m")), 8).alias("score"))


_VEC = "e AS (SELECT vec_id, vec_id // 4 AS g, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"WITH {_VEC}, d AS (SELECT q.g AS query_id, p.g AS item_id, q.vec_id, max(list_dot_product(q.v, p.v)) AS best FROM e q JOIN e p ON q.g % 20 = 0 GROUP BY ALL), s AS (SELECT query_id, item_id, sum(best) AS score FROM d GROUP BY ALL) {_RANK}")
def maxsim_top10(t):
    """Four vectors a passage, each twentieth passage a query."""
    e = t("embeddings").withColumn("g", F.floor(F.col("vec_id") / 4))
    multi = e.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("m"))
    queries = multi.where("g % 20 = 0").select(F.col("g").alias("query_id"), F.col("m").alias("q"))
    return _top(R.maxsim_top(multi.select(F.col("g").alias("item_id"), "m"), queries, 10))


@query()
def hashed_embeddings(t):
    """64 places of hashed tokens, whose hash SQL does not have."""
    return t("qa_bank").select("question_id", V.hashed_embedding(X.entity_tokens("question")).alias("v"))


@query(f"WITH {_SPARSE.replace('s AS (SELECT', 'sp AS (SELECT')}, ov AS (SELECT query_id, item_id, count(*)::DOUBLE AS score FROM (SELECT question_id AS query_id, unnest({entity_sql('question')}) AS token FROM qa_bank) JOIN (SELECT doc_id AS item_id, unnest({entity_sql('text')}) AS token FROM documents) USING (token) GROUP BY ALL), r1 AS (SELECT 'sparse' AS arm, query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sp QUALIFY rank <= 20), r2 AS (SELECT 'overlap' AS arm, query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM ov QUALIFY rank <= 20), f AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL), r3 AS (SELECT 'fused' AS arm, query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM f QUALIFY rank <= 20) SELECT arm, query_id, item_id, rank::BIGINT AS rank FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)")
def retrieval_arms(t):
    """Q16: two arms and their fusion in one table."""
    posted, asked = R.entity_postings(t("documents"), "doc_id", "text"), R.asked_tokens(t("qa_bank"), "question_id", X.entity_tokens("question"))
    rounded = lambda s: s.withColumn("score", F.round("score", 9))
    a = P.arms({"sparse": rounded(R.sparse(*_sparse(t))), "overlap": rounded(R.overlap(posted, asked))}, {"fused": ["sparse", "overlap"]}, 20)
    return a.select("arm", "query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SPARSE}, r AS (SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 10), l AS (SELECT r.*, length(text) AS n FROM r JOIN documents ON item_id = doc_id) SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) AS rank FROM l QUALIFY rank <= 5")
def reranked(t):
    """Q17: the first ten by another score, here the length of the text; without a scorer the order stays."""
    top = _top(R.sparse(*_sparse(t)))
    joined = P.rerank(top, None, 10).join(t("documents").select(F.col("doc_id").alias("item_id"), F.length("text").cast("double").alias("_n")), "item_id")
    return P.rerank(joined, F.col("_n"), 5).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT DISTINCT query_id, coalesce(CASE WHEN trim(e2e_prediction, ' ') <> '' THEN e2e_prediction END, CASE WHEN trim(oracle_prediction, ' ') <> '' THEN oracle_prediction END, CASE WHEN trim(ground_truth, ' ') <> '' THEN ground_truth END) AS answer FROM predictions")
def answer_ladders(t):
    """Q18."""
    return t("predictions").select("query_id", P.answer_ladder(F.col("e2e_prediction"), F.col("oracle_prediction"), F.col("ground_truth")).alias("answer")).distinct()


@query("SELECT count(*) AS n, round(avg(hit_1), 8) AS hit_1, round(avg(mrr), 8) AS mrr FROM (SELECT query_id, (min(CASE WHEN hit THEN rank END) = 1)::INT::DOUBLE AS h, coalesce((min(CASE WHEN hit THEN rank END) = 1)::INT, 0)::DOUBLE AS hit_1, coalesce(1.0 / min(CASE WHEN hit THEN rank END), 0) AS mrr FROM (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'purchase' AS hit FROM events) GROUP BY query_id)")
def metric_means(t):
    """Means of hit and reciprocal rank over jobs ranked by value."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    first = t("events").withColumn("rank", F.row_number().over(w)).groupBy(F.col("user_id").alias("query_id")).agg(F.min(F.when(F.col("event_type") == "purchase", F.col("rank"))).alias("first"))
    m = R.metric_means(R.first_hit_metrics(first))
    return m.select("n", F.round("hit_1", 8).alias("hit_1"), F.round("mrr", 8).alias("mrr"))


# ---- search and routing ---------------------------------------------------------------------------------------------


@query()
def cell_search(t):
    """Every twentieth question, and one range for each category; the tests compare with brute force."""
    q = t("predictions").where("try_cast(right(query_id, 7) as bigint) % 20 = 0").select("query_id", "query").distinct()
    ranges = t("predictions").sparkSession.createDataFrame([("r1", "rated power >= 500 W"), ("r2", "length < 10 mm")], "query_id string, query string")
    cells = t("table_cells").select("cell_id", "row_id", "table_id", "row_label", "column_label", "raw_value", "norm_numeric", "unit_category").dropDuplicates(["cell_id"])
    return T.search(cells, t("table_metadata"), q.unionByName(ranges), 5)


@query()
def routed_answers(t):
    """Q15: every table question takes the best cell of the best row, any other the best sentence of the best document."""
    q = cut_lineage(t("predictions").select("query_id", "query").distinct().withColumn("route", X.query_intent("query")))
    cells = t("table_cells").select("cell_id", "row_id", "table_id", "row_label", "column_label", "raw_value").dropDuplicates(["cell_id"])
    # a cell's tokens are all among those of the table, so its score too depends on the known tokens alone
    known = T.known_tokens(T.row_tokens(t("table_cells")), q.where("route = 'table'").select("query_id", F.explode(X.entity_tokens("query")).alias("token")))
    rows = T.lookup_sets(T.row_tokens(cells), known, 1).join(known.select("key", "query_tokens").distinct(), "key").withColumnRenamed("key", "query_id")
    best = T.best_cell(cells, rows).select(F.col("query_id").alias("key"), F.col("raw_value").alias("answer"), F.col("table_id").alias("doc_id"))
    table = known.join(best, "key").select("query_id", "answer", "doc_id")
    prose_q = q.where("route = 'prose'")
    asked = R.asked_tokens(prose_q, "query_id", X.entity_tokens("query"))
    posted, stats = R.asked_index(t("documents"), "doc_id", X.entity_tokens("text"), asked)
    best = R.bm25_top(posted, asked, stats, 1, log_idf=False).join(t("documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id").join(prose_q.withColumnRenamed("query_id", "_q"), F.col("query_id") == F.col("_q"))
    prose = best.select("query_id", D.best_sentence(F.col("query"), F.col("text")).alias("answer"), F.col("item_id").cast("string").alias("doc_id"))
    return q.select("query_id", "route").join(table.unionByName(prose), "query_id", "left").select("query_id", "route", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("doc_id", F.lit("")).alias("doc_id"))


# ---- scores ---------------------------------------------------------------------------------------------------------


def _pairs(t):
    return t("predictions").where("ground_truth is not null and e2e_prediction is not null").select("query_id", F.col("e2e_prediction").alias("p"), F.col("ground_truth").alias("g")).distinct()


@query()
def word_error_rates(t):
    """Pooled and mean word and character error rates by question type and overall; the edit distance over words has no SQL."""
    p = t("predictions").where("ground_truth is not null and e2e_prediction is not null").select("query_id", F.coalesce("query_type", F.lit("none")).alias("query_type"), F.col("e2e_prediction").alias("p"), F.col("ground_truth").alias("g")).distinct()
    s = p.select("query_type", A.word_edits("p", "g").alias("we"), F.size(F.filter(F.split("g", r"\s+"), lambda x: x != "")).alias("wn"), F.levenshtein("p", "g").alias("ce"), F.length("g").alias("cn")).where("wn > 0")
    out = s.rollup("query_type").agg(F.count(F.lit(1)).alias("n"), (F.sum("we") / F.sum("wn")).alias("wer_micro"), F.avg(F.col("we") / F.col("wn")).alias("wer_macro"), (F.sum("ce") / F.sum("cn")).alias("cer_micro"), F.avg(F.col("ce") / F.col("cn")).alias("cer_macro"))
    return out.withColumn("query_type", F.coalesce("query_type", F.lit("ALL")))


@query()
def corpus_bleu(t):
    """E35; the tests compare with a plain computation."""
    return A.corpus_bleu(_pairs(t))


@query()
def caption_cider(t):
    """E35."""
    return A.cider(_pairs(t), "query_id", "p", "g")


@query("SELECT DISTINCT query_id, e2e_prediction IS NOT NULL AND ground_truth IS NOT NULL AND trim(ground_truth, ' ') <> '' AND trim(e2e_prediction, ' ') <> '' AND lower(trim(e2e_prediction, ' ')) = lower(trim(ground_truth, ' ')) AS same FROM predictions WHERE ground_truth IS NOT NULL AND e2e_prediction IS NOT NULL")
def answer_matches(t):
    """What is equal always matches; the share rule is covered by the tests."""
    p = _pairs(t)
    same = (F.trim("g") != "") & (F.trim("p") != "") & (F.lower(F.trim("p")) == F.lower(F.trim("g")))
    return p.select("query_id", (same & A.answer_match(F.col("p"), F.col("g")).cast("boolean")).alias("same"))


@query()
def block_similarities(t):
    """Matching blocks; the algorithm is that of the standard library."""
    similar = F.pandas_udf(lambda p, g: _similar(p, g), "double")
    return _pairs(t).select("query_id", similar("p", "g").alias("similarity"))


def _similar(p, g):
    import pandas as pd

    return pd.Series([G._similar(a, b) for a, b in zip(p, g)], dtype="float64")


@query("SELECT doc_id, array_to_string(w[i:least(i + 59, len(w))], ' ') AS text, ((i - 1) // 50)::INT AS n FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 60 THEN [1] ELSE range(1, (ceil((len(w) - 60) / 50.0) * 50 + 2)::BIGINT, 50) END) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) > 0)")
def window_texts(t):
    """The windows themselves."""
    from docloom.operators import sequences as S

    d = t("documents").select("doc_id", X.alnum_tokens("text").alias("k"))
    return d.select("doc_id", F.posexplode(S.token_windows(F.col("k"), 60, 10)).alias("n", "w")).select("doc_id", "n", F.array_join("w", " ").alias("text"))


@query(f"WITH {_EL}, g0 AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n FROM el), l AS (SELECT *, lag(type) OVER w AS pt, lag(n) OVER w AS pn FROM g0 WINDOW w AS (PARTITION BY doc, page ORDER BY seq)), s AS (SELECT *, sum((type IN ('table', 'figure', 'formula', 'caption') OR type IS DISTINCT FROM pt OR n >= 100 OR coalesce(pn >= 100, true))::INT) OVER (PARTITION BY doc, page ORDER BY seq) AS g FROM l) SELECT doc, page, min(seq) AS first, count(*) AS n_elements, sum(length(text))::BIGINT + count(*) - 1 AS n_chars FROM s GROUP BY doc, page, g")
def atomic_groups(t):
    """Groups of the atomic chunker by their first element."""
    c = C.element_atomic(_elements(t).select("doc", "page", "seq", "type", "text"))
    return c.select("doc", "page", F.array_min("source_element_indices").alias("first"), F.size("source_element_indices").cast("long").alias("n_elements"), F.length("text").cast("long").alias("n_chars"))

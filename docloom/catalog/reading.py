"""Extractive answers over the contexts that were retrieved."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.catalog.texts import entity_sql
from docloom.functions import text as X
from docloom.operators import reading as D

query = Catalog()

_SPAN = r"\b(?:[$€£]?[0-9][0-9,.]*%?|[0-9]{4}|[A-Z][a-z]+(?:[ \t\n\r\f]+[A-Z][a-z]+)*)\b"
# boundaries of words are those of all scripts; the SQL engine knows those of ASCII only, so other letters become an underscore
_ASCII = r"regexp_replace(w, '[ªµºÀ-ÖØ-öø-žʼ\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}ー]', '_', 'g')"
_CONTEXT = "p AS (SELECT DISTINCT query_id, query, ground_truth, retrieval_context[1] AS text FROM predictions WHERE query IS NOT NULL AND retrieval_context[1] IS NOT NULL)"
_CUT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 5)"
_WINDOWS = f"{_CONTEXT}, s AS (SELECT *, {_CUT} AS s, {entity_sql('query')} AS q FROM p), w AS (SELECT query_id, query, text, q, i, array_to_string(s[i:i + 2], ' ') AS w FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s))"
_BEST = f"{_WINDOWS}, b AS (SELECT query_id, query, text, any_value(q) AS q, arg_max(w, (len(list_intersect(q, {entity_sql('w')})), -i)) AS w FROM w GROUP BY query_id, query, text)"


def _contexts(t):
    p = t("predictions").select("query_id", "query", "ground_truth", F.get("retrieval_context", F.lit(0)).alias("text")).distinct()
    return p.where("query is not null and text is not null")


@query(f"WITH {_WINDOWS} SELECT query_id, count(*) AS n_windows, max(length(w)) AS longest FROM w GROUP BY query_id, query, text")
def sentence_windows(t):
    """W17."""
    w = _contexts(t).select("query_id", D.sentence_windows("text").alias("w"), F.size(X.window_sentences("text")).alias("n"), F.array_max(F.transform(D.sentence_windows("text"), lambda x: F.length(x))).alias("longest"))
    return w.where("n > 0").select("query_id", F.col("n").cast("long").alias("n_windows"), F.col("longest").cast("long").alias("longest"))


@query(
    f"WITH {_BEST}, f AS (SELECT query_id, w, list_filter(regexp_extract_all({_ASCII}, '{_SPAN}'), lambda x: NOT list_contains(q, lower(x)) AND length(x) > 1)[1] AS span, "
    f"list_filter(list_filter(list_transform(string_split(regexp_replace(w, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) > 5), lambda x: len(list_filter({entity_sql('x')}, lambda y: NOT list_contains(q, y))) > 0)[1] AS fresh FROM b) "
    "SELECT query_id, coalesce(span, fresh, w) AS answer FROM f UNION ALL SELECT query_id, substring(text, 1, 200) FROM s WHERE len(s) = 0"
)
def answer_spans(t):
    """F29 with one value."""
    return _contexts(t).select("query_id", D.answer_span(F.col("query"), F.col("text")).alias("answer"))


@query()
def answer_spans_multi(t):
    """F29 with several values; the order depends on earlier choices, so there is no SQL."""
    c = _contexts(t).withColumn("w", D.best_window(F.col("query"), F.col("text")))
    return c.select("query_id", D.order_spans(F.col("query"), F.col("w"), D.spans(F.col("query"), F.col("w"))).alias("answer"))


_LONG = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 10)"
_JACCARD = f"{_CONTEXT}, s AS (SELECT *, {_LONG} AS s, {entity_sql('query')} AS q FROM p), e AS (SELECT query_id, text, q, i, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s)), k AS (SELECT *, {entity_sql('x')} AS xt FROM e), r AS (SELECT query_id, text, arg_max(x, (CASE WHEN len(xt) = 0 THEN -1 ELSE len(list_intersect(q, xt)) / (len(q) + len(xt) - len(list_intersect(q, xt))) END, -i)) AS answer FROM k GROUP BY query_id, text UNION ALL SELECT query_id, text, substring(text, 1, 300) FROM s WHERE len(s) = 0)"


@query(f"WITH {_JACCARD} SELECT query_id, answer FROM r")
def best_sentences(t):
    """F30."""
    return _contexts(t).select("query_id", D.best_sentence(F.col("query"), F.col("text")).alias("answer"))


@query("SELECT DISTINCT query_id, CASE WHEN trim(coalesce(e2e_prediction, ''), ' ') IN ('', 'NOT_FOUND', 'N/A') THEN coalesce(oracle_prediction, e2e_prediction) ELSE e2e_prediction END AS answer FROM predictions")
def raw_query_first(t):
    """Q20: the end-to-end answer, else that of the oracle."""
    p = t("predictions")
    return p.select("query_id", D.first_answer(F.col("e2e_prediction"), F.col("oracle_prediction"), ("NOT_FOUND", "N/A")).alias("answer")).distinct()


@query("WITH a AS (SELECT query_id, ground_truth AS g, unnest(retrieval_context) AS c FROM predictions WHERE ground_truth IS NOT NULL) SELECT query_id, max((contains(lower(c), lower(trim(g, ' '))))::INT) AS oracle, count(*) AS n_chunks FROM a GROUP BY query_id")
def any_chunk_oracle(t):
    """E43 with containment as the match."""
    a = t("predictions").where("ground_truth is not null").select("query_id", "ground_truth", F.explode("retrieval_context").alias("c"))
    return D.any_chunk_oracle(a, F.lower("c").contains(F.lower(F.trim("ground_truth"))))


_ROWS = f"r0 AS (SELECT DISTINCT table_id, row_id, cell_id, row_label, raw_value FROM table_cells), r AS (SELECT table_id, row_id, array_to_string(list(raw_value ORDER BY cell_id) FILTER (WHERE raw_value IS NOT NULL), ' ') AS vals, max(row_label) AS row_label, arg_max(coalesce(raw_value, '∅'), cell_id) AS cell FROM r0 GROUP BY ALL)"


@query(
    f"WITH {_ROWS}, k AS (SELECT table_id, row_id, cell, {entity_sql('concat_ws(chr(32), row_label, vals)')} AS toks FROM r), a AS (SELECT table_id, {entity_sql('row_label')} AS q FROM (SELECT table_id, min(row_label) AS row_label FROM r GROUP BY table_id)), "
    "h AS (SELECT a.table_id AS query_id, row_id, cell, len(list_intersect(q, toks)) AS overlap FROM a JOIN k USING (table_id)) SELECT query_id, arg_min(row_id, (-overlap, row_id)) AS row_id, arg_min(cell, (-overlap, row_id)) AS cell, max(overlap) AS overlap FROM h WHERE overlap > 0 GROUP BY query_id"
)
def last_cells(t):
    """F32: each table is asked for its first row label."""
    cells = t("table_cells").select("table_id", "row_id", "cell_id", "row_label", "raw_value").distinct()
    asked = cells.groupBy("table_id").agg(F.min("row_label").alias("q")).select(F.col("table_id").alias("query_id"), "table_id", X.entity_tokens("q").alias("query_tokens"))
    return D.last_cell(cells, asked).select("query_id", "row_id", F.coalesce("cell", F.lit("∅")).alias("cell"), F.col("overlap").cast("long").alias("overlap"))


@query("WITH g AS (SELECT DISTINCT doc_stem AS gold_id FROM predictions WHERE doc_stem IS NOT NULL AND doc_stem <> '') SELECT DISTINCT gold_id AS query_id, chunk_id FROM g JOIN (SELECT DISTINCT chunk_id FROM chunks) ON contains(chunk_id, gold_id)")
def gold_chunks(t):
    """Chunks whose id holds the stem of an asked document."""
    gold = t("predictions").select(F.col("doc_stem").alias("query_id"), F.col("doc_stem").alias("gold_id")).distinct()
    return D.gold_chunks(t("chunks"), gold)


@query("WITH r AS (SELECT doc_filename, chunk_id, row_number() OVER (PARTITION BY doc_filename ORDER BY chunk_id DESC) AS rank FROM (SELECT DISTINCT doc_filename, chunk_id FROM chunks)) SELECT r.doc_filename AS query_id, r.chunk_id, rank::BIGINT AS rank, any_value(length(c.text)) AS n_chars FROM r JOIN chunks c USING (chunk_id) WHERE rank <= 5 AND r.doc_filename IS NOT NULL GROUP BY ALL")
def ranked_chunks(t):
    """The last chunks of a file, with their text looked up by id."""
    c = t("chunks")
    ids = c.where("doc_filename is not null").select(F.col("doc_filename").alias("query_id"), F.col("chunk_id").alias("item_id")).distinct()
    w = W.partitionBy("query_id").orderBy(F.desc("item_id"))
    top = ids.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return D.ranked_chunks(top, c).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.length("text").cast("long").alias("n_chars"))


@query("WITH b AS (SELECT doc_stem, min(question_id) AS question_id FROM qa_bank GROUP BY doc_stem), d AS (SELECT doc_stem, min(doc_id) AS doc_id FROM documents GROUP BY doc_stem) SELECT DISTINCT query_id, p.doc_stem, doc_id, question_id FROM predictions p LEFT JOIN d USING (doc_stem) LEFT JOIN b USING (doc_stem)")
def first_matches(t):
    """Each question with the first document and first test item of its stem, or none."""
    p = t("predictions").select("query_id", "doc_stem").distinct()
    docs = t("documents").select("doc_stem", "doc_id").where("doc_stem is not null")
    items = t("qa_bank").select("doc_stem", "question_id")
    return D.first_match(D.first_match(p, docs, ["doc_stem"], ["doc_id"]), items, ["doc_stem"], ["question_id"]).select("query_id", "doc_stem", "doc_id", "question_id")


@query("SELECT DISTINCT query_id, CASE WHEN contains(lower(e2e_prediction), lower(ground_truth)) THEN 1.0 ELSE 0.0 END AS hit FROM predictions WHERE ground_truth IS NOT NULL AND e2e_prediction IS NOT NULL AND trim(ground_truth, ' ') <> ''")
def answer_hits(t):
    """Predictions beside their truth; those without one are left out."""
    p = t("predictions").where("ground_truth is not null and e2e_prediction is not null and trim(ground_truth) <> ''")
    return p.select("query_id", F.lower("e2e_prediction").contains(F.lower("ground_truth")).cast("double").alias("hit")).distinct()

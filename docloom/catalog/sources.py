"""Markup, adapters, programs and replaceable steps over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.catalog.pages import _EL, _elements
from docloom.functions import markup as K
from docloom.functions import numeric as N
from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.plans import extensions as P
from docloom.sources import adapters as S
from docloom.sources import readers as I

query = Catalog()

_SHORT = "CASE type WHEN 'table' THEN 'tbl' WHEN 'figure' THEN 'fig' ELSE 'txt' END"
_BLOCKS = (
    f"{_EL}, k AS (SELECT *, {_SHORT} AS k, row_number() OVER (PARTITION BY doc, page, {_SHORT} ORDER BY seq) AS n FROM el), i AS (SELECT *, 'p' || page || '_' || k || n AS element_id FROM k), "
    "pg AS (SELECT doc, page, coalesce(string_agg(element_id, ',' ORDER BY n) FILTER (WHERE k = 'tbl'), '') AS tbl, coalesce(string_agg(element_id, ',' ORDER BY n) FILTER (WHERE k = 'fig'), '') AS fig, coalesce(string_agg(element_id, ',' ORDER BY n) FILTER (WHERE k = 'txt'), '') AS txt FROM i GROUP BY ALL), "
    "b AS (SELECT chunk_id, element_id, k, page, '[' || CASE k WHEN 'tbl' THEN 'TABLE' WHEN 'fig' THEN 'FIGURE' ELSE 'TEXT' END || ' id=\"' || element_id || '\" page=\"' || page || '\"' || CASE WHEN k <> 'tbl' THEN ' cross_ref_tables=\"' || tbl || '\"' ELSE '' END || CASE WHEN k <> 'fig' THEN ' cross_ref_figures=\"' || fig || '\"' ELSE '' END || CASE WHEN k <> 'txt' THEN ' cross_ref_text=\"' || txt || '\"' ELSE '' END || ']' || CASE k WHEN 'tbl' THEN chr(10) || '[TABLE]' || chr(10) WHEN 'fig' THEN chr(10) || '[FIGURE_CAPTION]' || chr(10) ELSE chr(10) END || trim(text, ' ') AS block FROM i JOIN pg USING (doc, page) WHERE trim(text, ' ') <> '')"
)


def _blocks(t):
    e = _elements(t)
    return K.tagged_page(e.withColumn("body", F.col("text"))).join(e.select("doc", "page", "seq", "chunk_id"), ["doc", "page", "seq"])


@query(f"WITH {_BLOCKS} SELECT chunk_id, md5(block) AS block_md5 FROM b")
def tagged_pages(t):
    """P19."""
    return _blocks(t).select("chunk_id", F.md5("block").alias("block_md5"))


@query(f"WITH {_BLOCKS} SELECT chunk_id, CASE k WHEN 'tbl' THEN 'TABLE' WHEN 'fig' THEN 'FIGURE' ELSE 'TEXT' END AS kind, element_id, page::VARCHAR AS page, CASE WHEN k = 'tbl' THEN 0 ELSE len(list_filter(string_split((SELECT tbl FROM pg JOIN i USING (doc, page) WHERE i.chunk_id = b.chunk_id), ','), lambda x: x <> '')) END AS n_tables FROM b")
def block_tags(t):
    """the tags of P19 read back."""
    g = _blocks(t).select("chunk_id", K.tag("block").alias("g"))
    return g.select("chunk_id", "g.kind", "g.element_id", "g.page", F.greatest(F.lit(0), F.coalesce(F.size(F.col("g.refs")["cross_ref_tables"]), F.lit(0))).cast("long").alias("n_tables"))


_GRID = "g0 AS (SELECT DISTINCT table_id, row_id, cell_id, column_label, raw_value FROM table_cells), r AS (SELECT table_id, row_id, list(coalesce(raw_value, '') ORDER BY cell_id, column_label, raw_value) AS cells FROM g0 GROUP BY ALL), g AS (SELECT table_id, list(cells ORDER BY row_id) AS grid FROM r GROUP BY 1), h AS (SELECT table_id, list_transform(header_schema_json::JSON::VARCHAR[], lambda x: coalesce(x, '')) AS head FROM table_metadata)"


def _grids(t):
    """Tables as a header and a grid of strings, in the order of ids."""
    c = t("table_cells").select("table_id", "row_id", "cell_id", "column_label", "raw_value").distinct()
    rows = c.groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "column_label", "raw_value"))).alias("c"))
    rows = rows.select("table_id", "row_id", F.transform("c", lambda x: F.coalesce(x["raw_value"], F.lit(""))).alias("cells"))
    grid = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "cells"))), lambda r: r["cells"]).alias("grid"))
    head = t("table_metadata").select("table_id", F.from_json("header_schema_json", "array<string>").alias("head"))
    return grid.join(head, "table_id")


@query(f"WITH {_GRID} SELECT table_id, md5(CASE WHEN len(head) > 0 THEN '| ' || array_to_string(head, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(head, lambda x: '---'), ' | ') || ' |' || chr(10) ELSE '' END || array_to_string(list_transform(grid, lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10))) AS grid_md5, len(grid) AS n_rows FROM g JOIN h USING (table_id)")
def markdown_grids(t):
    """F19."""
    return _grids(t).select("table_id", F.md5(K.markdown_grid(F.col("head"), F.col("grid"))).alias("grid_md5"), F.size("grid").cast("long").alias("n_rows"))


@query(f"WITH {_GRID} SELECT table_id, greatest(len(grid) - 1, 0)::BIGINT AS n_chunks, length(array_to_string(list_transform(grid[2:], lambda r: r[1]), '')) AS label_chars FROM g JOIN h USING (table_id)")
def grid_row_chunks(t):
    """F21."""
    c = _grids(t).select("table_id", "grid", K.row_chunk_texts(F.col("grid"), F.col("table_id"), F.lit("s")).alias("x"))
    chars = F.aggregate(F.slice("grid", 2, 1_000_000), F.lit(0), lambda a, r: a + F.length(F.get(r, F.lit(0))))
    return c.select("table_id", F.size("x").cast("long").alias("n_chunks"), chars.cast("long").alias("label_chars"))


@query("SELECT doc_id, nullif(regexp_extract('/base/' || doc_id || '/x.txt', '/([0-9]{6,7})/', 1), '') AS by_folder, nullif(regexp_extract(doc_id || '_id_' || doc_stem, '([0-9]{6,7})_id_', 1), '') AS by_name, CASE WHEN contains(doc_stem, '_') AND split_part(doc_stem, '_', 1) <> '' THEN split_part(split_part(doc_stem, '_', 1), '.', 1) END AS stem FROM documents WHERE doc_stem IS NOT NULL")
def evidence_paths(t):
    """F27, F28."""
    d = t("documents").where("doc_stem is not null")
    name = F.col("doc_id").cast("string")
    return d.select("doc_id", K.evidence_document(F.concat(F.lit("/base/"), name, F.lit("/x.txt"))).alias("by_folder"), K.evidence_document(F.concat(name, F.lit("_id_"), "doc_stem")).alias("by_name"), K.evidence_stem(F.concat(F.lit("a/b/"), "doc_stem")).alias("stem"))


@query(f"WITH {_EL} SELECT chunk_id, type AS label, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM el")
def model_output_boxes(t):
    """boxes written as a layout model marks them, and read back at the size of the model's page."""
    b = lambda c: F.format_string("%.6f", f"bbox.{c}")
    text = F.concat(F.lit("noise <x_"), b("x0"), F.lit("><y_"), b("y0"), F.lit(">"), F.replace("text", F.lit("<"), F.lit("(")), F.lit("<x_"), b("x1"), F.lit("><y_"), b("y1"), F.lit("><class_"), "type", F.lit("> noise"))
    m = _elements(t).select("chunk_id", F.explode(K.model_boxes(text, F.lit(float(K.MODEL_W)), F.lit(float(K.MODEL_H)))).alias("m"))
    return m.select("chunk_id", "m.label", *[F.round(f"m.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT query_id, CASE WHEN length(query) % 5 = 0 THEN NULL ELSE length(query) * 2.0 + greatest(3, length(query)) END AS result FROM (SELECT DISTINCT query_id, query FROM predictions WHERE query IS NOT NULL)")
def program_results(t):
    """generated programs, every fifth with a forbidden call."""
    n = F.length("query").cast("string")
    good = F.concat(F.lit("a = "), n, F.lit(" * 2\nresult = a + max(3, "), n, F.lit(")"))
    bad = F.concat(F.lit("import os\nresult = "), n)
    p = t("predictions").where("query is not null").select("query_id", "query").distinct()
    return p.select("query_id", N.program_result(F.when(F.length("query") % 5 == 0, bad).otherwise(good)).alias("result"))


@query()
def fallback_vectors(t):
    """the generator is that of the array library, so SQL cannot repeat it; the tests do."""
    return t("qa_bank").select("question_id", V.fallback_vector(F.col("question"), 8).alias("vector"))


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity FROM (SELECT vec_id, vec_id // 8 AS g, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) a JOIN (SELECT vec_id, vec_id // 8 AS g, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) b ON a.g = b.g AND a.vec_id < b.vec_id")
def similarity_pairs(t):
    """F61 within groups of eight."""
    e = t("embeddings").withColumn("g", F.floor(F.col("vec_id") / 8))
    return V.similarity_pairs(e, ["g"], "vec_id", "embedding").select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT chunk_id, ceil(len(source_element_indices) / 3.0)::BIGINT AS n_batches, source_element_indices[-1] AS last FROM (SELECT DISTINCT chunk_id, source_element_indices FROM chunks WHERE len(source_element_indices) > 0)")
def index_batches(t):
    """F67."""
    c = t("chunks").where("size(source_element_indices) > 0").select("chunk_id", V.batches(F.col("source_element_indices"), 3).alias("b")).distinct()
    return c.select("chunk_id", F.size("b").cast("long").alias("n_batches"), F.element_at(F.element_at("b", -1), -1).alias("last"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d_%H%M') AS name, ts < TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AS is_old FROM events")
def event_dates(t):
    """ISO form, name of a file and cutoff of a week before a day."""
    old = F.col("ts") < F.lit("2024-02-01").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "yyyyMMdd_HHmm").alias("name"), old.alias("is_old"))


@query("SELECT question_id AS query_id, 'unidoc_' || reasoning_type AS query_type, question AS query, coalesce(ground_truth, '') AS ground_truth_value, CASE WHEN length(evidence) % 2 = 0 THEN doc_stem ELSE 'unidoc_source' END AS table_id FROM qa_bank")
def multimodal_questions(t):
    """Every second test item has used evidence."""
    used = F.array(F.struct(F.lit("a").alias("key"), F.lit(False).alias("used"), F.lit("x").alias("source")), F.struct(F.lit("b").alias("key"), (F.length("evidence") % 2 == 0).alias("used"), F.col("doc_stem").alias("source")))
    q = t("qa_bank").select("question_id", F.lit(7).alias("index"), F.col("question").alias("rewritten_question_obscured"), F.col("ground_truth").alias("complete_answer"), F.col("reasoning_type").alias("question_type"), F.lit("text").alias("answer_type"), used.alias("chunk_used"))
    m = S.multimodal_questions(q)
    both = q.select("question_id", F.col("rewritten_question_obscured").alias("query")).distinct().join(m, "query")
    return both.select(F.col("question_id").alias("query_id"), "query_type", "query", "ground_truth_value", F.col("ground_truth_citation.table_id").alias("table_id"))


@query()
def enhanced_grids(t):
    """Sections are carried down the rows of a grid; the tests fold by hand."""
    g = _grids(t).select("table_id", F.concat(F.array("head"), "grid").alias("grid"))
    return S.enhanced_grids(g).select("table_id", F.array_join("column_headers", "; ").alias("headers"), F.size("rows").alias("n_rows"))


@query(f"WITH {_EL}, s AS (SELECT doc, CASE WHEN type = 'section_header' THEN 14.0 WHEN type = 'list_item' THEN 7.0 ELSE 10.0 END AS size, trim(text, ' ') AS t, * EXCLUDE (doc) FROM el), z AS (SELECT doc, size, sum(length(t)) AS n FROM s WHERE t <> '' GROUP BY ALL), b AS (SELECT doc, arg_max(size, (n, -size)) AS body FROM z GROUP BY 1) SELECT chunk_id, CASE WHEN size < 0.8 * body THEN 'footnote' WHEN regexp_matches(lower(t), '^(?:figure|fig[.]|fig )') THEN 'figure_caption' WHEN starts_with(lower(t), 'table') THEN 'table_caption' WHEN size >= 1.4 * body THEN 'title' WHEN size >= 1.15 * body AND length(t) < 200 THEN 'section_header' WHEN x1 - x0 > 0 AND (y1 - y0) / (x1 - x0) > 5 THEN 'abandon' ELSE 'plain text' END AS type FROM s LEFT JOIN b USING (doc)")
def font_layout(t):
    """Chunks as spans whose size their type tells."""
    size = F.when(F.col("type") == "section_header", 14.0).when(F.col("type") == "list_item", 7.0).otherwise(10.0)
    e = _elements(t)
    spans = e.select("doc", "page", F.col("chunk_id").alias("block"), size.alias("size"), "text", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return S.font_layout(spans).select(F.col("block").alias("chunk_id"), "type")


@query("WITH w AS (SELECT DISTINCT table_id, row_id, cell_id, raw_value, regexp_extract(row_id, '_r([0-9]+)$', 1)::INT AS r, regexp_extract(cell_id, '_c([0-9]+)$', 1)::INT AS c FROM table_cells WHERE regexp_matches(cell_id, '_r[0-9]+_c[0-9]+$')), d AS (SELECT table_id, r, c, string_agg(raw_value, ' ' ORDER BY raw_value) AS cell FROM w GROUP BY ALL), rr AS (SELECT DISTINCT table_id, r FROM w), cc AS (SELECT DISTINCT table_id, c FROM w) SELECT table_id, dense_rank() OVER (PARTITION BY table_id ORDER BY r) - 1 AS row_no, dense_rank() OVER (PARTITION BY table_id ORDER BY c) - 1 AS col_no, coalesce(cell, '') AS cell FROM rr JOIN cc USING (table_id) LEFT JOIN d USING (table_id, r, c)")
def cell_grids(t):
    """Rows, columns and words placed by their numbers, ten points apart."""
    w = t("table_cells").where("cell_id rlike '_r[0-9]+_c[0-9]+$'").select("table_id", F.regexp_extract("row_id", "_r([0-9]+)$", 1).cast("int").alias("r"), F.regexp_extract("cell_id", "_c([0-9]+)$", 1).cast("int").alias("c"), "raw_value", "cell_id", "row_id").distinct()
    def at(c: str, d: float = 0.0):
        return (F.col(c) * 10 + d).cast("double")

    rows = w.select("table_id", "r").distinct().select("table_id", F.lit(0.0).alias("x0"), at("r").alias("y0"), F.lit(1e6).alias("x1"), at("r", 10.0).alias("y1"))
    columns = w.select("table_id", "c").distinct().select("table_id", at("c").alias("x0"), F.lit(0.0).alias("y0"), at("c", 10.0).alias("x1"), F.lit(1e6).alias("y1"))
    words = w.where("raw_value is not null").select("table_id", F.col("raw_value").alias("text"), at("c", 2.0).alias("x0"), at("r", 2.0).alias("y0"), at("c", 8.0).alias("x1"), at("r", 8.0).alias("y1"))
    g = S.cell_grid(rows, columns, words)
    return g.select("table_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "cell")


@query("SELECT DISTINCT query_id, coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0)::DOUBLE AS similarity FROM (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(query, '')), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(ground_truth, '')), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')) AS b FROM predictions)")
def caption_similarities(t):
    """Q21."""
    return t("predictions").select("query_id", P.caption_similarity(F.col("query"), F.col("ground_truth")).alias("similarity")).distinct()


@query("WITH s AS (SELECT DISTINCT query_id, query, ground_truth, coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0)::DOUBLE AS s FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(query, '')), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(ground_truth, '')), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')) AS b FROM predictions)) SELECT query_id, CASE WHEN s < 0.2 THEN coalesce(upper(query), query) ELSE query END AS caption FROM s")
def rewritten_captions(t):
    """Q22 with upper case in place of a model."""
    p = t("predictions").select("query_id", "query", "ground_truth").distinct()
    return p.select("query_id", P.rewritten(F.col("query"), F.col("ground_truth"), lambda c, _: F.upper(c)).alias("caption"))


@query("WITH a AS (SELECT DISTINCT query_id AS row_id, query AS prompt FROM predictions), c AS (SELECT DISTINCT prompt FROM a WHERE length(prompt) % 2 = 0) SELECT row_id, CASE WHEN prompt IS NULL THEN NULL WHEN c.prompt IS NOT NULL THEN 'cached' ELSE reverse(prompt) END AS response FROM a LEFT JOIN c USING (prompt)")
def cached_answers(t):
    """Q19: half of the prompts are in the cache, the others are answered by turning them round."""
    a = t("predictions").select(F.col("query_id").alias("row_id"), F.col("query").alias("prompt")).distinct()
    cache = a.where("length(prompt) % 2 = 0").select(F.md5(F.concat(F.lit("m:"), "prompt")).alias("key"), F.lit("cached").alias("response")).distinct()
    answers, _ = P.cached_calls(a, cache, F.reverse, "m")
    return answers


@query("SELECT judge, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT unnest([{'judge': 'contains', 'v': c}, {'judge': 'length', 'v': l}], recursive := true) FROM (SELECT DISTINCT query_id, CASE WHEN ground_truth IS NULL OR e2e_prediction IS NULL THEN NULL ELSE contains(lower(e2e_prediction), lower(ground_truth))::INT::DOUBLE END AS c, length(e2e_prediction)::DOUBLE AS l FROM predictions)) GROUP BY judge")
def judge_means(t):
    """Two judges and the means of their scores."""
    a = t("predictions").select("query_id", "query", F.col("e2e_prediction").alias("answer"), F.col("ground_truth").alias("gold")).distinct()
    judges = {"contains": lambda q, p, g: F.lower(p).contains(F.lower(g)).cast("double"), "length": lambda q, p, g: F.length(p).cast("double")}
    return P.score_means(P.judged(a, judges), list(judges)).select("judge", F.round("mean", 6).alias("mean"), "n")


@query()
def hybrid_retrieval(t):
    """Q11, Q12: fused with vectors of hashed tokens, whose hash SQL does not have."""
    h = P.hybrid(t("documents"), t("qa_bank"), "doc_id", "text", "question_id", "question", k=20)
    return h.select("query_id", "item_id", F.round("score", 8).alias("score"), "rank")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id FROM documents LIMIT 50)")
def seeded_sample(t):
    """Fifty rows by a seeded hash; the sample itself is the feature."""
    s = I.sample(t("documents"), "doc_id", 50)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT id, gt_text_status AS status, round((bbox_norm::JSON->>'x')::DOUBLE + (bbox_norm::JSON->>'w')::DOUBLE, 6) AS x1, round((bbox_norm::JSON->>'y')::DOUBLE + (bbox_norm::JSON->>'h')::DOUBLE, 6) AS y1 FROM medcore_text_gt_flat WHERE gt_text_status = 'checked'")
def checked_zones(t):
    """S5."""
    z = I.zones(t("medcore_text_gt_flat"), ["checked"])
    return z.select("id", F.col("gt_text_status").alias("status"), F.round("bbox.x1", 6).alias("x1"), F.round("bbox.y1", 6).alias("y1"))


@query("SELECT DISTINCT query_id, query, ground_truth, doc_stem AS doc_id FROM predictions")
def custom_items(t):
    """Columns of other names, answers as lists."""
    p = t("predictions").select(F.col("query_id").alias("uid"), F.col("query").alias("Q"), F.when(F.col("ground_truth").isNotNull(), F.array("ground_truth")).alias("gold"), F.col("doc_stem").alias("document"))
    return I.by_alias(p).distinct()


@query(f"WITH {_GRID} SELECT table_id, len(grid[1]) - 1 AS n_headers, len(grid) - 1 AS n_rows, coalesce(grid[2][1], '') AS first_label FROM g")
def labelled_grids(t):
    """S7."""
    g = I.grid_to_table(_grids(t).select("table_id", "grid"))
    return g.select("table_id", F.size("column_headers").cast("long").alias("n_headers"), F.size("rows").cast("long").alias("n_rows"), F.coalesce(F.get("rows", F.lit(0))["row_label"], F.lit("")).alias("first_label"))


@query(f"WITH {_EL} SELECT doc AS image_id, type AS label, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM el")
def coco_boxes(t):
    """Boxes packed into annotations of a file and unpacked."""
    e = _elements(t)
    b = F.array(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0"))
    packed = e.select("doc", "type", b.alias("b")).groupBy(F.col("doc").alias("image_id")).agg(F.collect_list(F.struct("type", "b")).alias("a")).select("image_id", F.col("a.type").alias("category_id"), F.col("a.b").alias("bbox"))
    return I.coco_boxes(packed).select("image_id", "label", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {_EL}, s AS (SELECT *, sum(s) OVER (PARTITION BY doc, page ORDER BY seq) AS run FROM (SELECT *, (type IS DISTINCT FROM lag(type) OVER (PARTITION BY doc, page ORDER BY seq))::INT AS s FROM el)) SELECT doc, page, run::BIGINT AS run, any_value(type) AS label, round(min(x0) / 1000, 6) AS x0, round(max(y1) / 1000, 6) AS y1 FROM s GROUP BY doc, page, run")
def token_runs(t):
    """S12."""
    e = _elements(t).select("doc", "page", F.col("seq").alias("pos"), F.col("type").alias("label"), *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return I.token_runs(e).select("doc", "page", F.col("run").cast("long").alias("run"), "label", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query("SELECT question_id, trim(regexp_replace(regexp_replace(question, '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ | $', '', 'g'), ' ') AS collapsed FROM qa_bank")
def collapsed_space(t):
    """F9."""
    return t("qa_bank").select("question_id", X.collapse_space("question").alias("collapsed"))

"""Filters and projections of documents, elements and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.functions import text as X
from docloom.operators import filters as P

query = Catalog()

# Detector labels that the classes of scanned zones stand for here.
LABELS = {"title": "title", "paragraph": "plain text", "figure": "figure", "caption": "figure_caption", "header": "abandon", "footer": "abandon", "section_header": "plain text"}
_LABEL = "CASE zone_class WHEN 'title' THEN 'title' WHEN 'paragraph' THEN 'plain text' WHEN 'figure' THEN 'figure' WHEN 'caption' THEN 'figure_caption' WHEN 'header' THEN 'abandon' WHEN 'footer' THEN 'abandon' WHEN 'section_header' THEN 'plain text' ELSE 'other' END"
_KIND = f"CASE {_LABEL} WHEN 'title' THEN 'title' WHEN 'figure' THEN 'figure' WHEN 'abandon' THEN 'boilerplate' ELSE 'paragraph' END"
_OPENING = r"^(?:[A-Z][ \t\n]*\n?[ \t\n]+[a-zA-Z]|Appendix[ \t\n]+[A-Z])"


def _zones(t):
    return t("medcore_text_gt_flat").withColumn("label", F.coalesce(X.literal_map(LABELS)[F.col("zone_class")], F.lit("other")))


@query(f"SELECT id, CASE WHEN {_KIND} <> 'title' AND regexp_matches(trim(coalesce(gt_text, ''), ' '), '{_OPENING}') THEN 'title' ELSE {_KIND} END AS element_type FROM (SELECT DISTINCT id, zone_class, gt_text FROM medcore_text_gt_flat)")
def element_types(t):
    """P14."""
    return _zones(t).select("id", "zone_class", "gt_text", "label").distinct().select("id", P.element_type(F.col("label"), F.col("gt_text")).alias("element_type"))


@query(f"SELECT {_LABEL} = 'abandon' AS discarded, count(*) AS n, sum(coalesce(length(gt_text), 0))::BIGINT AS n_chars FROM medcore_text_gt_flat GROUP BY 1")
def boilerplate_split(t):
    """Kept and discarded elements, from one flag."""
    return _zones(t).groupBy(P.is_boilerplate(F.col("label")).alias("discarded")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("gt_text"), F.lit(0))).alias("n_chars"))


@query("SELECT doc_id FROM documents WHERE source NOT IN ('notice', 'standards') OR (source = 'notice')")
def role_filter(t):
    """Notices are for two roles, standards for one that the caller does not have, all else is open."""
    roles = F.when(F.col("source") == "notice", F.array(F.lit("legal"), F.lit("audit"))).when(F.col("source") == "standards", F.array(F.lit("quality")))
    return t("documents").withColumn("allowed", roles).where(P.may_read(F.col("allowed"), ["audit", "sales"])).select("doc_id")


@query("SELECT question_id FROM (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS n FROM qa_bank) WHERE n % 5 = 0 OR question_id IN ('QB-0103', 'QB-0110')")
def judge_sample(t):
    """P10."""
    return P.judge_sample(t("qa_bank"), ["question_id"], 5, wanted=["QB-0103", "QB-0110"]).select("question_id")


@query("SELECT DISTINCT query_id, CASE lower(trim(coalesce(query_type, ''), ' ')) WHEN 'multi-span' THEN 'multi_span' WHEN 'span' THEN 'short' WHEN 'count' THEN 'short' WHEN 'arithmetic' THEN 'short' ELSE 'prose' END AS form FROM predictions UNION ALL SELECT question_id, CASE lower(trim(coalesce(reasoning_type, ''), ' ')) WHEN 'multi-span' THEN 'multi_span' WHEN 'span' THEN 'short' WHEN 'count' THEN 'short' WHEN 'arithmetic' THEN 'short' ELSE 'prose' END FROM qa_bank")
def answer_forms(t):
    """P12."""
    one = t("predictions").select("query_id", P.answer_form(F.col("query_type")).alias("form")).distinct()
    return one.unionByName(t("qa_bank").select(F.col("question_id").alias("query_id"), P.answer_form(F.col("reasoning_type")).alias("form")))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 3000 THEN 'too_large' WHEN NOT starts_with(text, 'The') THEN 'no_magic' WHEN len(text) - len(replace(text, chr(10), '')) > 40 THEN 'too_many_pages' END AS fault FROM documents")
def upload_faults(t):
    """P15 with limits and a magic of these texts, as there are no PDF files here."""
    text = F.col("text")
    size, lines = F.octet_length("text"), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    fault = F.when(size > 3000, "too_large").when(~text.startswith("The"), "no_magic").when(lines > 40, "too_many_pages")
    return t("documents").select("doc_id", fault.alias("fault"))


@query("SELECT DISTINCT chunk_id, list_transform(page_span, lambda p: p + CASE WHEN doc_filename LIKE '%catalogue%' THEN 1 ELSE 0 END) AS pages FROM chunks")
def page_offsets(t):
    """Files whose name tells of a cover page are one page ahead of the printed numbers."""
    c = t("chunks").select("chunk_id", "page_span", F.when(F.col("doc_filename").contains("catalogue"), "cover").otherwise("none").alias("kind"))
    return c.select("chunk_id", P.shifted_pages(F.col("page_span"), F.col("kind"), {"cover": 1}).alias("pages")).distinct()


@query("SELECT doc_id FROM documents WHERE (len(text) - len(replace(text, '|', ''))) >= 5 OR regexp_matches(lower(text), 'figure|chart|diagram|abbildung')")
def visual_hints(t):
    """P20: rules of a table count as drawings."""
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("|"), F.lit("")))
    return t("documents").where(P.has_visual_hints(n, F.col("text"), ["figure", "chart", "diagram", "abbildung"])).select("doc_id")


@query("SELECT chunk_id, coalesce(len(list_filter(element_types, lambda x: x = 'figure')) > 0 AND len(list_filter(element_types, lambda x: x <> 'figure')) = 0, false) AS figure_only FROM (SELECT DISTINCT chunk_id, element_types FROM chunks)")
def figure_only(t):
    """Chunks made of figures alone; elements are taken as files, figures as images."""
    files = F.transform("element_types", lambda e: F.when(e == "figure", F.lit("f.png")).otherwise(F.lit("t.txt")))
    c = t("chunks").select("chunk_id", "element_types").distinct()
    return c.select("chunk_id", F.coalesce(P.is_figure_only(F.lit(""), files), F.lit(False)).alias("figure_only"))


@query("SELECT coalesce(CASE lower(trim(zone_class, ' ')) WHEN 'title' THEN 'Title' WHEN 'section_header' THEN 'Section-header' WHEN 'paragraph' THEN 'Text' WHEN 'figure' THEN 'Picture' WHEN 'header' THEN 'Page-header' WHEN 'footer' THEN 'Page-footer' END, zone_class) AS label, count(*) AS n FROM medcore_text_gt_flat GROUP BY 1")
def unified_classes(t):
    """P23."""
    names = {"title": "Title", "section_header": "Section-header", "paragraph": "Text", "figure": "Picture", "header": "Page-header", "footer": "Page-footer"}
    return t("medcore_text_gt_flat").groupBy(P.unified(F.col("zone_class"), names).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH q AS (SELECT DISTINCT query_id, doc_stem, (hash_page % 40) + 1 AS page FROM (SELECT query_id, doc_stem, length(query) AS hash_page FROM predictions)), f AS (SELECT DISTINCT regexp_replace(doc_filename, '[.]pdf$', '') AS doc_stem, page FROM chunks WHERE list_contains(element_types, 'table') OR list_contains(element_types, 'figure')) SELECT DISTINCT query_id FROM q JOIN f USING (doc_stem, page)")
def figure_linked_questions(t):
    """Questions whose gold page, here told by the length of the question, holds a table or figure."""
    asked = t("predictions").select(F.col("query_id").alias("question_id"), "doc_stem", F.array((F.length("query") % 40 + 1).cast("int")).alias("gold_pages"))
    linked = t("chunks").where(F.arrays_overlap("element_types", F.array(F.lit("table"), F.lit("figure")))).select(F.regexp_replace("doc_filename", "[.]pdf$", "").alias("doc_stem"), "page")
    return P.with_gold_page(asked, linked).select(F.col("question_id").alias("query_id")).distinct()


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_jobs(t):
    """The last 20 by time."""
    e = t("events").where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))

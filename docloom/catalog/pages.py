"""Boxes of a page and what belongs to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.operators import mesh as M
from docloom.operators import pages as P

query = Catalog()

_EL = (
    "e0 AS (SELECT chunk_id, min({'doc_filename': doc_filename, 'page': page, 'type': coalesce(element_types[1], 'text'), 'text': text, 'b': {'x0': bbox_union.x0, 'y0': bbox_union.y0, 'x1': bbox_union.x1, 'y1': bbox_union.y1}}) AS e FROM chunks WHERE page IS NOT NULL AND doc_filename IS NOT NULL AND text IS NOT NULL AND bbox_union IS NOT NULL GROUP BY chunk_id), "
    "el AS (SELECT chunk_id, e.doc_filename AS doc, e.page AS page, e.type AS type, e.text AS text, e.b.x0 AS x0, e.b.y0 AS y0, e.b.x1 AS x1, e.b.y1 AS y1, row_number() OVER (PARTITION BY e.doc_filename, e.page ORDER BY chunk_id)::INT AS seq FROM e0)"
)
_SH = lambda lo, hi, size: f"greatest(0, least(f.{hi}, b.{hi}) - greatest(f.{lo}, b.{lo})) / least(greatest(1, f.{hi} - f.{lo}), greatest(1, b.{hi} - b.{lo}))"
_XS, _YS = _SH("x0", "x1", "w"), _SH("y0", "y1", "h")
_FH, _FW = "greatest(1, f.y1 - f.y0)", "greatest(1, f.x1 - f.x0)"
_DRIFT = "abs((f.x0 + f.x1) / 2 - (b.x0 + b.x1) / 2)"


def _elements(t):
    return M.boxed_elements(t("chunks"))


def _flat(e):
    return e.select("doc", "page", "seq", "chunk_id", "type", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query()
def merged_tables(t):
    """Tables moved by ten points to table boxes, each box used once; the choice depends on earlier ones, so there is no SQL."""
    e = _flat(_elements(t).where("type in ('table', 'text')"))
    moved = e.withColumns({"x0": F.col("x0") + 10, "x1": F.col("x1") + 10}).withColumn("table_id", F.col("chunk_id"))
    return P.merge_tables(moved, e, ["doc", "page"])


@query(f"WITH {_EL}, p AS (SELECT f.doc, f.page, f.chunk_id AS fig_id, b.chunk_id AS o, b.text AS caption, greatest(0, least(f.x1, b.x1) - greatest(f.x0, b.x0)) * greatest(0, least(f.y1, b.y1) - greatest(f.y0, b.y0)) AS i, (f.x1 - f.x0) * (f.y1 - f.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM el f LEFT JOIN el b ON f.doc = b.doc AND f.page = b.page AND b.type <> 'table') SELECT fig_id, coalesce(arg_min(length(caption), o) FILTER (WHERE i / nullif(u - i, 0) > 0.1), 40)::BIGINT AS n_chars FROM p GROUP BY fig_id")
def figure_captions(t):
    """Every box with the text of the first that overlaps it."""
    e = _elements(t)
    figs = e.select("doc", "page", F.col("chunk_id").alias("fig_id"), "bbox")
    extracted = e.where("type <> 'table'").select("doc", "page", "bbox", F.col("chunk_id").alias("order"), F.col("text").alias("caption"))
    c = P.figure_captions(figs, extracted, ["doc", "page"])
    return c.select("fig_id", F.length("caption").cast("long").alias("n_chars"))


@query(
    f"WITH {_EL}, pg AS (SELECT doc, page, greatest(612.0, max(x1)) AS pw, greatest(792.0, max(y1)) AS ph FROM el GROUP BY ALL), f AS (SELECT * FROM el WHERE type = 'figure'), b AS (SELECT * FROM el WHERE type IN ('section_header', 'title', 'table')), "
    f"p AS (SELECT f.chunk_id AS figure_id, b.chunk_id AS id, b.type AS type, CASE WHEN b.type <> 'table' AND b.y1 <= f.y0 + 10 AND f.y0 - b.y1 <= 0.30 * ph AND {_XS} >= 0.15 THEN round({_XS} / (1 + (f.y0 - b.y1) / {_FH} + 3 * {_DRIFT} / {_FW}) * CASE b.type WHEN 'title' THEN 0.5 ELSE 1.0 END, 9) END AS h1, "
    f"CASE WHEN b.type <> 'table' AND b.y1 <= f.y0 + 15 THEN round(1 / (1 + (f.y0 - b.y1) / {_FH} + {_DRIFT} / {_FW}) * CASE b.type WHEN 'title' THEN 0.8 ELSE 1.0 END, 9) END AS h2, "
    f"CASE WHEN b.type = 'table' AND {_YS} >= 0.25 AND {_XS} < 0.15 AND greatest(0, b.x0 - f.x1, f.x0 - b.x1) <= 0.20 * pw THEN round({_YS} * exp(-greatest(0, b.x0 - f.x1, f.x0 - b.x1) / (0.06 * pw)) / (1 + abs((f.y0 + f.y1) / 2 - (b.y0 + b.y1) / 2) / {_FH}), 9) END AS ts FROM f JOIN pg USING (doc, page) LEFT JOIN b ON f.doc = b.doc AND f.page = b.page) "
    "SELECT figure_id, coalesce(arg_max(id, (h1, id)) FILTER (WHERE h1 IS NOT NULL), arg_max(id, (h2, id)) FILTER (WHERE h2 IS NOT NULL)) AS heading_id, arg_max(id, (ts, id)) FILTER (WHERE ts IS NOT NULL) AS table_id FROM p GROUP BY figure_id"
)
def figure_context(t):
    """J13, G11."""
    return P.figure_context(_elements(t), ["doc", "page"]).select("figure_id", "heading_id", "table_id")


@query(
    f"WITH {_EL}, f AS (SELECT doc, page, chunk_id AS figure_id, x0, y0, x1, y1, seq FROM el WHERE type = 'figure'), c AS (SELECT * FROM el WHERE type = 'table' OR contains(lower(text), 'table') OR contains(lower(text), 'figure')), p AS (SELECT c.chunk_id, f.figure_id, CASE WHEN abs((c.y0 + c.y1) / 2 - (f.y0 + f.y1) / 2) < 100 OR abs(c.seq - f.seq) <= 3 THEN 1.0 ELSE 0.5 END AS conf, round(sqrt(((c.x0 + c.x1) / 2 - (f.x0 + f.x1) / 2) ** 2 + ((c.y0 + c.y1) / 2 - (f.y0 + f.y1) / 2) ** 2), 9) AS d FROM c JOIN f USING (doc, page)) "
    "SELECT el.chunk_id, arg_min(figure_id, (-conf, d, figure_id)) AS figure_id, coalesce(max(conf), 0)::DOUBLE AS link_confidence FROM el LEFT JOIN p USING (chunk_id) GROUP BY el.chunk_id"
)
def linked_figures(t):
    """J14."""
    e = _elements(t)
    chunks = e.select("doc", "page", "chunk_id", "text", "bbox", F.array("type").alias("element_types"), F.array("seq").alias("orders"))
    figs = e.where("type = 'figure'").select("doc", "page", F.col("chunk_id").alias("figure_id"), "bbox", F.col("seq").alias("order"))
    return P.linked_figures(chunks, figs, ["doc", "page"])


@query(f"WITH {_EL}, g AS (SELECT * FROM el WHERE type = 'table'), p AS (SELECT g.chunk_id AS gold_id, b.chunk_id AS found_id, round(coalesce(greatest(0, least(g.x1, b.x1) - greatest(g.x0, b.x0)) * greatest(0, least(g.y1, b.y1) - greatest(g.y0, b.y0)) / nullif((g.x1 - g.x0) * (g.y1 - g.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(g.x1, b.x1) - greatest(g.x0, b.x0)) * greatest(0, least(g.y1, b.y1) - greatest(g.y0, b.y0)), 0), 0), 9) AS iou FROM g LEFT JOIN el b ON g.doc = b.doc AND g.page = b.page AND b.chunk_id <> g.chunk_id) SELECT gold_id, CASE WHEN max(coalesce(iou, 0)) >= 0.3 THEN arg_min(found_id, (-iou, found_id)) END AS found_id, max(coalesce(iou, 0)) AS iou FROM p GROUP BY gold_id")
def table_detections(t):
    """Tables against the other boxes of their page."""
    e = _elements(t)
    gold = e.where("type = 'table'").select("doc", "page", F.col("chunk_id").alias("gold_id"), "bbox")
    # each table is compared with its page's boxes but itself, so the key is the page and the table
    others = e.select("doc", "page", F.col("chunk_id").alias("found_id"), "bbox")
    found = gold.select("doc", "page", "gold_id").join(others, ["doc", "page"]).where("gold_id <> found_id")
    return P.table_detections(gold, found, ["doc", "page", "gold_id"]).select("gold_id", "found_id", "iou")


@query(f"WITH {_EL}, b AS (SELECT doc, page, chunk_id, row_number() OVER (PARTITION BY doc, page ORDER BY y0, x0, chunk_id) AS n FROM el WHERE type = 'table'), m AS (SELECT doc_name AS doc, page, table_id, row_number() OVER (PARTITION BY doc_name, page ORDER BY table_id) AS n FROM table_metadata) SELECT chunk_id, table_id FROM b LEFT JOIN m USING (doc, page, n)")
def tables_by_ordinal(t):
    """J24."""
    b = _flat(_elements(t).where("type = 'table'"))
    m = t("table_metadata").select(F.col("doc_name").alias("doc"), "page", "table_id")
    return P.by_ordinal(b, m, ["doc", "page"], ["y0", "x0", "chunk_id"], ["table_id"]).select("chunk_id", "table_id")


@query("WITH z AS (SELECT DISTINCT id, zone_class, ((bbox_norm::JSON->>'y')::DOUBLE + (bbox_norm::JSON->>'h')::DOUBLE / 2) AS mid FROM medcore_text_gt_flat WHERE bbox_norm IS NOT NULL) SELECT id, CASE WHEN zone_class IN ('header', 'footer', 'caption') THEN CASE WHEN mid < 0.12 THEN 'page_header' WHEN mid > 0.88 THEN 'page_footer' ELSE 'footnote' END WHEN zone_class = 'title' THEN 'title' WHEN zone_class = 'section_header' THEN 'section_header' WHEN zone_class = 'figure' THEN 'picture' WHEN zone_class = 'table' THEN 'table' WHEN zone_class = 'list_item' THEN 'list_item' ELSE 'text' END AS layout_class FROM z")
def layout_classes(t):
    """Running zones and captions are read as margin notes."""
    b = F.from_json("bbox_norm", "x double, y double, w double, h double")
    z = t("medcore_text_gt_flat").where("bbox_norm is not null").select("id", "zone_class", "bbox_norm").distinct()
    box = F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["w"]).alias("x1"), (b["y"] + b["h"]).alias("y1"))
    label = F.when(F.col("zone_class").isin("header", "footer", "caption"), "marginalia").otherwise(F.coalesce("zone_class", F.lit("")))
    return z.select("id", P.layout_class(label, box, F.lit(1.0)).alias("layout_class"))


@query()
def section_paths(t):
    """The level of an unnumbered title is that of the one before, so there is no SQL; the tests fold by hand."""
    e = _elements(t)
    paths = P.section_paths(e, "doc", ["page", "seq"], F.col("type").isin("title", "section_header"))
    return paths.select("chunk_id", F.size("section_path").alias("depth"), F.array_join("section_path", " > ").alias("path"))

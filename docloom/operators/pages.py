"""Boxes of a page and what belongs to them: tables, captions, headings, paragraphs, figures linked to chunks.

The page is the key of every join; what depends on earlier choices runs as a grouped map over one page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as X

# Weights of the kinds of heading, first where all limits hold, then without them.
HEADING_WEIGHT = {"figure_caption": 2.0, "table_caption": 1.5, "section_header": 1.0, "title": 0.5, "header": 0.3}
LOOSE_WEIGHT = {"figure_caption": 2.0, "table_caption": 1.5, "section_header": 1.0, "title": 0.8}
#: Least size of a page in points.
PAGE_W, PAGE_H = 612.0, 792.0
# Detector labels and the classes of the layout benchmark they stand for.
LAYOUT_CLASS = {
    "text": "text", "attestation": "text", "card": "text", "table": "table", "figure": "picture", "logo": "picture", "barcode": "picture", "scan_code": "picture", "signature": "picture",
    "heading": "title", "title": "title", "section_header": "section_header", "list_item": "list_item",
}


def merge_tables(tables: DataFrame, elements: DataFrame, page: list[str]) -> DataFrame:
    """(page keys, table_id, seq): each extracted table, in order of id, takes the free table box of the nearest centre; once
    all are taken, the first. Both sides have x0, y0, x1, y1.
    """
    box = ["x0", "y0", "x1", "y1"]
    kinds = {f.name: f.dataType.simpleString() for f in (*tables.schema.fields, *elements.schema.fields)}

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("table_id"), b.sort_values("seq")
        x = (b[["x0", "y0"]].to_numpy(float) + b[["x1", "y1"]].to_numpy(float)) / 2
        free, rows = list(range(len(b))), []
        for t, c in zip(a["table_id"], (a[["x0", "y0"]].to_numpy(float) + a[["x1", "y1"]].to_numpy(float)) / 2):
            if len(b):
                k = min(free, key=lambda i: (((x[i] - c) ** 2).sum(), i)) if free else 0
                free = [i for i in free if i != k]
                rows.append((*key, t, b["seq"].iloc[k]))
        return pd.DataFrame(rows, columns=[*page, "table_id", "seq"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*page, "table_id", "seq"))
    # columns of their own, as both sides may come from one table
    right = elements.select(*[F.col(c).alias(c) for c in (*page, "seq", *box)])
    return tables.select(*page, "table_id", *box).groupBy(*page).cogroup(right.groupBy(*page)).applyInPandas(run, schema)


def figure_captions(figures: DataFrame, extracted: DataFrame, page: list[str], least: float = 0.1, default: str = "Visual representation from the document.") -> DataFrame:
    """Each figure (fig_id, bbox) with the caption of the first extracted one (order, bbox, caption) that overlaps it by more than ``least``."""
    right = extracted.select(*page, F.col("bbox").alias("_b"), "order", "caption")
    pairs = figures.join(right, page, "left").withColumn("_hit", F.when(G.iou(F.col("bbox"), F.col("_b")) > least, F.struct("order", "caption")))
    first = pairs.groupBy(*page, "fig_id").agg(F.min("_hit").alias("_f"))
    return first.select(*page, "fig_id", F.coalesce(F.when(F.trim(F.col("_f.caption")) != "", F.col("_f.caption")), F.lit(default)).alias("caption"))


def _w(b: Column) -> Column:
    return F.greatest(F.lit(1.0), b["x1"] - b["x0"])


def _h(b: Column) -> Column:
    return F.greatest(F.lit(1.0), b["y1"] - b["y0"])


def _cx(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def _cy(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def _share(a0: Column, a1: Column, b0: Column, b1: Column, least: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / least


def x_share(a: Column, b: Column) -> Column:
    """Overlap of the x extents as a share of the narrower box, of one point at least."""
    return _share(a["x0"], a["x1"], b["x0"], b["x1"], F.least(_w(a), _w(b)))


def y_share(a: Column, b: Column) -> Column:
    return _share(a["y0"], a["y1"], b["y0"], b["y1"], F.least(_h(a), _h(b)))


def heading_score(fig: Column, el: Column, kind: Column, page_h: Column) -> Column:
    """A heading above a figure in its column, or null: nearness below and beside it, weighted by its kind."""
    dy, drift = fig["y0"] - el["y1"], F.abs(_cx(fig) - _cx(el))
    raw = x_share(fig, el) / (1 + dy / _h(fig) + 3 * drift / _w(fig))
    ok = (el["y1"] <= fig["y0"] + 10) & (dy <= 0.30 * page_h) & (x_share(fig, el) >= 0.15)
    return F.when(ok, raw * F.coalesce(X.literal_map(HEADING_WEIGHT)[kind], F.lit(1.0)))


def loose_heading_score(fig: Column, el: Column, kind: Column) -> Column:
    """As above without limits of column and distance, for figures that have no heading otherwise."""
    dy, drift = fig["y0"] - el["y1"], F.abs(_cx(fig) - _cx(el))
    raw = 1 / (1 + dy / _h(fig) + drift / _w(fig))
    return F.when(el["y1"] <= fig["y0"] + 15, raw * F.coalesce(X.literal_map(LOOSE_WEIGHT)[kind], F.lit(0.5)))


def table_score(fig: Column, el: Column, page_w: Column) -> Column:
    """A table beside a figure, or null."""
    dx = F.greatest(F.lit(0.0), el["x0"] - fig["x1"], fig["x0"] - el["x1"])
    raw = y_share(fig, el) * F.exp(-dx / (0.06 * page_w)) / (1 + F.abs(_cy(fig) - _cy(el)) / _h(fig))
    return F.when((y_share(fig, el) >= 0.25) & (x_share(fig, el) < 0.15) & (dx <= 0.20 * page_w), raw)


def figure_context(elements: DataFrame, page: list[str], key: str = "chunk_id") -> DataFrame:
    """Each figure of a page with the best heading above it and the best table beside it, by their scores; ties by key."""
    size = elements.groupBy(*page).agg(F.greatest(F.lit(PAGE_W), F.max("bbox.x1")).alias("_pw"), F.greatest(F.lit(PAGE_H), F.max("bbox.y1")).alias("_ph"))
    figs = elements.where("type = 'figure'").select(*page, F.col(key).alias("figure_id"), F.col("bbox").alias("_f"))
    others = elements.where(F.col("type").isin([*HEADING_WEIGHT, "table"])).select(*page, F.col(key).alias("_id"), "type", F.col("bbox").alias("_b"))
    pairs = figs.join(size, page).join(others, page, "left")
    f, b, heading = F.col("_f"), F.col("_b"), F.col("type").isin(list(HEADING_WEIGHT))
    best = lambda s: F.max(F.when(s.isNotNull(), F.struct(F.round(s, 9).alias("s"), F.col("_id").alias("id"))))
    out = pairs.groupBy(*page, "figure_id").agg(
        best(F.when(heading, heading_score(f, b, F.col("type"), F.col("_ph")))).alias("_h1"), best(F.when(heading, loose_heading_score(f, b, F.col("type")))).alias("_h2"), best(F.when(F.col("type") == "table", table_score(f, b, F.col("_pw")))).alias("_t")
    )
    return out.select(*page, "figure_id", F.coalesce("_h1.id", "_h2.id").alias("heading_id"), F.col("_t.id").alias("table_id"))


def linked_figures(chunks: DataFrame, figures: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """Each chunk with the figure of its page it is linked to and the confidence, or null and 0.

    Only chunks with a table, or that name a table or figure, are linked: with 1 where the vertical centres are under 100
    apart or the places in reading order within 3, else with 0.5; then the nearest, ties by figure. ``orders`` are a chunk's places.
    """
    right = figures.select(*page, "figure_id", F.col("bbox").alias("_b"), "order")
    may = F.array_contains("element_types", "table") | F.lower("text").contains("table") | F.lower("text").contains("figure")
    near = (F.abs(_cy(F.col("bbox")) - _cy(F.col("_b"))) < 100) | F.coalesce(F.exists("orders", lambda o: F.abs(o - F.col("order")) <= 3), F.lit(False))
    confidence = F.when(near, 1.0).otherwise(0.5)
    distance = F.sqrt((_cx(F.col("bbox")) - _cx(F.col("_b"))) ** 2 + (_cy(F.col("bbox")) - _cy(F.col("_b"))) ** 2)
    pairs = chunks.where(may).join(right, page).withColumn("_c", confidence).where(F.col("_c") >= least)
    best = pairs.groupBy("chunk_id").agg(F.min(F.struct((-F.col("_c")).alias("c"), F.round(distance, 9).alias("d"), "figure_id")).alias("_m"))
    return chunks.select("chunk_id").distinct().join(best, "chunk_id", "left").select("chunk_id", F.col("_m.figure_id").alias("figure_id"), F.coalesce(-F.col("_m.c"), F.lit(0.0)).alias("link_confidence"))


def table_detections(gold: DataFrame, found: DataFrame, page: list[str], least: float = 0.3) -> DataFrame:
    """Each true table (gold_id, bbox) with the detection (found_id, bbox) of the greatest IoU on its page, if of at least ``least``."""
    pairs = gold.join(found.select(*page, "found_id", F.col("bbox").alias("_b")), page, "left").withColumn("_iou", F.coalesce(F.round(G.iou(F.col("bbox"), F.col("_b")), 9), F.lit(0.0)))
    best = pairs.groupBy("gold_id").agg(F.max("_iou").alias("iou"), F.min_by("found_id", F.struct(-F.col("_iou"), "found_id")).alias("found_id"))
    return best.select("gold_id", F.when(F.col("iou") >= least, F.col("found_id")).alias("found_id"), "iou")


def by_ordinal(boxes: DataFrame, tables: DataFrame, page: list[str], box_order: list[str], table_order: list[str]) -> DataFrame:
    """The n-th box of a page with the n-th extracted table; boxes without one are kept."""
    number = lambda order: F.row_number().over(W.partitionBy(*page).orderBy(*order))
    return boxes.withColumn("ordinal", number(box_order)).join(tables.withColumn("ordinal", number(table_order)), [*page, "ordinal"], "left")


def layout_class(label: Column, box: Column, page_h: Column) -> Column:
    """Benchmark class of a detector label; a margin note is a header, footer or footnote by its height. Others are text."""
    low, at = F.lower(label), _cy(box) / page_h
    margin = F.when(at < 0.12, "page_header").when(at > 0.88, "page_footer").otherwise("footnote")
    return F.when(low == "marginalia", margin).otherwise(F.coalesce(X.literal_map(LAYOUT_CLASS)[low], F.lit("text")))


def section_paths(elements: DataFrame, doc: str, order: list[str], title: Column, text: str = "text") -> DataFrame:
    """Path of section titles of each element, from the numbering of the titles.

    A title without a number has the level of the one before, the first level 1; a title closes all open ones of its level
    and below. Only titles are folded, document by document; other elements take the path of the title before, page by page.
    """
    from docloom.operators.sequences import carry_over_pages

    page, *_ = order
    titles = elements.where(title & (F.trim(F.coalesce(text, F.lit(""))) != "")).select(doc, *order, F.col(text).alias("_t"), X.heading_depth(text).alias("_l"))
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, F.col("_t").alias("t"), F.col("_l").alias("l"))))
    start = F.struct(F.lit(1).alias("level"), F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, one: Column) -> Column:
        level = F.coalesce(one["l"], acc["level"])
        stack = F.concat(F.slice(acc["stack"], 1, F.greatest(F.lit(0), F.least(level - 1, F.size(acc["stack"])))), F.array(one["t"]))
        return F.struct(level.alias("level"), stack.alias("stack"), F.concat(acc["out"], F.array(stack)).alias("out"))

    folded = titles.groupBy(doc).agg(sorted_.alias("_p")).select(doc, F.explode(F.arrays_zip("_p", F.aggregate("_p", start, step, lambda acc: acc["out"]).alias("_s"))).alias("z"))
    paths = folded.select(doc, *[F.col(f"z._p.{c}").alias(c) for c in order], F.col("z._s").alias("_own_path"))
    joined = elements.join(paths, [doc, *order], "left")
    carried = carry_over_pages(joined, [doc], page, order[1:], "_own_path", "section_path")
    return carried.withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>"))).drop("_own_path")

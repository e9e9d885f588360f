"""Layout metrics on the boxes of chunks against the same boxes moved or left out."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.catalog.pages import _EL, _elements
from docloom.functions import geometry as G
from docloom.operators import elements as E
from docloom.operators import layout as L
from docloom.operators import matching as M

query = Catalog()
PAGE = ["doc", "page"]


def _gold(t):
    e = _elements(t)
    return e.select(*PAGE, F.col("chunk_id").alias("box_id"), F.col("type").alias("label"), *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _found(t):
    """Boxes moved by a part of their size that their id tells, every ninth left out, every seventh with another label."""
    k = F.pmod(F.xxhash64("box_id"), F.lit(63))
    g = _gold(t).withColumn("_k", k).where("_k % 9 <> 0")
    move = (F.col("x1") - F.col("x0")) * (F.col("_k") % 5) * 0.1
    moved = g.withColumn("_d", move).withColumns({"x0": F.col("x0") + F.col("_d"), "x1": F.col("x1") + F.col("_d")})
    label = F.when(F.col("_k") % 7 == 0, "figure").otherwise(F.col("label"))
    return moved.select(*[F.col(c).alias(c) for c in (*PAGE, "box_id")], label.alias("label"), *[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")], (F.col("_k") / 63.0).alias("score"))


def _pairs(t):
    p = M.match_pages(_gold(t), _found(t), PAGE, 0.5, "optimal")
    g = _gold(t).select(F.col("box_id").alias("gold_id"), F.col("label").alias("gold_label"))
    f = _found(t).select(F.col("box_id").alias("found_id"), F.col("label").alias("found_label"))
    return p.join(g, "gold_id").join(f, "found_id")


@query()
def detection_scores(t):
    """By page, from optimal pairs."""
    return L.detection_scores(_gold(t), _found(t), _pairs(t), PAGE)


@query()
def layer_scores(t):
    """E21, strict and tolerant."""
    strict, loose = (L.layer_scores(_gold(t), _found(t), PAGE, {"list_item": "text"}, m) for m in (0.0, 0.05))
    return strict.withColumn("variant", F.lit("strict")).unionByName(loose.withColumn("variant", F.lit("tolerant")))


@query()
def label_confusion(t):
    """E39."""
    return L.confusion(_pairs(t))


@query()
def average_precision(t):
    """Hits are pairs with the same label."""
    p = _pairs(t).where("gold_label = found_label").select("found_id").distinct().withColumn("is_tp", F.lit(True))
    d = _found(t).join(p, F.col("box_id") == F.col("found_id"), "left").select("box_id", "label", "score", F.coalesce("is_tp", F.lit(False)).alias("is_tp"))
    return L.average_precision(d, _gold(t).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query()
def detection_protocol(t):
    """E27."""
    return L.detection_protocol(_gold(t), _found(t), PAGE)


@query()
def page_errors(t):
    """E24."""
    return L.page_errors(_gold(t), _found(t), PAGE)


@query()
def error_rates(t):
    """E45."""
    return L.error_rates(L.page_errors(_gold(t), _found(t), PAGE))


@query()
def page_coverage(t):
    """G8, E22."""
    return L.coverage(_gold(t), _found(t), PAGE)


@query()
def assigned_coverage(t):
    """E23."""
    return L.assigned_coverage(_gold(t), _found(t), PAGE, 612.0, 792.0)


@query()
def class_coverage(t):
    """Mean of each share by class."""
    return L.class_areas(_gold(t), _found(t), PAGE).groupBy("what", "gold_label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query()
def trespass_pairs(t):
    """The ten pairs of classes that trespass most often by more than 0.05."""
    a = L.class_areas(_gold(t), _found(t), PAGE).where("what = 'trespass' and value > 0.05")
    return a.groupBy("gold_label", "found_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold_label", "found_label").limit(10)


_ORD = f"{_EL}, o AS (SELECT doc, page, chunk_id, row_number() OVER (PARTITION BY doc, page ORDER BY y0, x0, chunk_id) AS a, row_number() OVER (PARTITION BY doc, page ORDER BY x0, y0, chunk_id) AS b FROM el)"


@query(f"WITH {_ORD}, k AS (SELECT p.doc, p.page, avg(sign(q.b - p.b)) AS tau, count(*) AS n_pairs FROM o p JOIN o q ON p.doc = q.doc AND p.page = q.page AND p.a < q.a GROUP BY ALL), s AS (SELECT doc, page, avg((b > prev)::INT) AS adjacent FROM (SELECT *, lag(b) OVER (PARTITION BY doc, page ORDER BY a) AS prev FROM o) GROUP BY ALL) SELECT s.doc, s.page, round(adjacent, 6) AS adjacent_in_order, round(tau, 6) AS tau, n_pairs FROM s LEFT JOIN k USING (doc, page)")
def reading_order_agreement(t):
    """Order from the top against order from the left."""
    g = _gold(t)
    number = lambda *by: F.row_number().over(W.partitionBy(*PAGE).orderBy(*by))
    o = g.withColumns({"gold_order": number("y0", "x0", "box_id"), "found_order": number("x0", "y0", "box_id")})
    r = L.reading_order(o, PAGE)
    return r.select(*PAGE, F.round("adjacent_in_order", 6).alias("adjacent_in_order"), F.round("tau", 6).alias("tau"), "n_pairs")


@query(f"WITH {_EL} SELECT chunk_id, doc, page, round(y0, 4) AS y0, row_number() OVER (PARTITION BY doc ORDER BY page, y0, x0, chunk_id) AS place FROM el")
def page_order(t):
    """Elements of a document by page and height."""
    w = W.partitionBy("doc").orderBy("page", "y0", "x0", "box_id")
    return _gold(t).select(F.col("box_id").alias("chunk_id"), "doc", "page", F.round("y0", 4).alias("y0"), F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {_EL} SELECT chunk_id, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy, round(x0 + 0.05 * (x1 - x0), 4) AS ex0, round(y1 - 0.05 * (y1 - y0), 4) AS ey1, round(x0 * 2, 4) AS sx0, round(y1 * 3, 4) AS sy1, round(792 - y1, 4) AS fy0, round(792 - y0, 4) AS fy1 FROM el")
def box_transforms(t):
    """Centre, erosion, scaling and flipped axis of each box."""
    b = F.col("bbox")
    e, s, f, c = G.erode(b), G.scale(b, 2.0, 3.0), G.flip_y(b, F.lit(792.0)), G.center(b)
    r = lambda x, n: F.round(x, 4).alias(n)
    return _elements(t).select("chunk_id", r(c["x"], "cx"), r(c["y"], "cy"), r(e["x0"], "ex0"), r(e["y1"], "ey1"), r(s["x0"], "sx0"), r(s["y1"], "sy1"), r(f["y0"], "fy0"), r(f["y1"], "fy1"))


@query(f"WITH {_EL}, p AS (SELECT a.chunk_id AS a_id, b.chunk_id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS dx, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS dy, least(a.x1 - a.x0, b.x1 - b.x0) AS w, (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS hull FROM el a JOIN el b ON a.doc = b.doc AND a.page = b.page AND a.chunk_id < b.chunk_id) SELECT a_id, b_id, coalesce(dx / nullif(w, 0), 0) >= 0.3 AS aligned, round(coalesce(dx * dy / nullif(hull, 0), 0), 6) AS enclosing_iou FROM p")
def box_relations(t):
    """Column alignment and enclosing IoU of the boxes of a page."""
    p = E.page_pairs(_elements(t), PAGE).where("a_id < b_id")
    return p.select("a_id", "b_id", G.is_aligned(F.col("a"), F.col("b")).alias("aligned"), F.round(G.enclosing_iou(F.col("a"), F.col("b")), 6).alias("enclosing_iou"))


@query()
def kept_boxes(t):
    """Greedy suppression; the kept boxes depend on those kept before."""
    g = _gold(t).unionByName(_found(t).drop("score").withColumn("box_id", F.concat("box_id", F.lit("'"))))
    c = g.withColumn("confidence", F.pmod(F.xxhash64("box_id"), F.lit(1000)) / 1000.0)
    return M.deduplicate_boxes(c, PAGE, 0.6).select("box_id", "confidence")


@query(f"WITH {_EL}, o AS (SELECT doc, page, bool_and(y0 >= coalesce(prev, y0)) AS same FROM (SELECT *, lag(y0) OVER (PARTITION BY doc, page ORDER BY seq) AS prev FROM el) GROUP BY ALL), t AS (SELECT el.doc, count(*) AS n_tables, sum((m.table_id IS NOT NULL)::INT)::BIGINT AS matched FROM el LEFT JOIN (SELECT doc_name AS doc, page, min(table_id) AS table_id FROM table_metadata GROUP BY ALL) m USING (doc, page) WHERE type = 'table' GROUP BY el.doc) SELECT o.doc, count(*) AS n_pages, sum(same::INT)::BIGINT AS pages_in_order, coalesce(any_value(n_tables), 0) AS n_tables, coalesce(any_value(matched), 0) AS matched_tables FROM o LEFT JOIN t ON o.doc = t.doc GROUP BY o.doc")
def diagnostics(t):
    """Of each document the pages whose elements stand in order of height, and the tables that a stored table of their page matches."""
    e = _elements(t)
    w = W.partitionBy("doc", "page").orderBy("seq")
    order = e.withColumn("_p", F.lag("bbox.y0").over(w)).groupBy("doc", "page").agg(F.min(F.col("bbox.y0") >= F.coalesce("_p", F.col("bbox.y0"))).alias("same"))
    stored = t("table_metadata").select(F.col("doc_name").alias("doc"), "page", F.lit(1).alias("_m")).distinct()
    tables = e.where("type = 'table'").join(stored, ["doc", "page"], "left").groupBy("doc").agg(F.count(F.lit(1)).alias("n_tables"), F.count("_m").alias("matched_tables"))
    pages = order.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("same").cast("int")).alias("pages_in_order"))
    return pages.join(tables, "doc", "left").select("doc", "n_pages", "pages_in_order", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tables", "matched_tables")])

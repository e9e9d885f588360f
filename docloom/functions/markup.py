"""Tagged blocks, Markdown grids and the marked output of layout models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import col

# The form of a block's tag and of its references.
TAG = r'\[(FIGURE|TABLE|TEXT)[ \t\n]+id="([^"]+)"[ \t\n]+page="([^"]+)"(.*?)\]'
REFERENCE = r'cross_ref_([A-Za-z0-9_]+)="([^"]*)"'
# Page size of the layout model and the form of a box in its output.
MODEL_W, MODEL_H = 1648, 2048
MODEL_BOX = r"(?s)<x_([0-9.]+)><y_([0-9.]+)>(.*?)<x_([0-9.]+)><y_([0-9.]+)><class_([^>]+)>"


def tag(c: Column | str) -> Column:
    """struct of kind, element_id, page and refs (a map from a reference to its ids) of the first tag; null without one."""
    part = lambda k: F.regexp_extract(col(c), TAG, k)
    rest = part(4)
    names, lists = F.regexp_extract_all(rest, F.lit(REFERENCE), 1), F.regexp_extract_all(rest, F.lit(REFERENCE), 2)
    ids = F.transform(lists, lambda s: F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != ""))
    refs = F.map_from_arrays(F.transform(names, lambda n: F.concat(F.lit("cross_ref_"), n)), ids)
    return F.when(part(1) != "", F.struct(part(1).alias("kind"), part(2).alias("element_id"), part(3).alias("page"), refs.alias("refs")))


def tagged_page(elements: DataFrame) -> DataFrame:
    """One text block an element (doc, page, seq, type, body), tagged with its number on the page and the ids of all others.

    ``body`` is the first that there is of row chunks, Markdown, recognised and digital text; elements without one have no block
    but keep their number. Rows: doc, page, seq, element_id, block. The lists of ids are those of a page.
    """
    short = F.when(F.col("type") == "table", "tbl").when(F.col("type") == "figure", "fig").otherwise("txt")
    e = elements.where(F.col("type") != "abandon").withColumn("_k", short)
    number = F.row_number().over(W.partitionBy("doc", "page", "_k").orderBy("seq"))
    e = e.withColumn("_n", number).withColumn("element_id", F.format_string("p%d_%s%d", "page", "_k", "_n"))
    ids = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_n", "element_id")))), lambda x: x["element_id"]), ",").alias(f"_{k}")
    page = e.groupBy("doc", "page").agg(*map(ids, ("tbl", "fig", "txt")))
    kind = F.when(F.col("_k") == "tbl", "TABLE").when(F.col("_k") == "fig", "FIGURE").otherwise("TEXT")
    ref = lambda name, k: F.when(F.col("_k") != k, F.concat(F.lit(f' cross_ref_{name}="'), F.col(f"_{k}"), F.lit('"')))
    head = F.concat(F.lit("["), kind, F.lit(' id="'), "element_id", F.lit('" page="'), F.col("page").cast("string"), F.lit('"'), F.concat_ws("", ref("tables", "tbl"), ref("figures", "fig"), ref("text", "txt")), F.lit("]"))
    mark = F.when(F.col("_k") == "tbl", "\n[TABLE]\n").when(F.col("_k") == "fig", "\n[FIGURE_CAPTION]\n").otherwise("\n")
    return e.join(page, ["doc", "page"]).where(F.trim(F.coalesce("body", F.lit(""))) != "").select("doc", "page", "seq", "element_id", F.concat(head, mark, F.trim("body")).alias("block"))


def markdown_grid(headers: Column, rows: Column) -> Column:
    """headers, a rule and one line a row; without headers the rows alone. Null cells are empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(rows, line)
    return F.array_join(F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.concat(F.array(line(headers), rule), body)).otherwise(body), "\n")


def row_chunk_texts(grid: Column, table_id: Column, section: Column) -> Column:
    """header-anchored texts of the rows of a grid of strings; a grid of fewer than two rows has none. The first cell is the row label."""
    from docloom.operators.tables import row_text

    head = F.transform(F.get(grid, F.lit(0)), lambda h: F.trim(F.coalesce(h, F.lit(""))))
    rows = F.slice(grid, 2, 1_000_000_000)
    return F.when(F.size(grid) >= 2, F.transform(rows, lambda r: row_text(section, table_id, F.get(r, F.lit(0)), head, r))).otherwise(F.array().cast("array<string>"))


def evidence_document(path: Column | str) -> Column:
    """the six or seven digits of a document in an evidence path, before ``_id_`` or as a folder; null without them."""
    some = lambda p: F.nullif(F.regexp_extract(col(path), p, 1), F.lit(""))
    return F.coalesce(some(r"([0-9]{6,7})_id_"), some(r"/([0-9]{6,7})/"))


def evidence_stem(path: Column | str) -> Column:
    """the file name of an evidence path up to its first underscore and first point; null for a path without any of these."""
    name = F.element_at(F.split(col(path), "/"), -1)
    stem = F.split_part(F.split_part(name, F.lit("_"), F.lit(1)), F.lit("."), F.lit(1))
    return F.when(col(path).rlike(r"\.txt|database|_") & (stem != ""), stem)


def model_boxes(c: Column | str, width: Column | float, height: Column | float) -> Column:
    """array of (label, text, x0, y0, x1, y1) in the marked output of a layout model, scaled to the page."""
    part = lambda k: F.regexp_extract_all(col(c), F.lit(MODEL_BOX), k)
    x = lambda v: v.cast("double") / MODEL_W * width
    y = lambda v: v.cast("double") / MODEL_H * height
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t"), part(4).alias("c"), part(5).alias("d"), part(6).alias("k"))
    return F.transform(zipped, lambda z: F.struct(F.lower(z["k"]).alias("label"), F.trim(z["t"]).alias("text"), x(z["a"]).alias("x0"), y(z["b"]).alias("y0"), x(z["c"]).alias("x1"), y(z["d"]).alias("y1")))

"""Benchmark records, spans and detected structures turned into the library's tables; binary files and their models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words and years that make one of the first rows of a grid a part of its header.
HEADER_WORDS = r"(?i)\b(?:201\d|200\d|202\d|thousands|millions|years ended|carrying|fair value)\b"
# Ratios to the body's font size and limits of the layout rules.
TITLE, SECTION, SMALL, SECTION_CHARS, TALL = 1.4, 1.15, 0.8, 200, 5.0


def multimodal_questions(items: DataFrame) -> DataFrame:
    """Question records with a map ``chunk_used`` of (used, metadata) to query rows; the evidence is the first used chunk.

    ``items`` has index, rewritten_question_obscured, complete_answer, question_type, answer_type and
    chunk_used: array of struct(key, used, source) in order.
    """
    used = F.filter("chunk_used", lambda c: c["used"])
    source = F.coalesce(F.get(used, F.lit(0))["source"], F.lit("unidoc_source"))
    return items.select(
        F.format_string("unidoc_qa_%04d", "index").alias("query_id"), F.concat(F.lit("unidoc_"), F.coalesce("question_type", F.lit("unidoc_multimodal"))).alias("query_type"),
        F.coalesce("rewritten_question_obscured", F.lit("")).alias("query"), F.coalesce("complete_answer", F.lit("")).alias("ground_truth_value"),
        F.struct(F.lit("UniDoc Evidence Chunk").alias("row_label"), F.coalesce("answer_type", F.lit("text")).alias("column_label"), source.alias("table_id"), F.concat(F.lit("UniDoc-Bench > "), source).alias("section_path"), F.lit(1).alias("page")).alias("ground_truth_citation"),
    )


def enhanced_grids(df: DataFrame, key: str = "table_id", grid: str = "grid") -> DataFrame:
    """Grids of strings to tables: header rows merged by `` :: ``, rows with nothing but a label become the section of those below.

    The second to fourth row belongs to the header, with all above it, if it names a year or a scale. Columns without a header
    are Col_i. Rows: key, column_headers, rows (row_label, cell_values).
    """
    cells = F.transform(F.col(grid), lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    named = lambda i: F.when((F.size("_g") > i) & F.array_join(F.get("_g", F.lit(i)), " ").rlike(HEADER_WORDS), F.lit(i + 1))
    g = df.select(key, cells.alias("_g")).where(F.size("_g") >= 1).withColumn("_h", F.coalesce(named(3), named(2), named(1), F.lit(1)))
    width = F.array_max(F.transform("_g", lambda r: F.size(r)))
    header = lambda i: F.array_distinct(F.filter(F.transform(F.slice("_g", F.lit(1), F.col("_h")), lambda r: F.coalesce(F.get(r, i), F.lit(""))), lambda x: x != ""))
    named_header = lambda i: F.when(F.size(header(i)) > 0, F.array_join(header(i), " :: ")).otherwise(F.concat(F.lit("Col_"), i.cast("string")))
    headers = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), named_header)).otherwise(F.array().cast("array<string>"))
    out = g.withColumn("column_headers", headers)
    body = F.slice("_g", F.col("_h") + 1, F.greatest(F.lit(1), F.size("_g")))
    label = lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))
    is_section = lambda r: (label(r) != "") & ~F.exists(F.slice(r, 2, 1_000_000_000), lambda c: c != "")
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<row_label:string,cell_values:array<string>>>").alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        named_row = F.struct(F.when(acc["section"] != "", F.concat(acc["section"], F.lit(" :: "), label(r))).otherwise(label(r)).alias("row_label"), r.alias("cell_values"))
        return F.when(is_section(r), F.struct(label(r).alias("section"), acc["rows"].alias("rows"))).otherwise(F.struct(acc["section"].alias("section"), F.concat(acc["rows"], F.array(named_row)).alias("rows")))

    return out.select(key, "column_headers", F.aggregate(body, start, step, lambda acc: acc["rows"]).alias("rows"))


def font_layout(spans: DataFrame) -> DataFrame:
    """Rule layout of blocks from their spans (doc, page, block, size, text, x0, y0, x1, y1): one row a block with its type.

    The body size of a document is the size, to one decimal, of most characters; ties go to the smaller. A block is a footnote if
    its mean size is small, else a caption by its first word, a title or section by its size, abandoned if very tall, else text.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    sizes = spans.where(text != "").groupBy("doc", F.round("size", 1).alias("_size")).agg(F.sum(F.length(text)).alias("_n"))
    body = sizes.groupBy("doc").agg(F.max_by("_size", F.struct("_n", (-F.col("_size")).alias("s"))).alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", F.coalesce("text", F.lit("")).alias("t"))))
    blocks = spans.groupBy("doc", "page", "block").agg(F.avg("size").alias("_avg"), F.trim(F.array_join(F.transform(ordered, lambda o: o["t"]), " ")).alias("text"), *[f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    b = blocks.join(body, "doc", "left").withColumn("_body", F.coalesce("body", F.lit(10.0)))
    low, width = F.lower("text"), F.col("x1") - F.col("x0")
    kind = (
        F.when(F.col("_avg") < SMALL * F.col("_body"), "footnote").when(low.rlike(r"^(?:figure|fig\.|fig )"), "figure_caption").when(low.startswith("table"), "table_caption")
        .when(F.col("_avg") >= TITLE * F.col("_body"), "title").when((F.col("_avg") >= SECTION * F.col("_body")) & (F.length("text") < SECTION_CHARS), "section_header")
        .when((width > 0) & ((F.col("y1") - F.col("y0")) / width > TALL), "abandon").otherwise("plain text")
    )
    return b.select("doc", "page", "block", kind.alias("type"), "text", "x0", "y0", "x1", "y1")


def cell_grid(rows: DataFrame, columns: DataFrame, words: DataFrame) -> DataFrame:
    """(table_id, row_no, col_no, cell): words whose centre lies where a detected row and column of their table meet.

    All three have table_id and x0, y0, x1, y1. Rows and columns of a table meet in a join on the table; empty crossings are
    left out, crossings without a word have an empty cell.
    """
    number = lambda c: F.row_number().over(W.partitionBy("table_id").orderBy(c, "x0", "y0")) - 1
    r = rows.select("table_id", number("y0").alias("row_no"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    c = columns.select("table_id", number("x0").alias("col_no"), *[F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")])
    cells = r.join(c, "table_id").select("table_id", "row_no", "col_no", F.greatest("rx0", "cx0").alias("a0"), F.greatest("ry0", "cy0").alias("b0"), F.least("rx1", "cx1").alias("a1"), F.least("ry1", "cy1").alias("b1")).where("a1 > a0 and b1 > b0")
    w = words.select("table_id", "text", ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"), F.col("x0").alias("_at"))
    in_rows = _holding(w, r, "r", "_y", "ry0", "ry1")
    hit = _holding(in_rows, c, "c", "_x", "cx0", "cx1")
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.col("_y").alias("y"), F.col("_at").alias("x"), F.col("text").alias("t")))))
    texts = hit.groupBy("table_id", "row_no", "col_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("cell"))
    return cells.select("table_id", "row_no", "col_no").join(texts, ["table_id", "row_no", "col_no"], "left").withColumn("cell", F.coalesce("cell", F.lit("")))


def _holding(points: DataFrame, boxes: DataFrame, mark: str, at: str, low: str, high: str) -> DataFrame:
    """Each point (table_id, _x, _y) with every box of its table that holds it; columns of boxes are marked.

    A table may hold a tenth of all words and rows, so both meet by bins of the direction ``at``, as wide as the table has room for each box.
    """
    x0, x1, y0, y1 = (f"{mark}{c}" for c in ("x0", "x1", "y0", "y1"))
    solid = boxes.where((F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0)))
    size = solid.groupBy("table_id").agg(((F.max(high) - F.min(low)) / F.count(F.lit(1))).alias("_bin"))
    number = lambda v: F.floor(F.col(v) / F.col("_bin")).cast("long")
    placed = solid.join(size, "table_id").withColumn("_slot", F.explode(F.sequence(number(low), number(high)))).drop("_bin")
    slots = points.join(size, "table_id").withColumn("_slot", number(at)).drop("_bin")
    held = (F.col("_x") >= F.col(x0)) & (F.col("_x") < F.col(x1)) & (F.col("_y") >= F.col(y0)) & (F.col("_y") < F.col(y1))
    return slots.join(placed, ["table_id", "_slot"]).where(held).drop("_slot", x0, x1, y0, y1)


def check_config(models: list[dict], required: tuple[str, ...] = ("model_key", "model_name", "backend")) -> list[dict]:
    """Model entries of a configuration, once each has its required keys; missing ones are named in the error."""
    for k, entry in enumerate(models):
        missing = [key for key in required if entry.get(key) in (None, "")]
        if missing:
            raise ValueError(f"model {entry.get('model_key', k)}: missing {', '.join(missing)}")
    return models


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """Per-domain JSON files of pages with elements: (domain, page, box_id, label, x0, y0, x1, y1); the domain is the folder's name."""
    element = "struct<label: string, type: string, bbox: array<double>>"
    docs = spark.read.schema(f"pages array<struct<page: int, elements: array<{element}>>>").json(path, multiLine=True)
    named = docs.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("domain"), F.col("_metadata.file_name").alias("file"), F.explode("pages").alias("p"))
    e = named.select("domain", "file", F.col("p.page").alias("page"), F.posexplode("p.elements").alias("k", "e"))
    b = lambda i: F.get("e.bbox", F.lit(i))
    return e.select("domain", "file", "page", F.concat_ws("_", "file", F.col("page").cast("string"), F.col("k").cast("string")).alias("box_id"), F.coalesce("e.label", "e.type").alias("label"), b(0).alias("x0"), b(1).alias("y0"), b(2).alias("x1"), b(3).alias("y1"))


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary files with their path, size and content, one row a file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def extract(files: DataFrame, load: Callable[[], Callable[[bytes], list[tuple]]], schema: str, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Rows that a model finds in each file or image: text blocks, boxes, grids or captions, by ``schema``.

    ``load`` is called once a worker and gives the function from a file's bytes to rows; no model comes with this library. A file on
    which it fails gives one row with its error and no findings, so that the others go on. ``keep`` columns are repeated.
    """
    keep = keep or ["path"]
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = []
            for values in frame[[*keep, content]].itertuples(index=False):
                *own, data = values
                try:
                    rows += [(*own, *found, None) for found in model(bytes(data))]
                except Exception as e:  # noqa: BLE001 - whatever a model raises is the file's outcome
                    rows.append((*own, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*keep, *names, "error"])

    return files.select(*keep, content).mapInPandas(run, f"{kinds}, {schema}, error string")


def hull_of_polygon(points: Column) -> Column:
    """The box of a polygon given as an array of (x, y) arrays."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))

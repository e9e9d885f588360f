"""Readers and writers: element JSON, chunk files, question banks, zones, grids, boxes; JSON, CSV and Markdown sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
ELEMENT = f"struct<type: string, bbox: {BOX}, confidence: double, page: int, content: string, table_markdown: string, image_caption: string, reading_order: int, element_id: string, section_path: array<string>>"
#: Alias keys of custom question files, in the order they are tried.
ALIASES = {"query_id": ["id", "query_id", "uid"], "query": ["query", "question", "q"], "ground_truth": ["ground_truth", "answer", "gold", "expected_answer"], "doc_id": ["doc_id", "document", "doc"]}


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row for each element of the documents; missing keys are null and replacement characters are dropped."""
    docs = spark.read.schema(f"doc_id string, content_hash string, elements array<{ELEMENT}>").json(path, multiLine=True)
    e = docs.select("doc_id", F.posexplode("elements").alias("elem_idx", "e")).select("doc_id", "elem_idx", "e.*")
    return e.withColumn("content", F.replace("content", F.lit("�"), F.lit("")))


def read_chunks(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Chunk records from JSON arrays or lines; the stem is the name of the file they came from."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.json(path, multiLine=multiline).withColumn("doc_stem", stem)


def read_markdown_bank(spark: SparkSession, path: str) -> DataFrame:
    """S3: question rows of Markdown tables with at least ten cells under a second-level heading."""
    text = spark.read.text(path, wholetext=True)
    sections = text.select(F.explode(F.split("value", r"(?m)^## ")).alias("s")).select(F.trim(F.split_part("s", F.lit("\n"), F.lit(1))).alias("doc_stem"), F.explode(F.split("s", "\n")).alias("line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = sections.where(F.trim("line").startswith("|") & ~F.col("line").rlike(r"^[ |:\-]+$")).select("doc_stem", cells.alias("c")).where("size(c) >= 10")
    names = ["question_id", "question", "ground_truth", "evidence", "location_type", "reasoning_type", "answer_format", "difficulty", "adversarial"]
    return rows.select("doc_stem", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(names)])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def zones(df: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Zones with their normalised box as a struct; rows of other statuses are left out if statuses are named."""
    box = F.from_json("bbox_norm", "x double, y double, w double, h double")
    out = df.withColumn("_b", box).withColumn("bbox", F.struct(F.col("_b.x").alias("x0"), F.col("_b.y").alias("y0"), (F.col("_b.x") + F.col("_b.w")).alias("x1"), (F.col("_b.y") + F.col("_b.h")).alias("y1"))).drop("_b")
    return out.where(F.col("gt_text_status").isin(statuses)) if statuses else out


def by_alias(df: DataFrame) -> DataFrame:
    """The columns of ALIASES, each the first that is there and not null; list answers are joined by a comma."""
    have = {c.lower(): c for c in df.columns}

    def one(names: list[str]) -> Column:
        found = [have[n] for n in names if n in have]
        cols = [F.array_join(c, ", ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") for c in found]
        return F.coalesce(*cols) if cols else F.lit(None).cast("string")

    return df.select(*[one(names).alias(n) for n, names in ALIASES.items()])


def grid_to_table(df: DataFrame, key: str = "table_id", grid: str = "grid") -> DataFrame:
    """A grid of strings to column headers (first row) and labelled rows."""
    head = F.slice(F.get(F.col(grid), F.lit(0)), 2, 1_000_000)
    rows = F.transform(F.slice(F.col(grid), 2, 1_000_000), lambda r: F.struct(F.get(r, F.lit(0)).alias("row_label"), F.slice(r, 2, 1_000_000).alias("cell_values")))
    return df.select(key, head.alias("column_headers"), rows.alias("rows"))


def coco_boxes(df: DataFrame) -> DataFrame:
    """Annotations given as parallel arrays (ids, bboxes as x, y, w, h) to one row for each box."""
    z = df.select("image_id", F.posexplode(F.arrays_zip("category_id", "bbox")).alias("pos", "a"))
    b = lambda k: F.get("a.bbox", F.lit(k)).cast("double")
    return z.select("image_id", F.concat_ws("_", "image_id", "pos").alias("box_id"), F.col("a.category_id").alias("label"), b(0).alias("x0"), b(1).alias("y0"), (b(0) + b(2)).alias("x1"), (b(1) + b(3)).alias("y1"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows in the order of a seeded hash, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def token_runs(df: DataFrame) -> DataFrame:
    """Boxes of consecutive tokens with one label (doc, page, pos, label, x0..y1 in thousandths) as shares of the page."""
    from pyspark.sql import Window as W

    from docloom.operators.sequences import islands

    w = W.partitionBy("doc", "page").orderBy("pos")
    runs = islands(df.withColumn("_s", ~F.col("label").eqNullSafe(F.lag("label").over(w))), ["doc", "page"], ["pos"], F.col("_s"), "run")
    return runs.groupBy("doc", "page", "run").agg(F.first("label").alias("label"), *[(f(c) / 1000).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def write_chunks(df: DataFrame, path: str) -> None:
    """JSON lines by strategy."""
    df.write.mode("overwrite").partitionBy("strategy").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S25."""
    df.write.mode("overwrite").csv(path, header=True)


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A leaderboard, small by its nature, as a Markdown table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    rows = df.orderBy(*order).select(line.alias("l")).limit(10_000).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *(r.l for r in rows)])

"""Chunks and elements on pages: cross references, spatial neighbours, context expansion, corpus checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as X


def page_pairs(boxes: DataFrame, page: list[str], key: str = "chunk_id", box: str = "bbox") -> DataFrame:
    """Pairs of different elements of one page: the page is the join key, so that no cross join is needed."""
    a = boxes.select(*page, F.col(key).alias("a_id"), F.col(box).alias("a"))
    b = boxes.select(*page, F.col(key).alias("b_id"), F.col(box).alias("b"))
    return a.join(b, page).where("a_id <> b_id")


def spatial_neighbours(boxes: DataFrame, page: list[str], most_gap: float = 60.0, least_overlap: float = 0.3, k: int = 3) -> DataFrame:
    """J9 without claiming: the k nearest elements within a gap and with horizontal overlap."""
    pairs = page_pairs(boxes, page).withColumn("gap", G.gap(F.col("a"), F.col("b")))
    near = pairs.where((F.col("gap") <= most_gap) & (G.x_overlap(F.col("a"), F.col("b")) >= least_overlap))
    return near.withColumn("n", F.row_number().over(W.partitionBy("a_id").orderBy("gap", "b_id"))).where(F.col("n") <= k).select("a_id", "b_id", "gap", "n")


def nearest(left: DataFrame, right: DataFrame, page: list[str], key: str = "chunk_id", box: str = "bbox") -> DataFrame:
    """For each element of ``left`` the nearest of ``right`` on its page, ties by key."""
    a = left.select(*page, F.col(key).alias("a_id"), F.col(box).alias("a"))
    b = right.select(*page, F.col(key).alias("b_id"), F.col(box).alias("b"))
    return a.join(b, page).groupBy("a_id").agg(F.min_by("b_id", F.struct(G.gap(F.col("a"), F.col("b")), "b_id")).alias("b_id"), F.min(G.gap(F.col("a"), F.col("b"))).alias("gap"))


def citation_edges(texts: DataFrame, tables: DataFrame, key: str = "chunk_id", doc: str = "doc_filename") -> DataFrame:
    """A text that cites tables points to the tables of its document on the same page, or whose text holds the cited name.

    The alternative is a union of two joins, each with its own equality, instead of one join on an OR.
    """
    cited = texts.select(doc, "page", F.col(key).alias("src_id"), F.explode(F.filter(X.citations("text"), lambda c: c.startswith("table:"))).alias("cited"))
    target = tables.select(doc, "page", F.col(key).alias("dst_id"), "text")
    by_page = cited.join(target, [doc, "page"]).select("src_id", "dst_id")
    names = target.select(doc, "dst_id", F.explode(F.filter(X.citations("text"), lambda c: c.startswith("table:"))).alias("cited"))
    by_name = cited.join(names, [doc, "cited"]).select("src_id", "dst_id")
    return by_page.unionByName(by_name).where("src_id <> dst_id").distinct()


def expand_context(seeds: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """Seeds (query_id, item_id, rank) and their one-hop neighbours (src_id, dst_id), seeds first, distinct, at most ``budget`` a query."""
    hops = seeds.join(edges, seeds["item_id"] == edges["src_id"]).select("query_id", F.col("dst_id").alias("item_id"), F.col("rank"), F.lit(1).alias("hop"))
    every = seeds.select("query_id", "item_id", "rank", F.lit(0).alias("hop")).unionByName(hops)
    first = every.groupBy("query_id", "item_id").agg(F.min(F.struct("hop", "rank")).alias("f")).select("query_id", "item_id", "f.hop", "f.rank")
    w = W.partitionBy("query_id").orderBy("hop", "rank", "item_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)


def coverage(chunks: DataFrame, key: str = "chunk_id", doc: str = "doc_filename", indices: str = "source_element_indices") -> DataFrame:
    """For each document the distinct elements covered, those in several chunks, and gaps in the numbering."""
    owned = chunks.select(doc, key, F.explode(indices).alias("e")).groupBy(doc, "e").agg(F.count_distinct(key).alias("n"))
    return owned.groupBy(doc).agg(F.count(F.lit(1)).alias("covered"), F.sum((F.col("n") > 1).cast("long")).alias("duplicated"), (F.max("e") - F.min("e") + 1 - F.count(F.lit(1))).cast("long").alias("missing"))


def checks(chunks: DataFrame) -> DataFrame:
    """Violations (check_name, chunk_id) of the corpus rules, one scan."""
    rules = {
        "empty_text": F.trim(F.coalesce("text", F.lit(""))) == "",
        "no_tokens": F.coalesce("token_count", F.lit(0)) <= 0,
        "no_elements": F.coalesce(F.size("source_element_indices"), F.lit(0)) <= 0,
        "bad_box": ~F.coalesce((F.col("bbox_union.x1") > F.col("bbox_union.x0")) & (F.col("bbox_union.y1") > F.col("bbox_union.y0")), F.lit(False)),
        "page_span": ~F.coalesce(F.array_contains("page_span", F.col("page")), F.lit(False)),
        "bad_char": F.coalesce(F.col("text").contains("�"), F.lit(False)),
    }
    found = F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    return chunks.select("chunk_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("check_name")).distinct()


def element_checks(elements: DataFrame) -> DataFrame:
    """Violations (check_name, doc, element) of the ten rules of an element corpus.

    ``elements`` has doc, elem_idx, element_id, type, page, bbox (struct), reading_order, section_path (array), text, table_markdown, image_path,
    image_caption. Rules of one element are one scan; those of a document or page are aggregations. ``doc`` may be null for none.
    """
    e = elements.withColumn("_e", F.col("elem_idx").cast("string"))
    b, text = F.col("bbox"), F.coalesce("text", F.lit(""))
    rows_of = F.filter(F.split(F.coalesce("table_markdown", F.lit("")), "\n"), lambda line: F.trim(line).startswith("|") & F.trim(line).endswith("|"))
    widths = F.array_distinct(F.transform(rows_of, lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))))
    table, figure = F.col("type") == "table", F.col("type").isin("figure", "image")
    textual = F.col("type").isin("title", "paragraph", "header", "footer", "list_item", "formula")
    missing = F.col("doc").isNull() | F.col("element_id").isNull() | F.col("type").isNull() | F.col("page").isNull() | b.isNull() | F.col("reading_order").isNull() | F.col("section_path").isNull()
    missing = missing | (textual & F.col("text").isNull()) | (table & F.col("table_markdown").isNull()) | (figure & (F.col("image_path").isNull() | F.col("image_caption").isNull()))
    rules = {
        "schema_completeness": missing,
        "type_correctness": (F.col("page") < 1) | (b.isNotNull() & (b["x0"].isNull() | b["y0"].isNull() | b["x1"].isNull() | b["y1"].isNull())),
        "bbox_sanity": (b["x0"] < 0) | (b["y0"] < 0) | (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"]),
        "table_integrity": table & F.col("table_markdown").isNotNull() & (~(F.col("table_markdown").contains("|") | F.col("table_markdown").contains("<table>")) | (F.size(widths) > 1)),
        "figure_integrity": figure & ((F.trim("image_caption") == "") | (F.trim("image_path") == "")),
        "text_quality": text.contains("\ufffd") | text.rlike(r"([^.\-\s])\1{3,}") | text.rlike(r"[\p{L}\p{N}_]-[ \t\n\r\f]+[\p{L}\p{N}_]") | text.rlike(r"[\x{FB01}\x{FB02}\x{FB00}][ \t\n\r\f]+[\p{L}\p{N}_]"),
    }
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    single = e.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("check_name"), "doc", F.col("_e").alias("element"))
    twice = e.where("element_id is not null").groupBy("doc", "element_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("uniqueness").alias("check_name"), "doc", F.col("element_id").alias("element"))
    w = W.partitionBy("doc", "page").orderBy("elem_idx")
    order = e.where("reading_order is not null").withColumn("_back", F.col("reading_order") <= F.lag("reading_order").over(w)).groupBy("doc", "page").agg(F.max("_back").alias("_bad"), (F.count_distinct("reading_order") < F.count(F.lit(1))).alias("_twice"))
    order = order.where("_bad or _twice").select(F.lit("reading_order").alias("check_name"), "doc", F.concat(F.lit("page "), F.col("page").cast("string")).alias("element"))
    mixed = e.where(F.col("type").isin("title", "paragraph") & F.col("section_path").isNotNull()).groupBy("doc", "page").agg(F.max(F.size("section_path")).alias("_most"), F.min(F.size("section_path")).alias("_least"))
    mixed = mixed.where("_most > 0 and _least = 0").select(F.lit("section_path").alias("check_name"), "doc", F.concat(F.lit("page "), F.col("page").cast("string")).alias("element"))
    # documents whose elements fill other fields than most do
    fields = ["element_id", "reading_order", "section_path"]
    keys = e.groupBy("doc").agg(F.concat_ws(",", *[F.when(F.count(c) > 0, F.lit(c)) for c in fields]).alias("_k"))
    usual = keys.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).agg(F.max_by("_k", F.struct("_n", "_k")).alias("_usual"))
    odd = keys.crossJoin(F.broadcast(usual)).where("_k <> _usual").select(F.lit("cross_document").alias("check_name"), "doc", F.lit("document").alias("element"))  # one row
    return single.unionByName(twice).unionByName(order).unionByName(mixed).unionByName(odd).distinct()

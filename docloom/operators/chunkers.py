"""Chunking strategies over ordered elements (doc, page, seq, type, text); the registry maps names to functions.

All are expressions and windows keyed by page or section. Text order is the element order; empty elements are kept out of
texts but counted as covered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import sequences as S

# Element types that stand alone and those that open a section.
ATOMIC = ["table", "figure", "formula", "caption"]
HEADERS = ["title", "section_header"]


def _grouped(df: DataFrame, group: list[str], name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "text", "type")))
    out = df.groupBy(*group).agg(parts.alias("_p"), F.min("seq").alias("_first"))
    rank = F.row_number().over(W.partitionBy("doc", "page").orderBy("_first")) - 1
    return out.select(
        X.chunk_name(F.col("doc"), F.lit(name), F.col("page"), rank).alias("chunk_id"), "doc", "page", F.lit(name).alias("strategy"),
        F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("text"), F.transform("_p", lambda p: p["seq"]).alias("source_element_indices"), F.array_distinct(F.transform("_p", lambda p: p["type"])).alias("element_types"),
    )


def element_atomic(elements: DataFrame, floor: int = 100) -> DataFrame:
    """Atomic types alone; other elements of the same type in a row are merged while they are under ``floor`` words."""
    w = W.partitionBy("doc", "page").orderBy("seq")
    e = elements.withColumn("_n", X.token_count("text"))
    start = F.col("type").isin(ATOMIC) | ~F.col("type").eqNullSafe(F.lag("type").over(w)) | (F.col("_n") >= floor) | (F.lag("_n").over(w) >= floor)
    e = e.withColumn("_s", start)
    return _grouped(S.islands(e, ["doc", "page"], ["seq"], F.col("_s"), "_g"), ["doc", "page", "_g"], "element_atomic")


ANCHORS = ["table", "figure", "formula"]


def aligned_headers(elements: DataFrame) -> DataFrame:
    """(doc, page, seq, aligned): for each table and figure the text of the nearest title or figure caption of its page that ends above
    its top (15 points below at most); ties go to the first. Elements have a bbox.
    """
    heads = elements.where(F.col("type").isin(*HEADERS, "figure_caption")).select("doc", "page", F.col("seq").alias("_hs"), F.col("text").alias("_ht"), F.col("bbox.y1").alias("_y1"))
    anchors = elements.where(F.col("type").isin("table", "figure")).select("doc", "page", "seq", F.col("bbox.y0").alias("_y0"))
    above = anchors.join(heads, ["doc", "page"]).where("_y1 <= _y0 + 15 and trim(_ht) <> ''")
    return above.groupBy("doc", "page", "seq").agg(F.min_by("_ht", F.struct(F.col("_y0") - F.col("_y1"), "_hs")).alias("aligned"))


def section_hierarchical(elements: DataFrame, budget: int = 800) -> DataFrame:
    """Sections that a header opens, their texts packed under ``budget`` words, atomic types alone. Each chunk starts with its header.

    The header is carried over pages; a table or figure takes the header that stands over it, if elements have boxes. A caption tells
    what it belongs to (``caption_for``): the last table, figure or formula before it on its page and in its section.
    """
    e = elements.withColumn("_h", F.when(F.col("type").isin(HEADERS), F.col("text")))
    e = S.carry_over_pages(e, ["doc"], "page", ["seq"], "_h", "_header").withColumn("_header", F.coalesce("_header", F.lit("")))
    atomic = F.col("type").isin(ATOMIC + ["figure_caption", "table_caption"])
    w = W.partitionBy("doc", "page").orderBy("seq")
    e = e.withColumn("_s", F.col("type").isin(HEADERS) | atomic | F.coalesce(F.lag(atomic).over(w), F.lit(False)))
    e = S.islands(e, ["doc", "page"], ["seq"], F.col("_s"), "_sec").withColumn("_open", F.sum(F.col("type").isin(HEADERS).cast("int")).over(w))
    inside = W.partitionBy("doc", "page", "_open").orderBy("seq")
    last = F.last(F.when(F.col("type").isin(ANCHORS), F.col("type")), ignorenulls=True).over(inside)
    e = e.withColumn("caption_for", F.when(F.col("type").isin("caption", "figure_caption", "table_caption"), last))
    if "bbox" in elements.columns:
        e = e.join(aligned_headers(elements), ["doc", "page", "seq"], "left").withColumn("_header", F.coalesce("aligned", "_header")).drop("aligned")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"), "type", X.token_count("text").cast("long").alias("n"), "_header", "caption_for")))
    sections = e.groupBy("doc", "page", "_sec").agg(parts.alias("_p")).withColumn("_k", S.pack(F.transform("_p", lambda p: p["n"]), budget))
    rows = sections.select("doc", "page", "_sec", F.explode(F.arrays_zip("_p", "_k")).alias("z")).select("doc", "page", "_sec", F.col("z._k").alias("_k"), "z._p.*")
    out = rows.groupBy("doc", "page", "_sec", "_k").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "type"))).alias("_p"), F.max("_header").alias("parent_section"), F.max("caption_for").alias("caption_for"), F.min("seq").alias("_first"))
    body = F.array_join(F.transform("_p", lambda p: F.when(p["type"] == "figure", F.concat(F.lit("[FIGURE] "), p["text"])).otherwise(p["text"])), "\n\n")
    rank = F.row_number().over(W.partitionBy("doc", "page").orderBy("_first")) - 1
    headed = (F.col("parent_section") == "") | F.startswith(body, F.col("parent_section")) | F.col("caption_for").isNotNull()
    return out.select(
        X.chunk_name(F.col("doc"), F.lit("section_hierarchical"), F.col("page"), rank).alias("chunk_id"), "doc", "page", F.lit("section_hierarchical").alias("strategy"),
        F.when(headed, body).otherwise(F.concat_ws("\n\n", F.col("parent_section"), body)).alias("text"), "parent_section", "caption_for", F.transform("_p", lambda p: p["seq"]).alias("source_element_indices"), F.array_distinct(F.transform("_p", lambda p: p["type"])).alias("element_types"),
    )


def naive_baseline(elements: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows over the words of a page, each with the elements that its words come from."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r\f]+"), lambda x: x != "")
    pages = elements.select("doc", "page", "seq", F.transform(words, lambda x: F.struct(F.col("seq").alias("s"), x.alias("w"))).alias("_w")).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "_w"))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda p: p["_w"]))
    starts = S.token_windows(F.transform(F.sequence(F.lit(1), F.size("_f")), lambda i: i.cast("string")), size, overlap)
    win = pages.withColumn("_f", flat).where(F.size("_f") > 0).select("doc", "page", "_f", F.posexplode(starts).alias("n", "_at"))
    win = win.withColumn("_s", F.slice("_f", F.element_at("_at", 1).cast("int"), F.size("_at")))
    return win.select(
        X.chunk_name(F.col("doc"), F.lit("naive_baseline"), F.col("page"), F.col("n")).alias("chunk_id"), "doc", "page", F.lit("naive_baseline").alias("strategy"),
        F.array_join(F.transform("_s", lambda x: x["w"]), " ").alias("text"), F.array_distinct(F.transform("_s", lambda x: x["s"])).alias("source_element_indices"),
    )


def tagged_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2000) -> DataFrame:
    """Blocks between blank lines packed under a number of characters; blocks tagged as table or figure stand alone, with the
    references of their tag. Each chunk points to the one before and, but for the last, to the next.
    """
    from docloom.functions.markup import tag

    blocks = F.filter(F.transform(F.split(F.col(text), "\n\n"), lambda b: F.trim(b, F.lit(" \t\n\r"))), lambda b: b != "")
    kinds = F.transform("_b", lambda b: F.when(b.contains("[TABLE]") | b.rlike(r'\[TABLE\s+id="'), "table").when(b.contains("[FIGURE"), "figure").otherwise("text"))
    cut = docs.select(F.col(key).alias("doc"), blocks.alias("_b")).where(F.size("_b") > 0).withColumn("_t", kinds)
    sized = F.zip_with("_b", "_t", lambda b, k: F.struct(F.length(b).cast("long").alias("n"), (k != "text").alias("alone")))
    packed = cut.withColumn("_k", S.pack_alone(sized, budget))
    rows = packed.select("doc", F.posexplode(F.arrays_zip("_b", "_t", "_k")).alias("pos", "z")).select("doc", "pos", F.col("z._b").alias("b"), F.col("z._t").alias("t"), F.col("z._k").alias("seq"))
    chunks = rows.groupBy("doc", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda p: p["b"]), "\n\n").alias("text"), F.max("t").alias("_kind"), F.min_by("t", "pos").alias("element_type"), F.count_if(F.lit(True)).alias("n_blocks"))
    chunks = chunks.drop("_kind").withColumn("cross_references", F.when(F.col("element_type") != "text", tag("text")["refs"]))
    # packs are numbered without a gap
    last = chunks.groupBy("doc").agg(F.max("seq").alias("_last"))
    return chunks.join(last, "doc").withColumns({"prev_seq": F.when(F.col("seq") > 0, F.col("seq") - 1), "next_seq": F.when(F.col("seq") < F.col("_last"), F.col("seq") + 1)}).drop("_last")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"naive_baseline": naive_baseline, "element_atomic": element_atomic, "section_hierarchical": section_hierarchical}


def chunker(name: str) -> Callable[..., DataFrame]:
    """A strategy, elements to chunks, by name; an unknown name gives the semantic mesh."""
    from docloom.operators import mesh

    return {**mesh.STRATEGIES, **STRATEGIES}.get(name, mesh.semantic_mesh)


def elements_of(chunks: DataFrame) -> DataFrame:
    """Chunks read as elements of their pages, in the order of their ids."""
    kind: Column = F.coalesce(F.get(F.col("element_types"), F.lit(0)), F.lit("text"))
    seq = F.row_number().over(W.partitionBy("doc_filename", "page").orderBy("chunk_id"))
    once = chunks.dropDuplicates(["chunk_id"]).where("page is not null and doc_filename is not null and text is not null")
    return once.select(F.col("doc_filename").alias("doc"), "page", seq.alias("seq"), kind.alias("type"), "text")

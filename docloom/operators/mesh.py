"""Chunkers that need boxes, vectors or links: geometric grounding, semantic flushes, the semantic mesh.

Elements are (doc, page, seq, type, text, bbox, and for the semantic chunker vector). A grouped map only sees one page or one
section of a page; everything that runs through a document is carried from page to page on one row a page.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as X
from docloom.operators import sequences as S
from docloom.operators.tables import row_text

# Element types by what a chunker does with them.
TABLES, FIGURES, FORMULAS = ["table"], ["figure"], ["formula", "isolate_formula"]
CAPTIONS = ["caption", "figure_caption", "table_caption", "table_footnote", "formula_caption"]
HEADERS = ["title", "section_header"]
TEXT_LIKE = ["text", "plain text", "paragraph", "list_item"]
IGNORED = ["abandon", "header", "footer", "page_number"]


def boxed_elements(chunks: DataFrame) -> DataFrame:
    """Chunks read as elements with boxes, in the order of their ids on a page; rows without page, file, text or box are left out."""
    once = chunks.where("page is not null and doc_filename is not null and text is not null and bbox_union is not null").groupBy("chunk_id").agg(
        F.min(F.struct("doc_filename", "page", F.coalesce(F.get("element_types", F.lit(0)), F.lit("text")).alias("type"), "text", "bbox_union")).alias("e")
    )
    seq = F.row_number().over(W.partitionBy("doc", "page").orderBy("chunk_id"))
    rows = once.select(F.col("e.doc_filename").alias("doc"), "e.page", "chunk_id", "e.type", "e.text", F.col("e.bbox_union").alias("bbox"))
    return rows.select("doc", "page", seq.alias("seq"), "type", "text", "bbox", "chunk_id")


# ---- geometric grounding --------------------------------------------------------------------------------------------


def claim(anchors: np.ndarray, others: np.ndarray, free: list[bool], most_gap: float, least_overlap: float, k: int) -> list[list[int]]:
    """Each anchor in turn takes up to ``k`` of the free boxes near and below or above it, the nearest first."""
    taken, out = [not f for f in free], []
    for a in anchors:
        dx = np.maximum(0, np.maximum(a[0] - others[:, 2], others[:, 0] - a[2])) if len(others) else np.zeros(0)
        dy = np.maximum(0, np.maximum(a[1] - others[:, 3], others[:, 1] - a[3])) if len(others) else np.zeros(0)
        gap = np.sqrt(dx * dx + dy * dy)
        both = np.maximum(0, np.minimum(a[2], others[:, 2]) - np.maximum(a[0], others[:, 0])) if len(others) else np.zeros(0)
        narrow = np.minimum(a[2] - a[0], others[:, 2] - others[:, 0]) if len(others) else np.zeros(0)
        share = np.divide(both, narrow, out=np.zeros_like(both), where=narrow > 0)
        near = [i for i in np.argsort(gap, kind="stable") if not taken[i] and gap[i] <= most_gap and share[i] >= least_overlap][:k]
        for i in near:
            taken[i] = True
        out.append([int(i) for i in near])
    return out


def claimed(elements: DataFrame, most_gap: float = 60.0, least_overlap: float = 0.3, k: int = 3) -> DataFrame:
    """(doc, page, seq, anchor, nearness from 0) of the text elements that a table or figure of their page claims; a page is one group."""
    flat = elements.select("doc", "page", "seq", "type", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq")
        anchors, others = page[page["type"].isin(TABLES + FIGURES)], page[page["type"].isin(TEXT_LIKE)]
        box = ["x0", "y0", "x1", "y1"]
        groups = claim(anchors[box].to_numpy(float), others[box].to_numpy(float), [True] * len(others), most_gap, least_overlap, k)
        seqs = others["seq"].to_numpy()
        rows = [(page["doc"].iloc[0], page["page"].iloc[0], seqs[i], a, n) for a, group in zip(anchors["seq"], groups) for n, i in enumerate(group)]
        return pd.DataFrame(rows, columns=["doc", "page", "seq", "anchor", "nearness"])

    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    return flat.where(F.col("type").isin(TABLES + FIGURES + TEXT_LIKE)).groupBy("doc", "page").applyInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, seq {kinds['seq']}, anchor {kinds['seq']}, nearness int")


def _chunks(parts: DataFrame, group: list[str], name: str, sep: str = "\n\n") -> DataFrame:
    """One row a group of (doc, page, seq, type, text, bbox, place): texts in order of place, hull of the boxes, elements covered."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "seq", "text", "type")))
    hull = F.struct(*[f(f"bbox.{c}").alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])
    out = parts.groupBy(*group).agg(ordered.alias("_p"), hull.alias("bbox_union"))
    return out.select(*group, "bbox_union", F.lit(name).alias("strategy"), F.array_join(F.filter(F.transform("_p", lambda p: p["text"]), lambda t: t != ""), sep).alias("text"), F.transform("_p", lambda p: p["type"]).alias("element_types"), F.transform("_p", lambda p: p["seq"]).alias("source_element_indices"))


def _numbered(chunks: DataFrame, order: list[Column], name: str) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("doc", "page").orderBy(*order)) - 1
    stem = F.regexp_replace("doc", r"\.[^.]*$", "")
    return chunks.withColumn("chunk_id", X.chunk_name(stem, F.lit(name), F.col("page"), seq))


def geometric_grounding(elements: DataFrame, most_gap: float = 60.0, floor: int = 100) -> DataFrame:
    """Tables and figures with the texts they claim; other elements merged with the one before of their type while
    under ``floor`` words; ignored elements covered by the nearest chunk of their page. Anchors come first on a page.
    """
    e = elements.where(~F.col("type").isin(IGNORED)).join(claimed(elements, most_gap), ["doc", "page", "seq"], "left")
    is_anchor = F.col("type").isin(TABLES + FIGURES)
    text = F.when(F.col("type").isin(FIGURES), F.concat(F.lit("[FIGURE] "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    e = e.withColumn("anchor", F.when(is_anchor, F.col("seq")).otherwise(F.col("anchor"))).withColumn("text", text)
    left = e.where("anchor is null")
    w = W.partitionBy("doc", "page").orderBy("seq")
    joins = F.col("type").isin(TEXT_LIKE + HEADERS) & (F.lag("type").over(w) == F.col("type")) & (X.token_count("text") < floor)
    left = S.islands(left.withColumn("_start", ~F.coalesce(joins, F.lit(False))), ["doc", "page"], ["seq"], F.col("_start"), "_run").drop("_start")
    grounded = e.where("anchor is not null").withColumn("_run", F.lit(None).cast("long"))
    parts = grounded.unionByName(left.withColumn("_run", F.col("_run").cast("long"))).withColumn("place", F.struct((~is_anchor).alias("a"), F.coalesce("nearness", F.lit(0)).alias("n"), F.col("seq").alias("s")))
    chunks = _numbered(_chunks(parts, ["doc", "page", "anchor", "_run"], "geometric_grounding"), [F.asc_nulls_last("anchor"), F.col("_run")], "geometric_grounding")
    near = nearest_chunk(elements.where(F.col("type").isin(IGNORED)), chunks)
    return chunks.join(near, "chunk_id", "left").withColumn("source_element_indices", F.concat("source_element_indices", F.coalesce("_more", F.array().cast("array<int>")))).drop("anchor", "_run", "_more")


def nearest_chunk(ignored: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, _more): the ignored elements of a page by the nearest of its chunks, ties by id."""
    pairs = ignored.select("doc", "page", "seq", F.col("bbox").alias("_b")).join(chunks.select("doc", "page", "chunk_id", "bbox_union"), ["doc", "page"])
    best = pairs.groupBy("doc", "page", "seq").agg(F.min_by("chunk_id", F.struct(G.gap(F.col("_b"), F.col("bbox_union")), "chunk_id")).alias("chunk_id"))
    return best.groupBy("chunk_id").agg(F.array_sort(F.collect_list("seq")).alias("_more"))


# ---- semantic flushes -----------------------------------------------------------------------------------------------


def flushes(sizes: list[int], vectors: list, most: int, least_similarity: float, least_tokens: int) -> tuple[list[int], list[str]]:
    """Group of each text and what closed it: ``tokens`` where the next would take it over ``most``, ``semantic`` where the
    cosine of neighbours falls under the threshold once the group has ``least_tokens``, ``end`` for the last.
    """
    groups, causes, used, last = [], [], 0, None
    for n, v in zip(sizes, vectors):
        cause = None
        if groups and used:
            if used + n > most:
                cause = "tokens"
            elif used >= least_tokens and last is not None and v is not None:
                norm = float(np.linalg.norm(last) * np.linalg.norm(v))
                if (float(np.dot(last, v)) / norm if norm else 0.0) < least_similarity:
                    cause = "semantic"
        if cause:
            causes.append(cause)
            used = 0
        groups.append(len(causes))
        used += n
        last = v
    return groups, [*causes, "end"] if groups else []


def hybrid_semantic(elements: DataFrame, most: int = 800, least_similarity: float = 0.5, least_tokens: int = 80) -> DataFrame:
    """Sections that a header opens; atomic types alone; texts grouped by ``flushes``. ``vector`` is the embedding of a text.

    The chunk of a section starts with its header, carried over pages; ``closed_by`` tells what ended a chunk.
    """
    e = S.carry_over_pages(elements.withColumn("_h", F.when(F.col("type").isin(HEADERS), F.col("text"))), ["doc"], "page", ["seq"], "_h", "header")
    atomic = F.col("type").isin(TABLES + FIGURES + FORMULAS + CAPTIONS)
    w = W.partitionBy("doc", "page").orderBy("seq")
    start = F.col("type").isin(HEADERS) | atomic | F.coalesce(F.lag(atomic).over(w), F.lit(True))
    runs = S.islands(e.withColumn("_start", start), ["doc", "page"], ["seq"], F.col("_start"), "_run").withColumn("_n", X.token_count("text"))
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        groups, causes = flushes(part["_n"].tolist(), [None if v is None else np.asarray(v, float) for v in part["vector"]], most, least_similarity, least_tokens)
        return pd.DataFrame({"doc": part["doc"], "page": part["page"], "seq": part["seq"], "_group": groups, "closed_by": [causes[g] for g in groups]})

    grouped = runs.groupBy("doc", "page", "_run").applyInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, seq {kinds['seq']}, _group int, closed_by string")
    parts = runs.join(grouped, ["doc", "page", "seq"]).withColumn("place", F.col("seq"))
    parts = parts.withColumn("text", F.when(F.col("type").isin(FIGURES), F.concat(F.lit("[FIGURE] "), "text")).otherwise(F.col("text"))).withColumn("header", F.coalesce("header", F.lit("")))
    chunks = _chunks(parts, ["doc", "page", "_run", "_group", "header", "closed_by"], "hybrid_semantic")
    named = _numbered(chunks, [F.col("_run"), F.col("_group")], "hybrid_semantic")
    has_head = (F.col("header") == "") | F.startswith("text", "header") | F.exists("element_types", lambda x: x.isin(TABLES + FIGURES + FORMULAS + CAPTIONS))
    return named.withColumn("text", F.when(has_head, F.col("text")).otherwise(F.concat_ws("\n\n", "header", "text"))).drop("_run", "_group")


# ---- semantic mesh --------------------------------------------------------------------------------------------------


def semantic_mesh(elements: DataFrame, least: int = 400, most: int = 750, atomic_rows: int = 35) -> DataFrame:
    """Tables up to ``atomic_rows`` rows alone, larger ones as a parent and a chunk for each row; figures, formulas and captions
    alone; other texts under one header packed between ``least`` and ``most`` words, over page ends too.

    Columns: chunk_id, doc, page, source, header, text, page_span, source_element_indices, context_group, sequence_in_group,
    prev_id, next_id. Links between chunks are made by ``operators.elements``.
    """
    e = elements.where(~F.col("type").isin(IGNORED)).withColumn("_h", F.when(F.col("type").isin(HEADERS + ["figure_caption", "table_caption"]) & (F.trim("text") != ""), F.trim("text")))
    e = S.carry_over_pages(e, ["doc"], "page", ["seq"], "_h", "header").withColumn("header", F.coalesce("header", F.lit("Document General Context"))).drop("_h")
    table, alone = F.col("type").isin(TABLES), F.col("type").isin(FIGURES + FORMULAS + CAPTIONS)
    stem = F.regexp_replace("doc", r"\.[^.]*$", "")
    base = X.chunk_name(stem, F.lit("semantic_mesh"), F.col("page"), F.col("seq"))
    rows = X.markdown_rows("text")
    t = e.where(table).withColumn("_rows", rows).withColumn("_n", F.size("_rows")).withColumn("chunk_id", base)
    none = F.lit(None).cast("string")
    line = lambda df, source, text: df.select("chunk_id", "doc", "page", F.lit(source).alias("source"), "header", text.alias("text"), F.array("page").alias("page_span"), F.array("seq").alias("source_element_indices"), none.alias("context_group"), F.lit(1).alias("sequence_in_group"), none.alias("prev_id"), none.alias("next_id"))
    small = line(t.where(F.col("_n") <= atomic_rows), "table_atomic", F.concat_ws("\n\n", "header", "text"))
    large = t.where(F.col("_n") > atomic_rows).withColumn("_head", F.get("_rows", F.lit(0)))
    parent = line(large.withColumn("chunk_id", F.concat("chunk_id", F.lit("::parent"))), "table_parent", F.concat(F.lit("Table: "), F.col("header"), F.lit(" | Columns: "), F.array_join("_head", ", "), F.lit(" | Rows: "), (F.col("_n") - 1).cast("string")))
    data = large.select("*", F.posexplode(F.slice("_rows", 2, 1_000_000_000)).alias("_k", "_cells")).withColumn("_table", F.col("chunk_id"))
    data = data.withColumn("chunk_id", F.format_string("%s_row_%d", "_table", "_k"))
    by_row = line(data, "table_row", row_text(F.col("header"), F.col("_table"), F.get("_cells", F.lit(0)), F.col("_head"), F.col("_cells")))
    at = lambda i: F.when((i >= 0) & (i < F.col("_n") - 1), F.format_string("%s_row_%d", "_table", i))
    pointers = data.select("chunk_id", F.col("_table").alias("_g"), (F.col("_k") + 1).alias("_s"), at(F.col("_k") - 1).alias("_a"), at(F.col("_k") + 1).alias("_b"))
    by_row = by_row.drop("context_group", "sequence_in_group", "prev_id", "next_id").join(pointers, "chunk_id").withColumnsRenamed({"_g": "context_group", "_s": "sequence_in_group", "_a": "prev_id", "_b": "next_id"})
    figure = F.when(F.col("type").isin(FIGURES), F.concat(F.col("header"), F.lit("\n\n[FIGURE] "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    single = line(e.where(alone).withColumn("chunk_id", base), "atomic", figure)
    return small.unionByName(parent).unionByName(by_row).unionByName(single).unionByName(_text_clusters(e, least, most, stem))


def _text_clusters(e: DataFrame, least: int, most: int, stem: Column) -> DataFrame:
    broken = F.col("type").isin(TABLES + FIGURES + FORMULAS + CAPTIONS)
    e = S.previous_over_pages(e, ["doc"], "page", ["seq"], F.struct(broken.alias("b"), F.col("header").alias("h")), "_before")
    start = F.coalesce(F.col("_before.b") | (F.col("_before.h") != F.col("header")), F.lit(True))
    texts = e.where(~broken).withColumn("_start", F.when(start, F.struct("page", "seq")))
    texts = S.carry_over_pages(texts, ["doc"], "page", ["seq"], "_start", "_cluster").withColumn("_n", X.token_count("text"))
    # sizes only are folded; a cluster is what stands between two headers or atomic elements
    sizes = texts.groupBy("doc", "_cluster").agg(F.array_sort(F.collect_list(F.struct("page", "seq", F.col("_n").cast("long").alias("n")))).alias("_p"))
    packs = sizes.select("doc", "_cluster", F.explode(F.arrays_zip("_p", S.pack_between(F.transform("_p", lambda p: p["n"]), least, most).alias("_k"))).alias("z")).select("doc", "_cluster", F.col("z._p.page").alias("page"), F.col("z._p.seq").alias("seq"), F.col("z._k").alias("_pack"))
    placed = texts.join(packs, ["doc", "_cluster", "page", "seq"])
    ordered = F.array_sort(F.collect_list(F.struct("page", "seq", F.trim("text").alias("text"))))
    g = placed.groupBy("doc", "_cluster", "_pack", "header").agg(ordered.alias("_p"))
    body = F.array_join(F.filter(F.transform("_p", lambda p: p["text"]), lambda x: x != ""), "\n\n")
    body = F.regexp_replace(body, r"([\p{L}\p{N}_]+)-[ \t]*\n\n[ \t\n]*([\p{L}\p{N}_]+)", "$1$2")
    group = F.format_string("%s_%s_%d_%d", stem, X.section_slug("header"), F.col("_cluster.page"), F.col("_cluster.seq"))
    first = F.get("_p", F.lit(0))
    g = g.select(
        X.chunk_name(stem, F.lit("semantic_mesh"), first["page"], first["seq"]).alias("chunk_id"), "doc", first["page"].alias("page"), F.lit("text").alias("source"), "header",
        F.when(body == F.col("header"), body).otherwise(F.concat_ws("\n\n", F.col("header"), body)).alias("text"), F.array_distinct(F.transform("_p", lambda p: p["page"])).alias("page_span"), F.transform("_p", lambda p: p["seq"]).alias("source_element_indices"),
        group.alias("context_group"), (F.col("_pack") + 1).alias("sequence_in_group"),
    )
    w = W.partitionBy("context_group").orderBy("sequence_in_group")
    return g.withColumns({"prev_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"geometric_grounding": geometric_grounding, "hybrid_semantic": hybrid_semantic, "semantic_mesh": semantic_mesh}

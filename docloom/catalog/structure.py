"""Chunkers and table metrics over chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import Catalog
from docloom.catalog.texts import WORDS_SQL
from docloom.operators import chunkers as C
from docloom.operators import grids as G
from docloom.operators import mesh as M

query = Catalog()


@query()
def chunk_atomic(t):
    return C.element_atomic(C.elements_of(t("chunks"))).select("chunk_id", "page", F.length("text").alias("n_chars"), F.size("source_element_indices").alias("n_elements"))


@query()
def chunk_sections(t):
    """C3."""
    return C.section_hierarchical(M.boxed_elements(t("chunks"))).select("chunk_id", "page", "parent_section", F.length("text").alias("n_chars"), F.size("source_element_indices").alias("n_elements"))


_NAIVE = f"w AS (SELECT doc_filename AS doc, page, flatten(list({WORDS_SQL.replace('{c}', 'text')} ORDER BY chunk_id)) AS w FROM (SELECT DISTINCT chunk_id, doc_filename, page, text FROM chunks WHERE page IS NOT NULL AND doc_filename IS NOT NULL AND text IS NOT NULL) GROUP BY ALL), n AS (SELECT *, unnest(range(CASE WHEN len(w) <= 128 THEN 1 ELSE (ceil((len(w) - 128) / 112.0) + 1)::BIGINT END)) AS n FROM w WHERE len(w) > 0)"


@query(f"WITH {_NAIVE} SELECT doc || '_naive_baseline_' || page || '_' || lpad(n::VARCHAR, 4, '0') AS chunk_id, page, length(array_to_string(w[n * 112 + 1:n * 112 + 128], ' ')) AS n_chars FROM n")
def chunk_naive(t):
    return C.naive_baseline(C.elements_of(t("chunks")), 128, 16).select("chunk_id", "page", F.length("text").alias("n_chars"))


@query()
def chunk_tagged(t):
    return C.tagged_blocks(t("documents")).select("doc", "seq", F.length("text").alias("n_chars"), "next_seq")


@query()
def table_structure_scores(t):
    """HTML tables of chunks against themselves without their last row."""
    html = t("chunks").where("text like '<table%'").select("chunk_id", "text").dropDuplicates()
    less = F.regexp_replace("text", r"(?s)<tr>(?:(?!<tr>).)*</tr>\s*(?:</table>)?\s*$", "</table>")
    return html.select("chunk_id", G.table_scores(F.col("text"), less).alias("s")).select("chunk_id", "s.*")


def _elements(t):
    from docloom.functions import text as X
    from docloom.functions import vectors as V

    e = M.boxed_elements(t("chunks"))
    return e.withColumn("vector", V.hashed_embedding(X.entity_tokens("text")))


@query()
def chunk_geometric(t):
    """C4, J9, W11, J10; claims depend on earlier ones."""
    c = M.geometric_grounding(_elements(t))
    return c.select("chunk_id", "page", F.length("text").alias("n_chars"), "source_element_indices")


@query()
def chunk_hybrid(t):
    """C5, W15."""
    c = M.hybrid_semantic(_elements(t), most=400, least_similarity=0.3)
    return c.select("chunk_id", "page", "closed_by", F.length("text").alias("n_chars"), "source_element_indices")


@query()
def chunk_mesh(t):
    """C6, W13."""
    return M.semantic_mesh(_elements(t), 200, 400, 8).select("chunk_id", "page", "source", F.length("text").alias("n_chars"), "page_span", "source_element_indices", "sequence_in_group", "prev_id", "next_id")


@query()
def table_cell_scores(t):
    """As above, by the texts of aligned cells."""
    html = t("chunks").where("text like '<table%'").select("chunk_id", "text").dropDuplicates()
    less = F.regexp_replace("text", r"(?s)<tr>(?:(?!<tr>).)*</tr>\s*(?:</table>)?\s*$", "</table>")
    return html.select("chunk_id", G.aligned_cells(F.col("text"), less).alias("s")).select("chunk_id", "s.*")

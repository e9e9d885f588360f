"""Queries of the training-data operators; each takes (spark, folder) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import leaks, mixing, pairs, quality, scans, sentences, splitting
from docloom.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, folder, "predictions"), table(spark, folder, "documents")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    items = scans.scan_items(table(spark, folder, "documents"), table(spark, folder, "medcore_text_gt_flat"))
    return scans.find_noise(items, scans.Models(items))


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    items = scans.scan_items(table(spark, folder, "documents"), table(spark, folder, "medcore_text_gt_flat"))
    return scans.repair(items, scans.Models(items))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks")).select("chunk_id", "boundary").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = quality.fit_profiles(docs, F.col("source").isin("manual", "report", "notice"))
    one = quality.text_quality(docs.select(F.col("doc_id").cast("string").alias("item_key"), "text"), profiles, "item_key")
    two = quality.text_quality(table(spark, folder, "chunks").select(F.col("chunk_id").alias("item_key"), "text"), profiles, "item_key")
    return one.withColumn("table_name", F.lit("documents")).unionByName(two.withColumn("table_name", F.lit("chunks")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).where("kind <> 'prose'").select("table_name", "item_key", "kind").distinct()


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    near = leaks.leaked_windows(table(spark, folder, "documents"), table(spark, folder, "qa_bank"))
    return near.where("edits = 0").select("doc_id", "question_id").distinct()


def p6_touched_documents(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.touched_documents(leaks.leaked_windows(table(spark, folder, "documents"), table(spark, folder, "qa_bank")))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    asked = docs.where(F.col("source").isin("manual", "report", "notice", "standards"))
    return sentences.sentence_units(asked, known=sentences.fit_statistics(docs))


def p8_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units of every text in documents, whatever its source."""
    return sentences.sentence_units(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_repaired, p3_found, p3_pieces, p5_found, p5_statistics, p6_found, p6_touched_documents, p7_mixture, p7_shares, p8_found, p8_units)}
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]"
_SIGN = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
_COUNT = f"(len(regexp_extract_all(x, '{_SIGN}')) + len(regexp_extract_all(regexp_replace(x, '{_SIGN}', ' ', 'g'), '[^{_BLANK[1:]}+')))"
_FOLDED = "regexp_extract_all(lower(replace(replace(replace(replace(text, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')), '[\\p{L}\\p{N}\\p{M}]+')"
SQL: dict[str, str] = {
    "p3_found": f"WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL), s AS (SELECT chunk_id, text, list_max(list_transform(string_split(regexp_replace(text, '(\n|[.!?।]({_BLANK}|$)|[。！？])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_COUNT})) AS stretch, list_transform([text], lambda x: {_COUNT})[1] AS n FROM c) SELECT DISTINCT chunk_id, CASE WHEN stretch > 400 THEN 'forced' ELSE 'natural' END AS boundary FROM s WHERE n > 400",
    "p6_found": f"WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT question_id, {_FOLDED} AS w FROM (SELECT question_id, unnest([question, evidence]) AS text FROM qa_bank) WHERE text IS NOT NULL), a AS (SELECT DISTINCT question_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM q)), b AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM d)) SELECT DISTINCT doc_id, question_id FROM a JOIN b USING (k)",
}

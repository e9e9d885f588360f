"""Registry of the library's queries and of the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.catalog import evaluation, filters, index, layout, pages, reading, retrieval, scores, sources, structure, texts
from docloom.operators import units
from docloom.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    converted = units.convert_units(table(spark, folder, "table_cells"), table(spark, folder, "table_metadata"))
    return units.misrecorded(converted).select("cell_id", F.col("true_category").alias("unit_category"), "base_micro").distinct()


def p4_inferred(spark: SparkSession, folder: str) -> DataFrame:
    converted = units.convert_units(table(spark, folder, "table_cells"), table(spark, folder, "table_metadata"))
    return converted.where("unit_source = 'inferred'").select("cell_id", "raw_value", "unit", "true_category", "base_value", "posterior", "uncertain").distinct()


def p4_hidden(spark: SparkSession, folder: str) -> DataFrame:
    """How well the mixtures tell the unit of every cell that has one written, from its value alone."""
    return units.hidden_units(table(spark, folder, "table_cells"), table(spark, folder, "table_metadata"))


QUERIES: dict = {f.__name__: f for f in (p4_found, p4_inferred, p4_hidden)}
SQL: dict[str, str] = {}
for _part in (texts, filters, reading, retrieval, evaluation, scores, pages, layout, sources, index, structure):
    QUERIES |= _part.query.queries
    SQL |= _part.query.sql

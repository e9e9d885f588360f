"""p8_units splits the texts of every source; p8_found stays within its four."""

from docloom.llm import queries


def test_units_of_every_source(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    readable = {r.doc_id for r in docs.where("trim(text) <> ''").select("doc_id").collect()}
    units = queries.QUERIES["p8_units"](spark, data)
    assert {r.doc_id for r in units.select("doc_id").distinct().collect()} == readable
    found = queries.p8_found(spark, data)
    assert found.count() > 0 and found.exceptAll(units.select(found.columns)).count() == 0

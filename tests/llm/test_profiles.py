"""Prose profiles are fitted on all rows, whatever their order."""

from pyspark.sql import functions as F

from docloom.llm import quality

ENGLISH = "The pump is checked by the operator before each start of the line."
GERMAN = "Die Pumpe wird vor jedem Start der Anlage durch den Bediener geprüft."


def test_profiles_of_a_language_behind_the_first_rows(spark):
    rows = [(ENGLISH,)] * 1200 + [(GERMAN,)] * 60 + [(None,)]
    profiles = quality.fit_profiles(spark.createDataFrame(rows, "text string").coalesce(1), F.lit(True))
    assert set(profiles.prose) == {"en", "de"}
    assert profiles == quality.fit_profiles(spark.createDataFrame(rows[::-1], "text string").repartition(3), F.lit(True))


def test_structural_profiles_are_means_of_their_lines():
    table, prose = (0.0, 0.2, 0.3, 0.0, 0.0, 0.5, 0.0), (0.4, 0.6, 0.0, 0.0, 0.0, 0.0, 0.0)
    fitted = quality._structure([(table, quality.DEFAULT_PROSE, 100), (prose, quality.DEFAULT_PROSE, 900)], 5)
    seed = quality.UNFITTED.structure
    assert fitted[0] == seed[0] and fitted[2] == seed[2]
    assert all(abs(x - (quality.PRIOR * a + (1 - quality.PRIOR) * b)) < 1e-12 for x, a, b in zip(fitted[1], seed[1], table))

"""The language model of p1_found is adapted to the wording of all pairs, wherever they stand."""

import numpy as np

from docloom.llm import pairs

ENGLISH = "The operator checks the pump before each start of the line and writes the result into the report."
GERMAN = "Der Bediener prüft die Pumpe vor jedem Start der Anlage und schreibt das Ergebnis in den Bericht."


def test_pairs_behind_the_first_rows_are_learnt(spark):
    docs = spark.createDataFrame([("en", ENGLISH)] * 3 + [("de", GERMAN)] * 3, "lang string, text string")
    front = [(f"What does the operator check before the start of line {k}?", "The pump of the line.") for k in range(80)]
    back = [(f"Was prüft der Bediener vor dem Start der Anlage {k} mit dem Quarzgenerator?", "Die Pumpe der Anlage und das Ergebnis.") for k in range(20)]
    both = spark.createDataFrame([*front, *back, ("x", None)], "query string, ground_truth string").coalesce(1)
    model = pairs.fit_languages(docs, both, sample=3)
    en, de = (pairs.LANGUAGES.index(x) for x in ("en", "de"))
    g = pairs.grams("Quarzgenerator")
    assert (model[de, g] - model[en, g]).mean() > 2
    twice = pairs.fit_languages(docs, both.unionByName(both).repartition(3), sample=3)
    assert np.array_equal(model, twice)

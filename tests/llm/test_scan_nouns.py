"""Misread capitalised words: nouns by letters only, near-equal names left alone."""

from docloom.llm import scans

NOUNS = ["Pumpe", "Ventil", "Rechnung", "Leitung", "Zentrifuge", "Dichtung", "Vertrag", "Anschluss", "Lieferant", "Toleranz", "Studium", "Schicht", "Belastung", "Quartals", "Markierung"]
VERBS = ["pneumatic", "insulated", "approved", "supplier", "redundant", "procedure", "matches", "second", "further", "valve", "betrifft", "tragbare", "weitere", "schedule", "northern"]
NAMES = [("Novuritas", 22), ("Novuntas", 2), ("Torunmes", 11), ("Torurimes", 2), ("Velirater", 11), ("Velirafer", 2), ("Solunquor", 12), ("Soluriquor", 2)]
MISREAD = {"Purnpe": "Pumpe", "Vcntil": "Ventil", "Recbnung": "Rechnung", "Leitiing": "Leitung", "Studiiim": "Studium", "approvcd": "approved", "dehvery": "delivery", "Scbicht": "Schicht"}


def test_letter_only_misreadings_of_nouns(spark):
    counts = {**{w: 1500 + 10 * k for k, w in enumerate(NOUNS + VERBS)}, "delivery": 1700, **dict(NAMES), **{w: 9 for w in MISREAD}}
    common = sorted((w, n) for w, n in counts.items() if n >= 8)
    lower = frozenset(w for w, _ in common if w.islower())
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    fixes = {r.word: r.fix for r in scans.find_fixes(table, scans.fit_ranking(common), lower).collect()}
    assert fixes == MISREAD

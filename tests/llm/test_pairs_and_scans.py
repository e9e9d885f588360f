"""Broken pairs and scanned pages: rules on small cases, the whole operators on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import boosting, pairs, scans


@pytest.mark.parametrize("text", [None, "", " \t\n", "​", "N/A", "null", "None", "—", "[]", '""', "NOT_FOUND", "<no answer>", "[empty]", "..."])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["43", "431 W", "no", "0"])
def test_values_are_not_empty(text):
    assert not pairs.is_empty(text)


def test_copies():
    q = "What is the rated power of the XS-61?"
    for a in (q, q.upper(), f"A: {q}", f"“{q}”", f"**{q[:-1]}**", f"{q} {q}", q[:-1] + "..."):
        assert pairs.is_copy(q, a), a
    assert not pairs.is_copy(q, q + " It is 4 W.") and not pairs.is_copy(q, "4 W") and not pairs.is_copy(None, "x")


def test_refusals():
    assert pairs.is_refusal("I'm sorry, but I can't help with that request.", "q", "5 W")
    assert not pairs.is_refusal("I'm sorry, but I can't help with that request.", "q", "Not stated in the document.")
    assert not pairs.is_refusal("Sorry for the short note: 5 W.", "q", "5 W") and not pairs.is_refusal("I cannot answer this question.", "q", None)
    assert not pairs.is_refusal("The pump cannot run above 45.1 d.", "q", "45.1 d")


def test_open_ends():
    known = frozenset(["what", "is", "the", "power", "of"])
    assert pairs._open_end("It is 4 W.", "What is the power of Zan?", known) is None
    assert pairs._open_end("Zan: 4 W", "What is the power of Zan?", known) is None and pairs._open_end("**431 W", "q", known) is None
    assert pairs._open_end("It is 4 W, as stated in (see", "q", known) == []
    assert pairs._open_end("It is 4 W, as stated in the", "q", known)


def test_pairs_on_the_smallest_tables(spark, data):
    p, d = spark.read.parquet(f"{data}/predictions.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    extra = p.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in p.schema.fields])
    got = pairs.broken_pairs(p.unionByName(p).unionByName(extra).withColumn("contexts", F.lit(1)), d).collect()
    assert len(got) == len({r.query_id for r in got}) > 5
    assert {r.defect_type for r in got} <= {"empty", "truncated", "refusal", "copy", "wrong_language"}
    assert pairs.broken_pairs(p.limit(0), d).count() == 0


def test_boosting_learns_a_conjunction():
    x = [[a, b] for a in (0.0, 1.0) for b in (0.0, 1.0)] * 20
    trees = boosting.fit(x, [int(a and not b) for a, b in x], rounds=60)
    assert all((boosting.probability(trees, r) > 0.5) == (r[0] == 1 and r[1] == 0) for r in x[:4])
    assert boosting.probability(boosting.fit([], []), [0.0]) == 0.5


@pytest.mark.parametrize("line", ["p. 3", "- 17 -", "[1]", "iv.", "P a g e  48", "Seite 50 von 53", "45 / 50", "23"])
def test_page_numbers(line):
    assert scans.is_page_number(line)


@pytest.mark.parametrize("line", ["", "mild", "Pump: 3", "EUR 5,120", "12 mm"])
def test_no_page_numbers(line):
    assert not scans.is_page_number(line)


@pytest.mark.parametrize("read, printed", [("insul@ted", "insulated"), ("modu1ar", "modular"), ("rnanifold", "manifold"), ("clelays", "delays"), ("qiiarterly", "quarterly"), ("pncumatic", "pneumatic"), ("vvarranty", "warranty"), ("cormector", "connector")])
def test_known_misreadings_are_cheap(read, printed):
    cost, odd = scans.misreading_cost(read, printed)
    assert cost == 0.25 and odd == 0


def test_divisions_keep_compounds_and_codes():
    known = frozenset(["inventory", "manifold", "laboratory", "quarterly", "lint-free", "burn-in", "single-use", "single", "use", "pump", "gauge", "valve", "regulator", "catheter", "protocol"])
    model = scans.fit_divisions(known)
    for left, mark, right, want in (("invent", "-", "ory", True), ("invent", "¬", "ory", True), ("labora", "\xad", "tory", True), ("lint", "-", "free", False), ("single", "-", "use", False), ("KX", "-", "3895", False)):
        assert scans.is_division(left, mark, right, known, model) is want, (left, right)


PAGE = "The pump limits the new inventory. " * 3


def _scan(spark):
    rows = []
    for n in range(1, 7):
        rows += [("doc", n, f"h{n}", "Annual Report of Marenez Holding" if n != 3 else "Armual Rep0rt of M@renez Hold!ng"), ("doc", n, f"p{n}", PAGE + ("The pump limits the new invent-\nory today." if n == 2 else "")), ("doc", n, f"f{n}", f"Page {n} of 6")]
    rows += [("doc", 1, "null", None), ("doc", 1, "blank", "  \n "), ("doc", 2, "p2", rows[4][3])]
    return spark.createDataFrame([("z", k, d, n, t) for d, n, k, t in rows], "table_name string, item_key string, scan_key string, page long, text string").where("trim(text) <> ''")


def test_scan_noise_and_repair(spark):
    items = _scan(spark)
    models = scans.Models(items)
    found = {(r.item_key, r.noise) for r in scans.find_noise(items, models).collect()}
    assert {(f"h{n}", "running_head") for n in range(1, 7)} <= found and {(f"f{n}", "page_number") for n in range(1, 7)} <= found
    assert ("p2", "hyphen_break") in found and ("h3", "misread") in found
    assert not {x for x in found if x[0].startswith("p") and x != ("p2", "hyphen_break")}
    fixed = {r.item_key: r.repaired for r in scans.repair(items, models).collect()}
    assert "inventory today." in fixed["p2"] and fixed["h1"] == "" and fixed["f1"] == ""


def test_empty_scan(spark):
    items = _scan(spark).limit(0)
    assert scans.find_noise(items, scans.Models(items)).count() == 0

"""Rankers, searches, checks and corpus scores against plain computations."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import numeric as N
from docloom.functions import text as X
from docloom.operators import answers as A
from docloom.operators import elements as E
from docloom.operators import ranking as R
from docloom.operators import reading as D
from docloom.operators import tables as T

PAIRS = [("the pump is on", "the pump is on now"), ("a valve", "the valve is shut"), ("", "x"), ("one two three four five", "one two three four five"), ("the the the the", "the cat")]


def grams(text, n):
    w = text.split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def test_corpus_bleu(spark):
    df = spark.createDataFrame(PAIRS, "p string, g string")
    got = A.corpus_bleu(df).first()
    total = 0.0
    for n in range(1, 5):
        match = sum(min(c, grams(g, n)[k]) for p, g in PAIRS for k, c in grams(p, n).items())
        size = sum(sum(grams(p, n).values()) for p, _ in PAIRS)
        total += math.log((match or 0.1) / size) / 4
    lp, lg = sum(len(p.split()) for p, _ in PAIRS), sum(len(g.split()) for _, g in PAIRS)
    assert got.bleu == pytest.approx(math.exp(total) * (1 if lp >= lg else math.exp(1 - lg / lp)))
    assert A.corpus_bleu(df.limit(0)).first().bleu == 0.0


def test_cider(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(PAIRS)], "k int, p string, g string")
    got = {r.k: r.cider for r in A.cider(df, "k", "p", "g").collect()}
    freq = Counter(x for _, g in PAIRS for n in range(1, 5) for x in grams(g, n))
    for k, (p, g) in enumerate(PAIRS):
        score = 0.0
        for n in range(1, 5):
            w = lambda c: {x: v * (math.log(len(PAIRS)) - math.log(max(1, freq[x]))) for x, v in c.items()}
            a, b = w(grams(p, n)), w(grams(g, n))
            dot = sum(min(a.get(x, 0.0), v) * v for x, v in b.items())
            norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
            score += dot / norm if norm else 0.0
        want = 10 * score / 4 * math.exp(-((len(p.split()) - len(g.split())) ** 2) / 72)
        assert got[k] == pytest.approx(want, abs=1e-9), k


def test_maxsim(spark):
    draw = np.random.RandomState(2)
    rows = [(i, draw.randn(draw.randint(1, 4), 3).tolist()) for i in range(30)] + [(99, []), (100, None)]
    df = spark.createDataFrame(rows, "item_id long, m array<array<double>>").repartition(4)
    q = df.where("item_id in (3, 7, 99)").select(F.col("item_id").alias("query_id"), F.col("m").alias("q"))
    got = {}
    for r in R.maxsim_top(df, q, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item_id))
    for k in (3, 7):
        score = {i: float((np.array(rows[k][1]) @ np.array(m).T).max(axis=1).sum()) for i, m in rows if m}
        assert [i for _, i in sorted(got[k])] == sorted(score, key=lambda i: (-round(score[i], 9), i))[:3]
    assert 99 not in got


def test_search_has_both_branches(spark):
    cells = spark.createDataFrame(
        [("t_r0_c0", "t_r0", "t", "Pump A", "Rated Voltage", "12 V", 12.0, "voltage"), ("t_r0_c1", "t_r0", "t", "Pump A", "Material", "steel", None, None), ("t_r1_c0", "t_r1", "t", "Pump B", "Rated Voltage", "24 V", 24.0, "voltage"), ("t_r1_c1", "t_r1", "t", "Pump B", "Material", "brass", None, None)],
        "cell_id string, row_id string, table_id string, row_label string, column_label string, raw_value string, norm_numeric double, unit_category string",
    )
    meta = spark.createDataFrame([("t", "d.pdf", "S", 4)], "table_id string, doc_name string, section_path string, page int")
    queries = spark.createDataFrame([("a", "voltage > 13 V"), ("b", "material of Pump B"), ("c", ""), ("d", None), ("e", "voltage of pump a")], "query_id string, query string")
    got = {(r.query_id, r.rank): (r.cell_id, r.score) for r in T.search(cells, meta, queries, 1).collect()}
    assert got == {("a", 1): ("t_r1_c0", 10.0), ("b", 1): ("t_r1_c1", 3.0), ("e", 1): ("t_r0_c0", 3.0)}


def test_best_cell_prefers_domain_words(spark):
    cells = spark.createDataFrame([("r", "t", "c0", "rated working pump output", "x"), ("r", "t", "c1", "voltage", "y")], "row_id string, table_id string, cell_id string, column_label string, raw_value string")
    asked = spark.createDataFrame([("q", "r", "t", ["rated", "working", "voltage"])], "query_id string, row_id string, table_id string, query_tokens array<string>")
    best = T.best_cell(cells, asked).first()
    assert best.cell_id == "c1" and best.cell_score == 15


def test_element_checks(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [
        ("d", 0, "e0", "title", 1, box, 1, ["a"], "T", None, None, None), ("d", 1, "e1", "paragraph", 1, box, 2, [], "fine", None, None, None), ("d", 2, "e1", "table", 1, (5.0, 0.0, 1.0, 1.0), 2, ["a"], None, "| a |\n| b | c |", None, None),
        ("d", 3, "e3", "figure", 2, box, 1, ["a"], None, None, "p.png", " "), ("d", 4, "e4", "paragraph", 0, box, 2, ["a"], "xxxxx re- use", None, None, None), ("f", 0, None, None, None, None, None, None, None, None, None, None), ("g", 0, "e0", "paragraph", 1, box, 1, ["a"], "ok", None, None, None),
    ]
    schema = "doc string, elem_idx int, element_id string, type string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, reading_order int, section_path array<string>, text string, table_markdown string, image_path string, image_caption string"
    got = {(r.check_name, r.doc, r.element) for r in E.element_checks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("bbox_sanity", "d", "2"), ("table_integrity", "d", "2"), ("uniqueness", "d", "e1"), ("reading_order", "d", "page 1"), ("section_path", "d", "page 1"), ("figure_integrity", "d", "3"), ("type_correctness", "d", "4"), ("text_quality", "d", "4"),
        ("schema_completeness", "f", "0"), ("cross_document", "f", "document"),
    }
    assert E.element_checks(spark.createDataFrame([], schema)).count() == 0


def test_answer_spans(spark):
    text = "The Torex plant opened in May. Its pump delivers 45 litres. Staff like it.\nThe boiler of Torex holds 90 litres in 2019 and 80 litres in 2020."
    cases = [("How much does the pump deliver?", text), ("boiler 2020 2019", text), ("zzz", ""), ("x", None), ("", text)]
    df = spark.createDataFrame(cases, "q string, t string")
    got = df.select(D.answer_span(F.col("q"), F.col("t")).alias("a"), D.best_sentence(F.col("q"), F.col("t")).alias("s")).collect()
    # the first span of the best window that is no token of the query; the best sentence by itself
    assert got[0].a == "The Torex" and got[0].s == "Its pump delivers 45 litres." and got[1].a == "Its"
    assert got[2].a == "" and got[3].a is None and got[3].s is None
    assert D._in_order("2019 or 2020", "in 2019: 5, in 2020: 7", ["5", "7"]) == "5, 7" and D._in_order("2020 and 2019", "in 2019 5 units; the year 2020 7 units", ["5", "7"]) == "7, 5"
    assert D._in_order("one", "a b", list("abcdefg")) == "a, b, c, d, e" and D._in_order(None, None, []) is None


def test_key_terms_domains_units_and_code(spark):
    df = spark.createDataFrame([("The PUMP and the Pump weigh 12 kg or 5.5kg near Torex-9. An ape.",), (None,)], "t string")
    assert [list(r.k) for r in df.select(X.key_terms("t").alias("k")).collect()] == [["PUMP", "12 kg", "5.5kg", "Torex-9"], []]
    paths = spark.createDataFrame([("a/Medical/x", None), ("", "the theorem of a patient"), ("", "Revenue and method"), (None, None)], "p string, t string")
    assert [r.d for r in paths.select(X.document_domain(F.col("p"), F.col("t")).alias("d")).collect()] == ["medical", "medical", "scientific", "general"]
    units = spark.createDataFrame([("5.0 Volts",), ("12345",), ("0.5mm",), (" Steel ",), (None,)], "t string")
    assert [r.u for r in units.select(N.unit_string("t").alias("u")).collect()] == ["5 volts", "1.234e+04", "0.5 mm", "steel", None]
    code = spark.createDataFrame([("say\n```python\nx = 1\n```\nend",), ("plain ",)], "t string")
    assert [r.c for r in code.select(X.code_block("t").alias("c")).collect()] == ["x = 1", "plain"]


def test_gold_chunks_and_oracle(spark):
    chunks = spark.createDataFrame([("doc1_a",), ("doc12.x",), ("other",), (None,)], "chunk_id string")
    gold = spark.createDataFrame([("q", "doc1"), ("q", "her"), ("p", ""), ("p", None)], "query_id string, gold_id string")
    assert {(r.query_id, r.chunk_id) for r in D.gold_chunks(chunks, gold).collect()} == {("q", "doc1_a"), ("q", "doc12.x"), ("q", "other")}
    assert D.gold_chunks(chunks, gold.limit(0)).count() == 0
    answers = spark.createDataFrame([("q", False), ("q", True), ("p", None)], "query_id string, hit boolean")
    assert {(r.query_id, r.oracle, r.n_chunks) for r in D.any_chunk_oracle(answers, F.col("hit")).collect()} == {("q", 1, 2), ("p", 0, 1)}

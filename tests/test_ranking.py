"""Blocked searches and range lookups against brute force, over several blocks and parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ranking as R
from docloom.operators import sequences as S
from docloom.operators import tables as T


@pytest.fixture
def vectors(spark):
    draw = np.random.RandomState(0)
    rows = [(i, [float(x) for x in draw.randint(-3, 4, 6)], int(draw.randint(3))) for i in range(120)] + [(200, None, 1), (201, [0.0] * 6, None), (202, [1.0] * 6, 9)]
    return rows, spark.createDataFrame(rows, "item_id int, vector array<double>, label int").repartition(5)


def unit(v):
    v = np.zeros(6) if v is None else np.array(v)
    n = np.linalg.norm(v)
    return v / n if n else v


@pytest.mark.parametrize("block", [64 << 20, 300])
def test_dense_in_blocks(vectors, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    rows, df = vectors
    queries = df.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    got = {}
    for r in R.dense_top(df, queries, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item_id))
    for q, v, _ in rows:
        if q % 20 == 0:
            order = sorted(rows, key=lambda x: (-round(float(unit(v) @ unit(x[1])), 9), x[0]))[:4]
            assert [i for _, i in sorted(got[q])] == [x[0] for x in order]
    first = {r.query_id: r.first for r in R.first_relevant(df, queries).collect()}
    for q, v, label in rows:
        if q % 20 == 0:
            order = sorted((x for x in rows if x[0] != q), key=lambda x: (-round(float(unit(v) @ unit(x[1])), 9), x[0]))
            want = next((k for k, x in enumerate(order, 1) if x[2] == label and label is not None), None)
            assert first.get(q) == want
    assert R.dense_top(df.limit(0), queries, 3).count() == 0 and R.dense_top(df, queries.limit(0), 3).count() == 0 and R.first_relevant(df, queries.limit(0)).count() == 0


def test_range_lookup_over_parts(spark):
    draw = random.Random(5)
    cells = [(f"c{i:03d}", f"t{i % 3}", draw.choice([float(draw.randint(0, 30)), None, float("nan")]) if i % 9 == 0 else float(draw.randint(0, 30)), draw.choice(["power", "length", None])) for i in range(400)]
    asks = [(f"q{i}", draw.choice(["<", "<=", ">", ">=", "="]), float(draw.randint(-2, 33)), draw.choice(["power", "length", "none", None])) for i in range(80)]
    df = spark.createDataFrame(cells, "cell_id string, table_id string, norm_numeric double, unit_category string").repartition(7)
    meta = spark.createDataFrame([(f"t{i}", "d", None, i) for i in range(3)], "table_id string, doc_name string, section_path string, page int")
    got = {}
    for r in T.range_lookup(df, meta, spark.createDataFrame(asks, "query_id string, op string, target double, category string"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.cell_id))
    ok = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    for q, op, target, category in asks:
        hits = sorted((v, c) for c, _, v, u in cells if u is not None and u == category and v is not None and v == v and ok[op](v, target))[:5]
        assert [c for _, c in sorted(got.get(q, []))] == [c for _, c in hits], (q, op, target, category)


def test_neighbours_in_order(spark):
    rows = [("a", 2, "a2"), ("a", 1, "a1"), ("b", 5, "b5"), ("a", 3, "a3"), (None, 1, "n1"), (None, 2, "n2")]
    got = {r.k: (r.prev_id, r.next_id) for r in S.neighbours_in_order(spark.createDataFrame(rows, "g string, o int, k string").repartition(4), ["g"], ["o"], "k").collect()}
    assert got == {"a1": (None, "a2"), "a2": ("a1", "a3"), "a3": ("a2", None), "b5": (None, None), "n1": (None, "n2"), "n2": ("n1", None)}


def test_one_pass_index_equals_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None), (4, ""), (5, "b c d")], "id long, text string")
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda t: t != "")
    asked = spark.createDataFrame([("q", "b"), ("q", "c"), ("p", "c"), ("p", "zz")], "query_id string, token string")
    posted, stats = R.asked_index(docs, "id", tokens, asked)
    assert sorted((r.item_id, r.token, r.dl) for r in posted.collect()) == [(1, "b", 2), (2, "c", 1), (5, "b", 3), (5, "c", 3)]
    assert tuple(stats.first()) == tuple(R.collection(docs, "id", tokens).first())

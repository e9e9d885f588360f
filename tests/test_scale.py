"""Operators on pages, tables and questions that hold a large share of all rows, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import layout as L


def crowd(seed, n):
    draw = np.random.RandomState(seed)
    at = draw.randint(0, 40, (n, 2)).astype(float)
    return np.column_stack([at, at + draw.randint(1, 15, (n, 2))])


def raster(boxes):
    out = np.zeros((len(boxes), 60, 60), bool)
    for m, (x0, y0, x1, y1) in zip(out, boxes.astype(int)):
        m[x0:x1, y0:y1] = True
    return out


def frames(spark, gold, found):
    schema = "doc string, page int, box_id string, label string, x0 double, y0 double, x1 double, y1 double"
    rows = lambda boxes, mark: [("d", 1, f"{mark}{k:04d}", "ab"[k % 2], *map(float, b)) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows(gold, "g"), schema), spark.createDataFrame(rows(found, "f"), schema).withColumn("score", F.lit(0.5))


def test_strips_give_the_areas_of_a_page(monkeypatch):
    monkeypatch.setattr(L, "CELLS", 90)
    monkeypatch.setattr(L, "PAIRS", 30)
    gold, found = crowd(1, 12), crowd(2, 15)
    g, f = raster(gold), raster(found)
    of_gold, of_found, outside = L.assigned_areas(gold, found)
    own = [int((m & g).sum(axis=(1, 2)).argmax()) if (m & g).any() else -1 for m in f]
    assert [i for i, _ in of_found] == own and outside == pytest.approx((f.any(axis=0) & ~g.any(axis=0)).sum())
    for i in range(12):
        times = sum((f[j].astype(int) for j in range(15) if own[j] == i), np.zeros((60, 60), int))
        assert of_gold[i] == pytest.approx(((g[i] & (times > 0)).sum() / g[i].sum(), (g[i] & (times > 1)).sum() / g[i].sum()))
    for j, (i, t) in enumerate(of_found):
        assert t == pytest.approx((f[j] & np.delete(g, i, axis=0).any(axis=0)).sum() / g[i].sum() if i >= 0 else 0.0)


def crowded(call):
    """Memory at its peak, in MB, of a call on a page of 600 boxes a side."""
    import tracemalloc

    gold, found = crowd(3, 600) + np.random.RandomState(4).rand(600, 4), crowd(5, 600) + np.random.RandomState(6).rand(600, 4)
    tracemalloc.start()
    call(gold, found)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_class_areas_of_a_crowded_page():
    assert crowded(L.assigned_areas) < 150


def test_page_coverage_of_a_crowded_page(spark):
    gold, found = crowd(7, 30), crowd(8, 25)
    g, f = raster(gold), raster(found)
    whole, any_gold, times = g.any(axis=0).sum(), g.any(axis=0), f.sum(axis=0)
    own = [int((m & g).sum(axis=(1, 2)).argmax()) for m in f]
    trespass = sum((m & np.delete(g, o, axis=0).any(axis=0) & ~g[o]).sum() for m, o in zip(f, own))
    want = ((any_gold & (times > 0)).sum() / whole, (times > 1).sum() / whole, trespass / whole, (~any_gold & (times > 0)).sum() / whole)
    row = L.coverage(*frames(spark, gold, found), ["doc", "page"]).collect()
    assert [(r.doc, r.page) for r in row] == [("d", 1)] and tuple(row[0][2:]) == pytest.approx(want)
    assert crowded(L.coverage_areas) < 150


def test_protocol_for_all_thresholds_at_once():
    places = [(t, low, high) for low, high in L.AREAS.values() for t in L.THRESHOLDS]
    at, low, high = map(np.array, zip(*places))
    gold, found, score = crowd(9, 20) * 6, np.vstack([crowd(9, 20) * 6 + 4, crowd(10, 9) * 6]), np.random.RandomState(1).randint(0, 9, 29) / 9
    for most in (5, 100):
        order, hits, misses, n = L.protocol_hits(gold, found, score, at, low, high, most)
        for k, place in enumerate(places):
            want, count = L.protocol_matches(gold, found, score, *place, most)
            assert want == [(score[j], hits[q, k], not (hits[q, k] or misses[q, k])) for q, j in enumerate(order)] and count == n[k]


def test_bleu_counts_of_lists(spark):
    from docloom.operators import answers as A

    pairs = [("a b a b c", "a b c a b"), ("x", "x y"), ("", "a"), ("a a a", "a")]
    df = spark.createDataFrame(pairs, "p string, g string")
    for n in range(1, 5):
        want = [tuple(r.c) for r in df.select(A.bleu_counts(F.col("p"), F.col("g"), n).alias("c")).collect()]
        assert [A._clipped(p.split(), g.split(), n) for p, g in pairs] == want


def test_pages_of_a_file_that_is_asked_often(spark, tmp_path):
    import __spark_entry__ as e

    # 3,000 questions for one file of 3,000 chunks: nine million pairs, were they formed
    chunks = spark.range(3000).selectExpr("concat('c', id) as chunk_id", "'d.pdf' as doc_filename", "cast(id % 40 + 1 as int) as page", "repeat('x', cast(id % 7 as int)) as text")
    asked = spark.range(3000).selectExpr("concat('q', id) as query_id", "'d' as doc_stem", "repeat('y', cast(id % 50 + 1 as int)) as query")
    chunks.write.parquet(f"{tmp_path}/chunks.parquet")
    asked.write.parquet(f"{tmp_path}/predictions.parquet")
    m = e.queries()["page_metrics"](spark, str(tmp_path))
    joined = [x for x in m._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "query_id" not in x]
    assert any("gold#" in x and "doc#" in x for x in joined)
    rows = m.collect()
    assert len(rows) == 3000 and {r.hit_10 for r in rows} == {0.0, 1.0}


def test_tables_without_a_row_need_no_search():
    from docloom.operators import grids as G

    rows = [f"<tr><td>{k}</td><td>value of {k}</td></tr>" for k in range(400)]
    whole, less = "<table>" + "".join(rows) + "</table>", "<table>" + "".join(rows[:-1]) + "</table>"
    assert G.teds(whole, less) == G.teds(less, whole, True) == pytest.approx(1 - 3 / 1201)
    assert G.grits_scores(whole, less) == pytest.approx((1 - 1 / 799,) * 2)
    other = "<table>" + "".join(rows[:3]) + "<tr><td>x</td><td>value of 3</td></tr></table>"
    assert 0.9 < G.teds("<table>" + "".join(rows[:4]) + "</table>", other) < 1


def test_ids_meet_by_few_parts(spark):
    from docloom.operators import reading as D

    draw = np.random.RandomState(2)
    word = lambda n: "".join("ab"[x] for x in draw.randint(0, 2, n))
    ids, gold = sorted({word(draw.randint(1, 14)) for _ in range(60)}), sorted({word(draw.randint(1, 9)) for _ in range(40)})
    found = D.gold_chunks(spark.createDataFrame([(i,) for i in ids], "chunk_id string"), spark.createDataFrame([(g, g) for g in gold], "query_id string, gold_id string"))
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(g, i) for g in gold for i in ids if g in i}
    # lengths from 1 to 8 make four sizes of parts, not eight
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sequence(1") <= 2 * 4


@pytest.mark.parametrize("policy", ["EXCEPTION", "LAST_WIN"])
def test_later_columns_win_in_any_session(spark, policy):
    from docloom.operators import scoring as C
    from docloom.operators import tables as T

    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    try:
        cells = spark.createDataFrame([("t", "r", "l", "c0", "A", "1"), ("t", "r", "l", "c1", "B", None), ("t", "r", "l", "c2", "A", "2")], "table_id string, row_id string, row_label string, cell_id string, column_label string, raw_value string")
        assert [r.row_kv for r in T.row_maps(cells).collect()] == [{"A": "2", "B": None}]
        lit = lambda *x: F.create_map(*map(F.lit, x))  # noqa: E731 - keeps the order
        maps = spark.range(1).select(lit("a-b", "1", "ab", "2").alias("g"), lit("AB", "2").alias("f"))
        assert tuple(maps.select(C.key_specs(F.col("g"), F.col("f")).alias("s")).first().s) == (1.0, 1.0, 1.0)
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", before)


def test_words_meet_rows_of_their_place(spark):
    from docloom.sources import adapters as S

    draw = np.random.RandomState(3)
    box = "table_id string, x0 double, y0 double, x1 double, y1 double"
    rows = [("t", 0.0, float(y), 90.0, float(y + h)) for y, h in zip(range(0, 90, 7), draw.randint(3, 40, 13))] + [("t", 0.0, 5.0, 90.0, 5.0)]
    columns = [("t", float(x), 0.0, float(x + w), 95.0) for x, w in zip(range(0, 80, 11), draw.randint(5, 30, 8))]
    words = [("t", f"w{k}", *map(float, (x, y, x + 4, y + 2))) for k, (x, y) in enumerate(draw.randint(0, 95, (60, 2)))]
    grid = S.cell_grid(spark.createDataFrame(rows, box), spark.createDataFrame(columns, box), spark.createDataFrame(words, "table_id string, text string, x0 double, y0 double, x1 double, y1 double"))
    want = {}
    for i, r in enumerate(sorted(rows, key=lambda b: (b[2], b[1]))):
        for j, c in enumerate(sorted(columns, key=lambda b: (b[1], b[2]))):
            a0, b0, a1, b1 = max(r[1], c[1]), max(r[2], c[2]), min(r[3], c[3]), min(r[4], c[4])
            if a1 > a0 and b1 > b0:
                inside = [(y + 1, x, t) for _, t, x, y, *_ in words if a0 <= x + 2 < a1 and b0 <= y + 1 < b1]
                want[i, j] = " ".join(t for *_, t in sorted(inside))
    got = {(r.row_no, r.col_no): r.cell for r in grid.collect()}
    assert got == want
    joins = [x for x in grid._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and ">=" in x and "_slot" not in x]
    assert not joins


def test_lookup_writes_no_pairs(spark):
    from docloom.operators import tables as T

    draw = np.random.RandomState(4)
    take = lambda n: {f"t{min(int(x), 9)}" for x in draw.pareto(0.7, n)}
    index, asked = {f"r{k:03d}": take(6) for k in range(80)}, {f"q{k}": take(4) | {"none"} for k in range(20)}
    i = spark.createDataFrame([(r, "t", x) for r, v in index.items() for x in v], "row_id string, table_id string, token string")
    a = spark.createDataFrame([(q, x) for q, v in asked.items() for x in v], "query_id string, token string")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = T.lookup(i, a, 3)
        got = {(r.query_id, r.rank, r.row_id, r.hit_count) for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = set()
    for q, v in asked.items():
        best = sorted((-len(v & w), r) for r, w in index.items() if v & w)[:3]
        want |= {(q, k, r, -n) for k, (n, r) in enumerate(best, 1)}
    assert got == want and "Join" not in plan


def test_best_documents_without_pairs(spark):
    from docloom.operators import ranking as R

    draw = np.random.RandomState(5)
    words = lambda n: " ".join(f"w{min(int(x), 15)}" for x in draw.pareto(0.8, n))
    docs = spark.createDataFrame([(k, words(12)) for k in range(90)], "doc_id long, text string")
    asked = R.asked_tokens(spark.createDataFrame([(f"q{k}", words(4)) for k in range(15)], "q string, text string"), "q", F.split("text", " "))
    posted, stats = R.asked_index(docs, "doc_id", F.split("text", " "), asked)
    want = R.ranked(R.bm25(posted, asked, stats, log_idf=False).withColumn("score", F.round("score", 9)), 3)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        top = R.bm25_top(posted, asked, stats, 3, log_idf=False)
        got = {(r.query_id, r.rank): (r.item_id, r.score) for r in top.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = {(r.query_id, r.rank): (r.item_id, r.score) for r in want.collect()}
    assert got.keys() == expected.keys()
    for key, (item, score) in expected.items():
        assert got[key][0] == item and got[key][1] == pytest.approx(score, abs=2e-9)


def test_every_question_looks_up_its_rows(spark):
    from docloom.catalog.retrieval import entity_lookup_top5

    asked = [("q-0000020", "rated power of XS-1"), ("q-0000021", "rated power of the other"), ("q-0000022", "power, rated"), ("q-0000023", "weight"), ("q-odd", "weight 7 kg"), ("q-0000024", "none of these")]
    cells = [(f"r{r}", f"t{r % 2}", label, "value", str(r)) for r in range(1, 9) for label in (("rated power" if r % 2 else "power"), "weight")]
    tables = {
        "predictions": spark.createDataFrame(asked * 2, "query_id string, query string"),
        "table_cells": spark.createDataFrame(cells, "row_id string, table_id string, row_label string, column_label string, raw_value string"),
    }
    got = {(r.query_id, r.rank, r.row_id, r.table_id, r.hit_count) for r in entity_lookup_top5(tables.__getitem__).collect()}
    rows: dict = {}
    for row, table, label, column, value in cells:
        rows.setdefault((row, table), set()).update(f"{label} {column} {value}".split())
    want = set()
    for query, text in asked:
        own = set(text.lower().replace(",", "").split())
        best = sorted((-len(own & tokens), *row) for row, tokens in rows.items() if own & tokens)[:5]
        want |= {(query, k, row, table, -n) for k, (n, row, table) in enumerate(best, 1)}
    assert got == want and {q for q, *_ in got} == {q for q, _ in asked[:5]}


def test_every_question_is_answered(spark):
    from docloom.catalog.index import routed_answers

    asked = [(f"q-{k:07d}", f"what is the warranty of unit u{k % 7}") for k in range(18, 43)] + [("q-0000043", "table: power of p3"), ("q-0000044", "table: weight of p2"), ("q-odd", "table: power of p3"), ("q-0000045", "why zzz")]
    docs = [(k, f"Unit u{k} comes in a box. The warranty of unit u{k} is {k + 1} years. It is blue and it is new.") for k in range(7)]
    cells = [(f"t_r{r}_{label}", f"t_r{r}", "t", f"p{r}", label, f"{r}{at}") for r in range(5) for at, label in enumerate(("power", "weight"))]
    tables = {
        "predictions": spark.createDataFrame(asked * 2, "query_id string, query string"),
        "documents": spark.createDataFrame(docs, "doc_id long, text string"),
        "table_cells": spark.createDataFrame(cells, "cell_id string, row_id string, table_id string, row_label string, column_label string, raw_value string"),
    }
    got = {r.query_id: (r.route, r.answer, r.doc_id) for r in routed_answers(tables.__getitem__).collect()}
    want = {q: ("prose", f"The warranty of unit {u} is {int(u[1:]) + 1} years.", u[1:]) for q, text in asked[:25] for u in [text.split()[-1]]}
    want |= {"q-0000043": ("table", "30", "t"), "q-0000044": ("table", "21", "t"), "q-odd": ("table", "30", "t"), "q-0000045": ("prose", "", "")}
    assert got == want


@pytest.mark.parametrize("log_idf", [False, True])
def test_best_document_of_every_question(spark, log_idf):
    from docloom.operators import ranking as R

    draw = np.random.RandomState(6)
    words = lambda n: " ".join(f"w{min(int(x), 40)}" for x in draw.pareto(0.6, n))
    docs = spark.createDataFrame([(k, words(9)) for k in range(70)], "doc_id long, text string")
    asked = R.asked_tokens(spark.createDataFrame([(f"q{k}", words(5) if k else "w0 none") for k in range(60)], "q string, text string"), "q", F.split("text", " "))
    posted, stats = R.asked_index(docs, "doc_id", F.split("text", " "), asked)
    rows = lambda df: {r.query_id: (r.item_id, pytest.approx(r.score, abs=2e-9)) for r in df.collect()}
    got = {r.query_id: (r.item_id, r.score) for r in R.bm25_top(posted, asked, stats, 1, log_idf=log_idf).collect()}
    assert got == rows(R.ranked(R.bm25(posted, asked, stats, log_idf=log_idf).withColumn("score", F.round("score", 9)), 1))
    assert len(got) == 60

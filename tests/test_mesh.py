"""Chunkers with boxes, vectors and links against plain folds over the same elements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.operators import chunkers as C
from docloom.operators import mesh as M
from docloom.operators import sequences as S

SCHEMA = "doc string, page int, seq int, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
WORDS = "pump valve seal rotor gauge lamp clamp shaft meter hose".split()


def words(n, k=0):
    return " ".join(WORDS[(i + k) % 10] for i in range(n))


@pytest.fixture(scope="module")
def elements(spark):
    box = lambda x, y, w=100, h=20: (float(x), float(y), float(x + w), float(y + h))
    rows = [
        ("a.pdf", 1, 1, "title", "Alpha", box(0, 0)), ("a.pdf", 1, 2, "text", words(30), box(0, 30)), ("a.pdf", 1, 3, "text", words(40, 1), box(0, 60)), ("a.pdf", 1, 4, "figure", "A lamp", box(0, 90)), ("a.pdf", 1, 5, "text", "near the figure", box(0, 115)),
        ("a.pdf", 1, 6, "abandon", "page 1", box(0, 700)), ("a.pdf", 2, 1, "text", words(50, 2) + " dis-", box(0, 0)), ("a.pdf", 2, 2, "text", "agreement " + words(20), box(0, 40)), ("a.pdf", 2, 3, "table", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", box(0, 80)),
        ("a.pdf", 2, 4, "text", words(10), box(300, 600)), ("b.pdf", 1, 1, "text", "", box(0, 0)), ("b.pdf", 1, 2, "list_item", None, box(0, 30)), ("b.pdf", 3, 1, "section_header", "Beta", box(0, 0)), ("b.pdf", 3, 2, "text", "tail", box(0, 30)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def covered(chunks):
    return sorted((r.doc, r.page, s) for r in chunks.collect() for s in r.source_element_indices)


def test_geometric_claims_each_element_once(elements):
    chunks = M.geometric_grounding(elements)
    every = sorted((r.doc, r.page, r.seq) for r in elements.collect())
    assert covered(chunks) == every
    figure = next(r for r in chunks.collect() if "figure" in r.element_types)
    # the nearest first, and at most three; then the page number, as nothing is nearer to it
    assert figure.text.split("\n\n")[0] == "[FIGURE] A lamp" and figure.source_element_indices == [4, 5, 3, 2, 6]
    assert len({r.chunk_id for r in chunks.collect()}) == chunks.count()


def test_claims_are_greedy():
    boxes = np.array([[0, 0, 10, 10], [0, 20, 10, 30.0]])
    others = np.array([[0, 12, 10, 18.0], [0, 32, 10, 40.0], [50, 0, 60, 10.0]])
    assert M.claim(boxes, others, [True] * 3, 60, 0.3, 1) == [[0], [1]] and M.claim(boxes, others, [True] * 3, 60, 0.3, 3) == [[0, 1], []]
    assert M.claim(boxes, np.zeros((0, 4)), [], 60, 0.3, 3) == [[], []]


def test_semantic_flushes():
    same, other = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert M.flushes([50, 50, 50], [same, same, other], 1000, 0.5, 80) == ([0, 0, 1], ["semantic", "end"])
    assert M.flushes([50, 20, 50], [same, other, same], 1000, 0.5, 80) == ([0, 0, 0], ["end"])
    assert M.flushes([50, 50, 50], [same, None, other], 100, 0.5, 80) == ([0, 0, 1], ["tokens", "end"]) and M.flushes([], [], 10, 0.5, 5) == ([], [])


def test_hybrid_covers_all_but_ignored(elements):
    e = elements.where("type <> 'abandon'").withColumn("vector", V.hashed_embedding(F.split("text", " ")))
    assert covered(M.hybrid_semantic(e, most=60)) == sorted((r.doc, r.page, r.seq) for r in e.collect())


def test_mesh_stitches_pages_and_splits_tables(elements):
    rows = {r.chunk_id: r for r in M.semantic_mesh(elements, 100, 200, 2).collect()}
    texts = [r for r in rows.values() if r.source == "text"]
    joined = next(r for r in texts if "disagreement" in r.text)
    assert joined.header == "Alpha" and joined.text.startswith("Alpha\n\n") and joined.page_span == [1, 2]
    parent = next(r for r in rows.values() if r.source == "table_parent")
    by_row = sorted((r for r in rows.values() if r.source == "table_row"), key=lambda r: r.chunk_id)
    assert parent.text == "Table: Alpha | Columns: a, b | Rows: 2" and [r.prev_id for r in by_row] == [None, by_row[0].chunk_id] and [r.next_id for r in by_row] == [by_row[1].chunk_id, None]
    for r in texts:
        assert r.prev_id is None or rows[r.prev_id].next_id == r.chunk_id
    whole = M.semantic_mesh(elements, 1000, 2000, 35).where("source = 'text' and header = 'Alpha'").collect()
    assert [r.page_span for r in sorted(whole, key=lambda r: r.page)] == [[1], [1, 2], [2]]
    assert M.semantic_mesh(elements.limit(0)).count() == 0 and M.geometric_grounding(elements.limit(0)).count() == 0


def test_packs_with_a_least_size(spark):
    sizes = [300, 300, 300, 100, 900, 10]
    got = spark.range(1).select(S.pack_between(F.array(*[F.lit(s).cast("long") for s in sizes]), 400, 750)).first()[0]
    groups, used, out = 0, 0, []
    for n in sizes:
        if out and used + n > 750 and used >= 400:
            groups, used = groups + 1, 0
        out.append(groups)
        used += n
    assert got == out


def test_carry_and_previous_over_pages(spark):
    rows = [(d, p, s, "h" if (p, s) in {(1, 2), (3, 1)} else None) for d in "ab" for p in (1, 2, 3) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc string, page int, seq int, v string").withColumn("v", F.when(F.col("v").isNotNull(), F.concat("doc", F.col("page").cast("string"))))
    got = {(r.doc, r.page, r.seq): (r.c, r.p) for r in S.previous_over_pages(S.carry_over_pages(df, ["doc"], "page", ["seq"], "v", "c"), ["doc"], "page", ["seq"], F.col("page") * 10 + F.col("seq"), "p").collect()}
    last = {}
    for d, p, s, _ in sorted(rows):
        if (p, s) in {(1, 2), (3, 1)}:
            last[d] = f"{d}{p}"
        assert got[d, p, s][0] == last.get(d)
    assert got["a", 1, 1][1] is None and got["a", 2, 1][1] == 13 and got["b", 3, 2][1] == 31


def test_global_number(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = {r.k: r.number for r in S.global_number(df, ["k"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))


def test_unknown_strategy_is_the_mesh():
    assert C.chunker("nothing") is M.semantic_mesh and C.chunker("element_atomic") is C.element_atomic


def test_naive_windows_know_their_elements(spark):
    e = spark.createDataFrame([("d", 1, 1, "text", "a b c"), ("d", 1, 2, "text", None), ("d", 1, 3, "text", " d  e"), ("d", 2, 1, "text", "")], "doc string, page int, seq int, type string, text string")
    got = [(r.text, r.source_element_indices) for r in sorted(C.naive_baseline(e, 3, 1).collect(), key=lambda r: r.chunk_id)]
    assert got == [("a b c", [1]), ("c d e", [1, 3])]


def test_tagged_blocks_stand_alone(spark):
    tagged = '[TABLE id="p1_tbl1" page="1" cross_ref_figures="p1_fig1"]\n[TABLE]\n| a |'
    text = "\n\n".join(["one", "two", tagged, "x" * 30, "y" * 30, '[FIGURE id="p1_fig1" page="1"]\nlamp'])
    rows = sorted(C.tagged_blocks(spark.createDataFrame([(1, text), (2, None), (3, " \n\n ")], "doc_id int, text string"), budget=40).collect(), key=lambda r: r.seq)
    assert [(r.seq, r.element_type, r.n_blocks, r.prev_seq, r.next_seq) for r in rows] == [(0, "text", 2, None, 1), (1, "table", 1, 0, 2), (2, "text", 1, 1, 3), (3, "text", 1, 2, 4), (4, "figure", 1, 3, None)]
    assert rows[0].text == "one\n\ntwo" and rows[1].cross_references == {"cross_ref_figures": ["p1_fig1"]} and rows[2].cross_references is None


def test_sections_take_the_header_above(elements, spark):
    box = lambda y: (0.0, float(y), 10.0, float(y + 10))
    rows = [("d", 1, 1, "title", "One", box(0)), ("d", 1, 2, "text", "aa bb", box(20)), ("d", 1, 3, "table", "| t |", box(60)), ("d", 1, 4, "caption", "Table 1", box(75)), ("d", 1, 5, "text", "cc", box(90)), ("d", 1, 6, "title", "Two", box(200)), ("d", 1, 7, "caption", "alone", box(220)), ("d", 2, 1, "figure", "lamp", box(5)), ("d", 2, 2, "text", None, box(50))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page, r.source_element_indices, r.parent_section, r.caption_for, r.text) for r in C.section_hierarchical(df, 100).collect())
    assert got == [
        (1, [1, 2], "One", None, "One\n\naa bb"), (1, [3], "One", None, "One\n\n| t |"), (1, [4], "One", "table", "Table 1"), (1, [5], "One", None, "One\n\ncc"), (1, [6], "Two", None, "Two"), (1, [7], "Two", None, "Two\n\nalone"),
        (2, [1], "Two", None, "Two\n\n[FIGURE] lamp"), (2, [2], "Two", None, "Two\n\n"),
    ]
    assert covered(C.section_hierarchical(elements)) == sorted((r.doc, r.page, r.seq) for r in elements.collect())

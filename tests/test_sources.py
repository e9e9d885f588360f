"""Readers, writers, adapters, model boundaries and programs over small files."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import markup as K
from docloom.functions import numeric as N
from docloom.functions import vectors as V
from docloom.plans import extensions as P
from docloom.sources import adapters as S
from docloom.sources import readers as I


def test_element_and_chunk_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"doc_id": "d", "content_hash": "h", "elements": [{"type": "title", "content": "A�b", "page": 1}, {"type": "text"}]}))
    rows = I.read_elements(spark, str(tmp_path / "a.json")).collect()
    assert [(r.elem_idx, r.type, r.content, r.page) for r in rows] == [(0, "title", "Ab", 1), (1, "text", None, None)]
    (tmp_path / "stem_x.json").write_text(json.dumps([{"chunk_id": "c1", "text": "t"}]))
    (tmp_path / "stem_y.jsonl").write_text('{"chunk_id": "c2", "text": "u"}\n')
    assert I.read_chunks(spark, str(tmp_path / "stem_x.json"), multiline=True).first().doc_stem == "stem_x"
    assert I.read_chunks(spark, str(tmp_path / "stem_y.jsonl")).first().doc_stem == "stem_y"


def test_question_bank_and_csv(spark, tmp_path):
    (tmp_path / "bank.md").write_text("# Bank\n\n## stem_a\n\n| id | q | a | e | l | r | f | d | adv | n |\n|---|---|---|---|---|---|---|---|---|---|\n| Q1 | What? | 5 | p.3 | text | span | num | easy | no | x |\n| too | short |\n")
    rows = [r for r in I.read_markdown_bank(spark, str(tmp_path / "bank.md")).collect() if r.question_id != "id"]
    assert [(r.doc_stem, r.question_id, r.ground_truth, r.difficulty) for r in rows] == [("stem_a", "Q1", "5", "easy")]
    (tmp_path / "m.csv").write_text('name,url\n"a ""b""",http://x\n')
    assert I.read_csv(spark, str(tmp_path / "m.csv")).first().name == 'a "b"'


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([("c1", "mesh", "x"), ("c2", "atomic", "y")], "chunk_id string, strategy string, text string")
    I.write_chunks(df, str(tmp_path / "chunks"))
    assert {(r.chunk_id, r.strategy) for r in spark.read.json(str(tmp_path / "chunks")).collect()} == {("c1", "mesh"), ("c2", "atomic")}
    I.write_csv(df, str(tmp_path / "csv"))
    assert I.read_csv(spark, str(tmp_path / "csv")).count() == 2
    assert I.markdown_table(df.select("chunk_id", "text"), ["chunk_id"]).split("\n") == ["| chunk_id | text |", "|---|---|", "| c1 | x |", "| c2 | y |"]


def test_synthetic_pages(spark, tmp_path):
    (tmp_path / "legal").mkdir()
    (tmp_path / "legal" / "p.json").write_text(json.dumps({"pages": [{"page": 2, "elements": [{"type": "table", "bbox": [1, 2, 3, 4]}, {"label": "text", "bbox": [5, 6, 7, 8]}]}]}))
    rows = sorted((r.domain, r.page, r.label, r.x0, r.y1) for r in S.read_synthetic(spark, str(tmp_path / "*" / "*.json")).collect())
    assert rows == [("legal", 2, "table", 1.0, 4.0), ("legal", 2, "text", 5.0, 8.0)]


def test_models_see_each_file_once_and_may_fail(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one two")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def load():
        def words(data):
            if not data.startswith(b"%PDF"):
                raise ValueError("no PDF")
            return [(w.decode(), k) for k, w in enumerate(data.split()[1:])]

        return words

    rows = S.extract(S.read_files(spark, str(tmp_path)), load, "word string, place int").collect()
    assert sorted((r.word or "", r.place if r.place is not None else -1, r.error) for r in rows) == [("", -1, "ValueError: no PDF"), ("one", 0, None), ("two", 1, None)]
    box = spark.sql("select array(array(1.0, 5.0), array(3.0, 2.0), array(2.0, 9.0)) p").select(S.hull_of_polygon(F.col("p")).alias("b")).first().b
    assert tuple(map(float, box)) == (1.0, 2.0, 3.0, 9.0)


def test_enhanced_grid(spark):
    grid = [["", "2019", "2018"], ["", "in thousands", ""], ["Revenue", "", ""], ["Goods", "1", "2"], ["Costs", "", ""], ["Staff", "3", "4"], ["", "5", ""]]
    df = spark.createDataFrame([("t", grid), ("u", [["a", "b"]]), ("v", [])], "table_id string, grid array<array<string>>")
    got = {r.table_id: r for r in S.enhanced_grids(df).collect()}
    assert got["t"].column_headers == ["Col_0", "2019 :: in thousands", "2018"]
    assert [r.row_label for r in got["t"].rows] == ["Revenue :: Goods", "Costs :: Staff", "Costs :: "] and got["t"].rows[0].cell_values == ["Goods", "1", "2"]
    assert got["u"].column_headers == ["a", "b"] and got["u"].rows == [] and "v" not in got


def test_config():
    good = [{"model_key": "a", "model_name": "m", "backend": "b"}]
    assert S.check_config(good) is good
    with pytest.raises(ValueError, match="backend"):
        S.check_config([{"model_key": "a", "model_name": "m"}])


@pytest.mark.parametrize(
    "code, result",
    [
        ("result = (1 + 2) * 3", 9.0), ("a = [1, 2.5]\nresult = sum(a) / len(a)", 1.75), ("result = round(10 / 4, 1)", 2.5), ("result = -2 ** 3", -8.0), ("import os\nresult = 1", None), ("result = __import__('os')", None), ("result = (1).__class__", None),
        ("x = 1", None), ("result = 1 / 0", None), ("result = y", None), ("result = 9 ** 9 ** 9", None), ("result = open('x')", None), ("while True: pass", None), ("def", None), (None, None), ("result = 'a'", None),
    ],
)
def test_programs(code, result):
    assert N.run_program(code) == result


def test_tags_and_grids(spark):
    one = spark.createDataFrame([('[TABLE id="p1_tbl1" page="1" cross_ref_figures="p1_fig1, p1_fig2" cross_ref_text=""]\n[TABLE]\nx',), ("none",), (None,)], "b string").select(K.tag("b").alias("t")).collect()
    assert one[0].t.asDict() == {"kind": "TABLE", "element_id": "p1_tbl1", "page": "1", "refs": {"cross_ref_figures": ["p1_fig1", "p1_fig2"], "cross_ref_text": []}} and one[1].t is None and one[2].t is None
    grid = spark.createDataFrame([(["a", "b"], [["1", None]]), ([], [["x"]])], "h array<string>, r array<array<string>>").select(K.markdown_grid(F.col("h"), F.col("r")).alias("m")).collect()
    assert [r.m for r in grid] == ["| a | b |\n| --- | --- |\n| 1 |  |", "| x |"]
    box = spark.createDataFrame([("<x_824><y_0>Text\nmore<x_1648><y_1024><class_Title>",)], "s string").select(K.model_boxes("s", 612.0, 792.0).alias("m")).first().m
    assert [tuple(b) for b in box] == [("title", "Text\nmore", 306.0, 0.0, 612.0, 396.0)]


def test_encoders_caches_and_vectors(spark):
    e = P.Encoders()
    e.add("short", lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)), 2, query_prefix="q: ")
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [list(r.v) for r in df.select(e.encode("short", F.col("t"), query=True, size=3).alias("v")).collect()] == [[6.0, 1.0, 0.0], [3.0, 1.0, 0.0]]
    with pytest.raises(KeyError, match="hashed"):
        e.encode("nothing", F.col("t"))
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "row_id int, prompt string")
    cache = asked.where("prompt = 'b'").select(F.md5(F.lit("m:b")).alias("key"), F.lit("known").alias("response"))
    answers, fresh = P.cached_calls(asked, cache, lambda c: F.nullif(F.upper(c), F.lit("")), "m")
    assert {(r.row_id, r.response) for r in answers.collect()} == {(1, "A"), (2, "A"), (3, "known"), (4, None)} and fresh.count() == 1
    pooled = spark.sql("select array(array(1.0D, 2.0D), array(3.0D, 4.0D)) v, cast(array() as array<array<double>>) n").select(P.mean_pooled(F.col("v"), 2).alias("a"), P.mean_pooled(F.col("n"), 2).alias("b")).first()
    assert list(pooled.a) == [2.0, 3.0] and list(pooled.b) == [0.0, 0.0]
    import pandas as pd

    a = V.seeded_vector(pd.Series(["x", "x", None]), 5)
    assert a[0] == a[1] and a[2] is None and abs(sum(v * v for v in a[0]) - 1) < 1e-6
    cut = spark.sql("select sequence(1, 7) s, cast(array() as array<int>) e").select(V.batches(F.col("s"), 3).alias("s"), V.batches(F.col("e"), 3).alias("e")).first()
    assert [list(x) for x in cut.s] == [[1, 2, 3], [4, 5, 6], [7]] and cut.e is None

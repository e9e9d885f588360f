"""Page associations that depend on earlier choices, against plain loops."""

from pyspark.sql import functions as F

from docloom.operators import pages as P
from docloom.operators import scoring as C


def test_tables_take_the_nearest_free_box(spark):
    boxes = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, 0.0, 50.0, 10.0, 60.0), ("e", 1, 1, 0.0, 0.0, 1.0, 1.0)], "doc string, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([("d", 1, "t1", 0.0, 48.0, 10.0, 58.0), ("d", 1, "t2", 0.0, 55.0, 10.0, 65.0), ("d", 1, "t3", 0.0, 90.0, 10.0, 95.0), ("f", 1, "t4", 0.0, 0.0, 1.0, 1.0)], "doc string, page int, table_id string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.table_id, r.seq) for r in P.merge_tables(tables, boxes, ["doc", "page"]).collect()}
    assert got == {("t1", 2), ("t2", 1), ("t3", 1)}
    assert P.merge_tables(tables.limit(0), boxes, ["doc", "page"]).count() == 0


def test_section_paths_follow_the_numbering(spark):
    titles = ["Introduction", "1 Scope", "1.1 Range", "Notes", "1.2.3 Deep", "2 End", "ABCD no number", "B Appendix"]
    rows = [("d", 1 + k // 3, k, t, True) for k, t in enumerate(titles)] + [("d", 1, 99, "body one", False), ("d", 2, 99, "body two", False), ("d", 9, 0, "last", False), ("e", 1, 0, "none", False)]
    df = spark.createDataFrame(rows, "doc string, page int, seq int, text string, is_title boolean")
    got = {(r.doc, r.text): r.section_path for r in P.section_paths(df, "doc", ["page", "seq"], F.col("is_title")).collect()}
    level, stack, want = 1, [], {}
    depth = {"1 Scope": 1, "1.1 Range": 2, "1.2.3 Deep": 3, "2 End": 1, "B Appendix": 1}
    for t in titles:
        level = depth.get(t, level)
        while len(stack) >= level:
            stack.pop()
        stack.append(t)
        want["d", t] = list(stack)
    assert {k: v for k, v in got.items() if k in want} == want
    assert got["d", "body one"] == want["d", "1.1 Range"] and got["d", "body two"] == want["d", "2 End"] and got["d", "last"] == want["d", "B Appendix"] and got["e", "none"] == []


def test_key_specs_and_sets(spark):
    def norm(s):
        return "" if s is None else s.strip().lower().replace("-", "").replace("_", "").replace(" ", "")

    def brute(gold, found):
        a, b = {norm(k): norm(v) for k, v in gold.items()}, {norm(k): norm(v) for k, v in found.items()}
        if not a or not b:
            return (1.0,) * 3 if not a and not b else (0.0,) * 3
        tp = sum(k in b and (a[k] in b[k] or b[k] in a[k]) for k in a)
        p, r = tp / len(b), tp / (tp + sum(k not in b for k in a)) if tp + sum(k not in b for k in a) else 0.0
        return p, r, 2 * p * r / (p + r) if p + r else 0.0

    cases = [({"Width": "10 mm", "Color": "red"}, {"width": "10-mm", "weight": "2"}), ({}, {}), ({"a": "1"}, {}), ({}, {"a": "1"}), ({"a": None, "b": "xyz"}, {"A": "7", "b": "y"}), ({"a": "1"}, {"a": "2"})]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, g map<string,string>, f map<string,string>")
    for r in df.select("k", C.key_specs(F.col("g"), F.col("f")).alias("s")).collect():
        assert [round(x, 9) for x in r.s] == [round(x, 9) for x in brute(*cases[r.k])], cases[r.k]
    sets = spark.createDataFrame([(["A-b", "c"], ["ab", "d"]), ([], []), (None, ["x"]), ([""], None)], "g array<string>, f array<string>").select(C.set_field(F.col("g"), F.col("f")).alias("s")).collect()
    assert [r.s.f1 for r in sets] == [0.5, 1.0, 0.0, 1.0]


def test_cells_match_by_unit(spark):
    rows = [("5V", "5.0 V"), ("5 V", "6 V"), (None, "5"), ("a ", "A"), ("", ""), ("5 V", "5")]
    got = [r.m for r in spark.createDataFrame(rows, "f string, g string").select(C.cell_match(F.col("f"), F.col("g")).alias("m")).collect()]
    assert got == [True, False, False, True, False, True]


def test_missing_metric_is_an_error(spark):
    import pytest

    run = spark.createDataFrame([(0.5, 0.5, 0.5)], "judge double, contains double, numeric_em double")
    with pytest.raises(Exception, match="token_f1"):
        C.resolved(run).collect()

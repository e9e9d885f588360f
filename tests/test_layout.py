"""Layout and table metrics against plain computations."""

import numpy as np
import pytest

from docloom.operators import grids as G
from docloom.operators import layout as L
from docloom.operators import matching as M

BOX = "doc string, page int, box_id string, label string, x0 double, y0 double, x1 double, y1 double"


def boxes(draw, n, page, mark):
    out = []
    for k in range(n):
        x, y = draw.randint(0, 80, 2)
        w, h = draw.randint(5, 60, 2)
        out.append(("d", page, f"{mark}{k}", "ab"[draw.randint(2)], float(x), float(y), float(x + w), float(y + h)))
    return out


def test_protocol_against_a_plain_curve(spark):
    draw = np.random.RandomState(4)
    gold = [b for p in range(6) for b in boxes(draw, draw.randint(0, 6), p, "g")]
    found = []
    for p in range(6):
        for k, b in enumerate([b for b in gold if b[1] == p] + boxes(draw, 3, p, "x")):
            found.append((*b[:2], f"f{k}", b[3], *(v + draw.randint(-4, 5) for v in b[4:]), draw.randint(1000) / 1000))
    g, f = spark.createDataFrame(gold, BOX), spark.createDataFrame([(*x[:4], *map(float, x[4:])) for x in found], BOX + ", score double")
    got = {(r.label, r.area, r.threshold): (r.ap, r.ar) for r in L.detection_protocol(g, f, ["doc", "page"]).collect()}
    for (label, area, t), (ap, ar) in got.items():
        low, high = L.AREAS[area]
        hits, n = [], 0
        for p in range(6):
            a = np.array([x[4:8] for x in gold if x[1] == p and x[3] == label], float).reshape(-1, 4)
            b = sorted((x for x in found if x[1] == p and x[3] == label), key=lambda x: x[2])
            h, m = L.protocol_matches(a, np.array([x[4:8] for x in b], float).reshape(-1, 4), np.array([x[8] for x in b], float), t, low, high)
            hits += [(s, ok) for s, ok, ignored in h if not ignored]
            n += m
        points = []
        for s in sorted({s for s, _ in hits}, reverse=True):
            kept = [ok for v, ok in hits if v >= s]
            points.append((sum(kept) / n, sum(kept) / len(kept)))
        want = np.mean([max((p for r, p in points if r >= k / 100 - 1e-9), default=0.0) for k in range(101)])
        assert ap == pytest.approx(want) and ar == pytest.approx(max((r for r, _ in points), default=0.0)), (label, area, t)
    assert L.detection_protocol(g.limit(0), f.limit(0), ["doc", "page"]).count() == 0


def test_protocol_prefers_boxes_that_count():
    gold = np.array([[0, 0, 10, 10], [0, 0, 50, 50.0]])
    hits, n = L.protocol_matches(gold, np.array([[0, 0, 50, 50.0], [0, 0, 9, 10.0], [60, 60, 62, 62.0]]), np.array([0.9, 0.8, 0.7]), 0.5, 0.0, 32.0**2)
    # the large box lies on one that does not count; the stray small one is a false positive
    assert n == 1 and hits == [(0.9, False, True), (0.8, True, False), (0.7, False, False)]


def test_detection_errors():
    gold = np.array([[0, 0, 10, 10], [20, 0, 30, 10], [40, 0, 60, 10], [80, 80, 90, 90.0]])
    found = np.array([[0, 0, 10, 10], [0, 0, 10, 9.5], [20, 0, 26, 10], [40, 0, 50, 10], [50, 0, 60, 10], [200, 0, 210, 10.0]])
    counts = dict(zip(L.ERRORS, L.detection_errors(gold, found, ["a", "a", "a", "a"], ["b", "a", "a", "a", "a", "a"])))
    assert counts == {"missing": 1, "hallucination": 1, "size_error": 0, "split": 2, "merge": 0, "overlap_pred": 0, "duplicate": 1, "misclassification": 1}
    assert L.detection_errors(gold, np.zeros((0, 4)), ["a"] * 4, [])[0] == 4 and L.detection_errors(np.zeros((0, 4)), found, [], ["a"] * 6)[1] == 6


def test_assigned_areas_against_a_raster():
    draw = np.random.RandomState(1)
    for _ in range(20):
        make = lambda n: np.array([[x, y, x + w, y + h] for x, y, w, h in zip(draw.randint(0, 20, n), draw.randint(0, 20, n), draw.randint(1, 12, n), draw.randint(1, 12, n))], float)
        gold, found = make(3), make(4)

        def mask(b):
            m = np.zeros((40, 40), bool)
            m[int(b[0]) : int(b[2]), int(b[1]) : int(b[3])] = True
            return m

        g, f = [mask(b) for b in gold], [mask(b) for b in found]
        of_gold, of_found, outside = L.assigned_areas(gold, found)
        own = [max(range(3), key=lambda i: (m & g[i]).sum()) if any((m & k).any() for k in g) else -1 for m in f]
        for i in range(3):
            times = sum((f[j].astype(int) for j in range(4) if own[j] == i), np.zeros((40, 40), int))
            assert of_gold[i] == pytest.approx(((g[i] & (times > 0)).sum() / g[i].sum(), (g[i] & (times > 1)).sum() / g[i].sum()))
        for j, (i, t) in enumerate(of_found):
            assert i == own[j]
            if i >= 0:
                others = np.any([g[k] for k in range(3) if k != i], axis=0)
                assert t == pytest.approx((f[j] & others).sum() / g[i].sum())
        assert outside == pytest.approx((np.any(f, axis=0) & ~np.any(g, axis=0)).sum())


def test_optimal_assignment_against_all_orders():
    from itertools import permutations

    draw = np.random.RandomState(3)
    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5)):
        cost = draw.rand(n, m)
        small, large = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        want = min(sum(c[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert sum(cost[i, j] for i, j in M.assignment(cost)) == pytest.approx(want)


def test_cells_and_grids():
    table = "<table><tr><td>A</td><td>b  C</td></tr><tr><td>1</td><td></td></tr></table>"
    assert G.cell_scores(table, table.upper()) == (1.0, 1.0, 1.0)
    less = "<table><tr><td>A</td><td>b c</td></tr></table>"
    assert G.cell_scores(table, less) == pytest.approx((1.0, 2 / 3, 0.8)) and G.cell_scores(None, None) == (1.0, 1.0, 1.0)
    assert G.teds(table, table) == 1.0 and 0 < G.teds(table, less) < 1
    grid = [[(0, 0, 1, 1), (1, 0, 2, 1)]]
    assert G.grits_location(grid, grid) == 1.0 and G.grits_location(grid, [[(5, 5, 6, 6)]]) == 0.0 and G.grits_location([], []) == 1.0

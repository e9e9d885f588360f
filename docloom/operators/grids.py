"""Metrics of table structure: tree edit distance (TEDS) and grid similarity (GriTS) of HTML tables, cell scores.

A pair is scored in one task, whole, in memory that grows with the product of both numbers of cells. Null or unreadable tables
have no cells: two of them score 1, one of them 0.
"""

from __future__ import annotations

import difflib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int]]] = []
        self.text: list[str] | None = None
        self.span = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            a = dict(attrs)
            number = lambda k: max(1, int(a.get(k) or 1)) if str(a.get(k) or "1").isdigit() else 1
            self.span, self.text = (number("rowspan"), number("colspan")), []
            if not self.rows:
                self.rows.append([])

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            self.rows[-1].append((" ".join("".join(self.text).split()), *self.span))
            self.text = None


def read_table(html: str | None) -> list[list[tuple[str, int, int]]]:
    """Rows of (text, rowspan, colspan)."""
    reader = _Reader()
    reader.feed(html or "")
    return [r for r in reader.rows if r]


def to_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Every grid place with (text, rows below the cell's first, columns right of it)."""
    filled: dict[tuple[int, int], tuple[str, int, int]] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, right in row:
            while (r, c) in filled:
                c += 1
            for i in range(down):
                for j in range(right):
                    filled[(r + i, c + j)] = (text, i, j)
            c += right
    if not filled:
        return []
    height, width = max(k[0] for k in filled) + 1, max(k[1] for k in filled) + 1
    return [[filled.get((r, c), ("", 0, 0)) for c in range(width)] for r in range(height)]


def _similar(a: str, b: str) -> float:
    """Twice the matching blocks over both lengths."""
    return 1.0 if not a and not b else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def _align(reward: np.ndarray) -> float:
    """Greatest sum of rewards along a monotone alignment."""
    n, m = reward.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + reward[i - 1, j - 1])
    return float(best[n, m])


def _align_all(x: list[list], y: list[list], cell) -> np.ndarray:
    """``_align`` of the cells of each row of one grid with each row of the other, all rows at once."""
    left, right = ({c: k for k, c in enumerate(dict.fromkeys(c for r in g for c in r))} for g in (x, y))
    table = np.array([[cell(a, b) for b in right] for a in left])
    p, q = (np.array([[names[c] for c in r] for r in g]) for names, g in ((left, x), (right, y)))
    before = np.zeros((q.shape[1] + 1, len(x), len(y)))
    for i in range(p.shape[1]):
        now = np.zeros_like(before)
        for j in range(q.shape[1]):
            now[j + 1] = np.maximum(np.maximum(before[j + 1], now[j]), before[j] + table[np.ix_(p[:, i], q[:, j])])
        before = now
    return before[-1]


def _in_order(few: list, many: list) -> bool:
    """Whether ``many`` holds all of ``few`` in their order."""
    rest = iter(many)
    return all(any(x == y for y in rest) for x in few)


def grits(gold: list[list], found: list[list], reward) -> float:
    """F1 of the factored two-dimensional alignment under any reward of two cells: rows are aligned by the best alignment of their cells, then columns."""
    if not gold or not found:
        return float(not gold and not found)
    cells = {}

    def cell(a, b) -> float:
        if (a, b) not in cells:
            cells[(a, b)] = reward(a, b)
        return cells[(a, b)]

    def upper(x: list[list], y: list[list]) -> float:
        if len({len(r) for r in x}) == len({len(r) for r in y}) == 1:
            return _align(_align_all(x, y, cell))
        rows = np.array([[_align(np.array([[cell(a, b) for b in r2] for a in r1])) for r2 in y] for r1 in x])
        return _align(rows)

    turn = lambda g: [list(c) for c in zip(*g)]
    total = min(upper(gold, found), upper(turn(gold), turn(found)))
    size = sum(map(len, gold)) + sum(map(len, found))
    return 2 * total / size


def grits_scores(gold: str | None, found: str | None) -> tuple[float, float]:
    """(topology, content)."""
    a, b = to_grid(read_table(gold)), to_grid(read_table(found))
    few, many = sorted((a, b), key=len)
    if few and len(few[0]) == len(many[0]) and _in_order(few, many):
        # every cell of the smaller grid meets its equal, and more than all cells of it cannot be met
        both = 2 * len(few) / (len(few) + len(many))
        return both, both
    top = grits([[(i, j) for _, i, j in r] for r in a], [[(i, j) for _, i, j in r] for r in b], lambda x, y: float(x == y))
    con = grits([[t for t, _, _ in r] for r in a], [[t for t, _, _ in r] for r in b], _similar)
    return top, con


def grits_location(gold: list[list[tuple]], found: list[list[tuple]]) -> float:
    """As above on grids of cell boxes (x0, y0, x1, y1); the reward is the intersection over the enclosing rectangle."""

    def reward(a: tuple, b: tuple) -> float:
        both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        hull = (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
        return both / hull if hull > 0 else 0.0

    return grits(gold, found, reward)


def _matched(reward: np.ndarray) -> list[tuple[int, int]]:
    """Places of the pairs of a best monotone alignment; of equal ones that with the earliest pairs."""
    n, m = reward.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = max(best[i + 1, j], best[i, j + 1], best[i + 1, j + 1] + reward[i, j])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if reward[i, j] > 0 and best[i, j] == best[i + 1, j + 1] + reward[i, j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            i += 1
        else:
            j += 1
    return pairs


def cell_scores(gold: str | None, found: str | None) -> tuple[float, float, float]:
    """Precision, recall and F1 of the texts of cells, after rows and columns are aligned by their structure.

    Texts are compared in lower case with single blanks; empty cells count nowhere. A side without filled cells scores 1.
    """
    a, b = to_grid(read_table(gold)), to_grid(read_table(found))
    same = lambda x, y: float(x[1:] == y[1:])
    rows = _matched(np.array([[_align(np.array([[same(p, q) for q in r2] for p in r1])) for r2 in b] for r1 in a]).reshape(len(a), len(b)))
    turn = lambda g: [list(c) for c in zip(*g)]
    ta, tb = turn(a), turn(b)
    columns = _matched(np.array([[_align(np.array([[same(p, q) for q in c2] for p in c1])) for c2 in tb] for c1 in ta]).reshape(len(ta), len(tb)))
    plain = lambda t: " ".join(t.lower().split())
    right = sum(plain(a[i][k][0]) == plain(b[j][m][0]) != "" for i, j in rows for k, m in columns)
    filled = lambda g: sum(plain(t) != "" for r in g for t, _, _ in r)
    p = right / filled(b) if filled(b) else 1.0
    r = right / filled(a) if filled(a) else 1.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


CELL_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])


@F.pandas_udf(CELL_SCORES)
def aligned_cells(gold: pd.Series, found: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cell_scores(a, b) for a, b in zip(gold, found)], columns=["precision", "recall", "f1"], dtype="float64")


def _tree(html: str | None) -> tuple[list[tuple[str, str]], list[int]]:
    """Labels in postorder and the leftmost leaf of each node: table, rows, cells."""
    labels, left = [], []
    first = 0
    for row in read_table(html):
        start = len(labels)
        for text, down, right in row:
            left.append(len(labels))
            labels.append((f"cell{down}x{right}", text))
        left.append(start if len(labels) > start else len(labels))
        labels.append(("row", ""))
    left.append(first)
    labels.append(("table", ""))
    return labels, left


def tree_distance(a, b, rename) -> float:
    """Zhang-Shasha edit distance of ordered trees."""
    (la, ka), (lb, kb) = a, b
    roots = lambda k: sorted({v: i for i, v in enumerate(k)}.values())
    dist, costs = [[0.0] * len(lb) for _ in la], {}

    def cost(p: int, q: int) -> float:
        pair = la[p], lb[q]
        if pair not in costs:
            costs[pair] = rename(*pair)
        return costs[pair]

    for i in roots(ka):
        for j in roots(kb):
            first, other = ka[i], kb[j]
            f = [[float(y) for y in range(j - other + 2)]]
            for p in range(first, i + 1):
                last, now, there, own = f[-1], [f[-1][0] + 1], dist[p], ka[p]
                f.append(now)
                for q in range(other, j + 1):
                    y = q - other
                    least = min(last[y + 1], now[y]) + 1
                    if own == first and kb[q] == other:
                        there[q] = least = min(least, last[y] + cost(p, q))
                    else:
                        least = min(least, f[own - first][kb[q] - other] + there[q])
                    now.append(least)
    return float(dist[-1][-1])


def teds(gold: str | None, found: str | None, structure_only: bool = False) -> float:
    """1 - edit distance over the larger number of nodes; renaming a cell costs what its text differs by."""
    a, b = _tree(gold), _tree(found)
    if a == b:
        return 1.0
    bare = (lambda r: [c[1:] for c in r]) if structure_only else list
    few, many = sorted(([bare(r) for r in read_table(t)] for t in (gold, found)), key=len)
    if _in_order(few, many):
        # rows to take out are all there is to do, and no fewer steps change the number of nodes by as many
        return 1 - abs(len(a[0]) - len(b[0])) / max(len(a[0]), len(b[0]))

    def rename(x, y) -> float:
        if x[0] != y[0]:
            return 1.0
        if structure_only or x[1] == y[1]:
            return 0.0
        return min(1.0, 1 - _similar(x[1], y[1])) if x[0].startswith("cell") else 0.0

    return 1 - tree_distance(a, b, rename) / max(len(a[0]), len(b[0]))


TABLE_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("teds", "teds_structure", "grits_top", "grits_con")])


@F.pandas_udf(TABLE_SCORES)
def table_scores(gold: pd.Series, found: pd.Series) -> pd.DataFrame:
    rows = [(teds(a, b), teds(a, b, True), *grits_scores(a, b)) for a, b in zip(gold, found)]
    return pd.DataFrame(rows, columns=["teds", "teds_structure", "grits_top", "grits_con"], dtype="float64")

"""Layout metrics over matched boxes: detection scores, average precision, coverage, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import sequences as S
from docloom.operators.matching import assignment, boxes_of, by_page, iou_matrix, page_lists

_BOX = ["x0", "y0", "x1", "y1"]


def detection_scores(gold: DataFrame, found: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and mean IoU pooled by ``by`` (columns of both sides and of the pairs)."""
    n = gold.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gold")).join(found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_found")), by, "full_outer")
    m = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"))
    s = n.join(m, by, "left").select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_gold", "n_found", "tp")], "mean_iou")
    precision, recall = F.col("tp") / F.nullif(F.col("n_found"), F.lit(0)), F.col("tp") / F.nullif(F.col("n_gold"), F.lit(0))
    return s.withColumns({"precision": F.coalesce(precision, F.lit(0.0)), "recall": F.coalesce(recall, F.lit(0.0))}).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def average_precision(detections: DataFrame, n_gold: DataFrame, label: str = "label") -> DataFrame:
    """Eleven-point interpolated precision by label from detections (label, score, is_tp) and gold counts (label, n)."""
    w = W.partitionBy(label).orderBy(F.desc("score"), "box_id").rowsBetween(W.unboundedPreceding, 0)
    run = detections.withColumns({"_tp": F.sum(F.col("is_tp").cast("long")).over(w), "_n": F.count(F.lit(1)).over(w)}).join(n_gold, label)
    points = run.select(label, (F.col("_tp") / F.col("n")).alias("recall"), (F.col("_tp") / F.col("_n")).alias("precision"))
    at = [F.max(F.when(F.col("recall") >= k / 10 - 1e-12, F.col("precision"))).alias(f"p{k}") for k in range(11)]
    best = points.groupBy(label).agg(*at)
    total = F.lit(0.0)
    for k in range(11):
        total = total + F.coalesce(F.col(f"p{k}"), F.lit(0.0))
    return n_gold.join(best, label, "left").select(label, (total / 11).alias("ap"))


def layer_scores(gold: DataFrame, found: DataFrame, page: list[str], names: dict[str, str] | None = None, margin: float = 0.0) -> DataFrame:
    """Precision, recall, F1, mean IoU and class accuracy over all pages, in one row, from optimal pairs of an IoU of 0.5.

    ``names`` gives canonical labels. With a ``margin`` both sides are first eroded by that share of their size, the tolerant variant.
    """
    from docloom.operators.matching import match_pages

    def ready(df: DataFrame) -> DataFrame:
        label = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("label")], F.col("label")) if names else F.col("label")
        w, h = (F.col("x1") - F.col("x0")) * margin, (F.col("y1") - F.col("y0")) * margin
        return df.select(*[F.col(c).alias(c) for c in page], F.col("box_id").alias("box_id"), label.alias("label"), (F.col("x0") + w).alias("x0"), (F.col("y0") + h).alias("y0"), (F.col("x1") - w).alias("x1"), (F.col("y1") - h).alias("y1"))

    a, b = ready(gold), ready(found)
    pairs = match_pages(a, b, page, 0.5, "optimal")
    labelled = pairs.join(a.select(*page, F.col("box_id").alias("gold_id"), F.col("label").alias("_g")), [*page, "gold_id"]).join(b.select(*page, F.col("box_id").alias("found_id"), F.col("label").alias("_f")), [*page, "found_id"])
    m = labelled.agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"), F.avg((F.col("_g") == F.col("_f")).cast("double")).alias("class_accuracy"))
    n = a.agg(F.count(F.lit(1)).alias("n_gold")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_found"))).crossJoin(m)  # one row each
    p, r = F.coalesce(F.col("tp") / F.nullif("n_found", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("n_gold", F.lit(0)), F.lit(0.0))
    return n.select(p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), F.coalesce("class_accuracy", F.lit(0.0)).alias("class_accuracy"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Matched pairs by reference and predicted label."""
    return pairs.groupBy("gold_label", "found_label").agg(F.count(F.lit(1)).alias("n"))


def reading_order(pairs: DataFrame, page: list[str]) -> DataFrame:
    """Kendall's tau of the order of matched elements, keyed by match, and the share of adjacent pairs in order."""
    tau = S.concordance(pairs, page, "gold_order", "found_order")
    w = W.partitionBy(*page).orderBy("gold_order")
    steps = pairs.withColumn("_ok", (F.col("found_order") > F.lag("found_order").over(w)).cast("double")).groupBy(*page).agg(F.avg("_ok").alias("adjacent_in_order"))
    return steps.join(tau, page, "left")


# Cells of a page that are held at once, and pairs of boxes whose shared areas are.
CELLS, PAIRS = 500_000, 1_000_000


def _solid(boxes: np.ndarray) -> np.ndarray:
    return (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])


def _edges(*sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    boxes = np.vstack([b[_solid(b)] for b in sides])
    return np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])


def _places(boxes: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last edge of each box in both directions; a box without area covers no cell."""
    there = _solid(boxes)
    x0, x1, y0, y1 = (np.where(there, np.searchsorted(e, boxes[:, k]), 0) for e, k in ((xs, 0), (xs, 2), (ys, 1), (ys, 3)))
    return x0, x1, y0, y1


def _strips(xs: np.ndarray, ys: np.ndarray, *sides: np.ndarray):
    """The cells between all edges, in strips of at most about CELLS: (first column, areas, how many boxes of each side cover each cell)."""
    wide, tall = len(xs) - 1, len(ys) - 1
    if wide < 1 or tall < 1:
        return
    step = max(1, CELLS // tall)
    places = [_places(b[_solid(b)], xs, ys) for b in sides]
    carried = [np.zeros(tall + 1, np.int32) for _ in sides]
    for at in range(0, wide, step):
        end = min(at + step, wide)
        counts = []
        for k, (x0, x1, y0, y1) in enumerate(places):
            change = np.zeros((end - at, tall + 1), np.int32)
            for x, sign in ((x0, 1), (x1, -1)):
                here = (x >= at) & (x < end)
                np.add.at(change, (x[here] - at, y0[here]), sign)
                np.add.at(change, (x[here] - at, y1[here]), -sign)
            change[0] += carried[k]
            np.cumsum(change, axis=0, out=change)
            carried[k] = change[-1].copy()
            counts.append(np.cumsum(change, axis=1)[:, :-1])
        yield at, np.diff(xs[at : end + 1])[:, None] * np.diff(ys)[None, :], counts


def _within(values: np.ndarray, at: int, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sum of the cells of a strip that lie in each box."""
    sums = np.zeros((values.shape[0] + 1, values.shape[1] + 1), values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(np.cumsum(values, axis=0), axis=1, out=sums[1:, 1:])
    x0, x1, y0, y1 = places
    a, b = np.clip(x0 - at, 0, len(values)), np.clip(x1 - at, 0, len(values))
    return sums[b, y1] - sums[a, y1] - sums[b, y0] + sums[a, y0]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area that each box of one side has in common with each of the other."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    return np.nan_to_num(np.clip(w, 0, None) * np.clip(h, 0, None))


def _single(gold: np.ndarray, found: np.ndarray) -> tuple[float, float, float]:
    """Of one box on each side, as on most pages: the area of both, of the gold and of the found box."""
    (a0, b0, a1, b1), (c0, d0, c1, d1) = gold[0].tolist(), found[0].tolist()
    w, h = min(a1, c1) - max(a0, c0), min(b1, d1) - max(b0, d0)
    size = lambda x, y: x * y if x > 0 and y > 0 else 0.0
    return size(w, h), size(a1 - a0, b1 - b0), size(c1 - c0, d1 - d0)


def _areas(boxes: np.ndarray) -> np.ndarray:
    return np.where(_solid(boxes), (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), 0.0)


def _owners(gold: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each found box the first gold box it covers most, how much of it, and whether it covers a part of another."""
    own, most, others = np.zeros(len(found), int), np.zeros(len(found)), np.zeros(len(found), bool)
    step = max(1, PAIRS // max(1, len(gold)))
    for at in range(0, len(found), step):
        part = _shared(found[at : at + step], gold)
        own[at : at + step], most[at : at + step] = part.argmax(axis=1), part.max(axis=1)
        others[at : at + step] = (part > 0).sum(axis=1) > 1
    return own, most, others


def coverage_areas(gold: np.ndarray, found: np.ndarray) -> tuple[float, float, float, float]:
    """(coverage, overlap, trespass, excess) as shares of the gold area, exact by coordinate compression.

    Coverage: gold area under some found box; overlap: area under several found boxes; trespass: area of a found box in gold
    boxes other than the one it covers most; excess: found area outside all gold boxes. The page is met in strips, so that memory
    does not grow with the product of its boxes and cells.
    """
    if not len(gold):
        return 0.0, 0.0, 0.0, 0.0
    if len(gold) == len(found) == 1:
        both, size, other = _single(gold, found)
        return both / (size or 1.0), 0.0, 0.0, (other - both) / (size or 1.0)
    xs, ys = _edges(gold, found)
    own, _, others = _owners(gold, found)
    places = _places(found, xs, ys)
    x0, x1, y0, y1 = places
    o0, o1, p0, p1 = (k[own] for k in _places(gold, xs, ys))
    own_cells = np.clip(np.minimum(x1, o1) - np.maximum(x0, o0), 0, None) * np.clip(np.minimum(y1, p1) - np.maximum(y0, p0), 0, None)
    in_gold, gold_cells, whole, covered, overlap, excess = np.zeros(len(found)), np.zeros(len(found), np.int64), 0.0, 0.0, 0.0, 0.0
    for at, cell, (g, f) in _strips(xs, ys, gold, found):
        any_gold = g > 0
        whole += float((cell * any_gold).sum())
        covered += float((cell * (any_gold & (f > 0))).sum())
        overlap += float((cell * (f > 1)).sum())
        excess += float((cell * (~any_gold & (f > 0))).sum())
        if others.any():
            in_gold += _within(cell * any_gold, at, places)
            gold_cells += _within(any_gold, at, places)
    # of the gold area in a box, what its own gold box does not hold; counted in cells too, so that none is none
    inside = _shared_pairs(found, gold[own]) if len(found) else in_gold
    trespass = float(np.where(others & (gold_cells > own_cells), in_gold - inside, 0.0).sum())
    whole = whole or 1.0
    return covered / whole, overlap / whole, trespass / whole, excess / whole


def _shared_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``_shared`` for boxes side by side."""
    return np.clip(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0, None) * np.clip(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0, None)


def _by_page(gold: DataFrame, found: DataFrame, page: list[str], schema: str, score) -> DataFrame:
    """Page columns and, by ``schema``, the values that ``score(boxes, boxes)`` gives for a page, if any."""
    kinds = ", ".join(f"{c} {gold.schema[c].dataType.simpleString()}" for c in page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for k, a, b, *_ in boxes_of(batch):
                if (values := score(a, b)) is not None:
                    kept.append(k)
                    rows.append(values)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(kept)) for n in range(len(page))] + [pa.array(v) for v in zip(*rows)], names=[*page, *(c.split()[0] for c in schema.split(", "))])

    return page_lists(gold, found, page).mapInArrow(run, f"{kinds}, {schema}")


def coverage(gold: DataFrame, found: DataFrame, page: list[str]) -> DataFrame:
    """E22, E40 by page."""
    return _by_page(gold, found, page, "coverage double, overlap double, trespass double, excess double", lambda a, b: coverage_areas(a, b) if len(a) else None)


def assigned_areas(gold: np.ndarray, found: np.ndarray) -> tuple[list[tuple[float, float]], list[tuple[int, float]], float]:
    """Each found box belongs to the gold box it covers most. For each gold box the shares that its own found boxes cover and
    cover twice; for each found box its gold box (-1: none) and what it takes of other gold boxes as a share of its own;
    and the found area outside all gold boxes. Cells are met in strips, as in ``coverage_areas``.
    """
    if len(gold) == len(found) == 1:
        both, size, other = _single(gold, found)
        return [(both / size, 0.0) if size else (np.nan, np.nan)], [(0 if both > 0 else -1, 0.0)], other - both
    size = _areas(gold)
    if not len(gold):
        return [], [(-1, 0.0)] * len(found), sum(float((cell * (f > 0)).sum()) for _, cell, (f,) in _strips(*_edges(found), found))
    xs, ys = _edges(gold, found)
    own, most, others = _owners(gold, found)
    own = np.where(most > 0, own, -1)
    places = _places(found, xs, ys)
    x0, x1, y0, y1 = places
    o0, o1, p0, p1 = (k[own] for k in _places(gold, xs, ys))
    # the part of a found box in its own gold box, empty where they do not meet
    a0, a1, b0, b1 = np.maximum(x0, o0), np.minimum(x1, o1), np.maximum(y0, p0), np.minimum(y1, p1)
    both = (own >= 0) & (a1 > a0) & (b1 > b0)
    in_own = tuple(np.where(both, k, 0) for k in (a0, a1, b0, b1))
    taken, outside = np.zeros(len(found)), 0.0
    for at, cell, (g, f) in _strips(xs, ys, gold, found):
        outside += float((cell * ((f > 0) & (g == 0))).sum())
        if others.any():
            # what lies in any gold box, less what lies in the own one alone
            taken += _within(cell * (g > 0), at, places) - _within(cell * (g == 1), at, in_own)
    of_gold: list[tuple[float, float]] = [(0.0, 0.0) if s else (np.nan, np.nan) for s in size]
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(gold) + 1))
    for i in np.unique(own[own >= 0]):
        k = gold[i]
        parts = found[order[starts[i] : starts[i + 1]]]
        parts = np.column_stack([np.maximum(parts[:, :2], k[:2]), np.minimum(parts[:, 2:], k[2:])])
        if len(parts) == 1:
            of_gold[i] = (float(_areas(parts)[0] / size[i]), 0.0)
            continue
        once = twice = 0.0
        for _, cell, (times,) in _strips(*_edges(parts), parts):
            once, twice = once + float((cell * (times > 0)).sum()), twice + float((cell * (times > 1)).sum())
        of_gold[i] = (once / size[i], twice / size[i])
    share = np.where((own >= 0) & others, np.clip(taken, 0, None), 0.0) / np.where(own >= 0, size[own], 1.0)
    return of_gold, [(int(i), float(t)) for i, t in zip(own, share)], outside


def covered_area(boxes: np.ndarray) -> float:
    """Area under some box."""
    return sum(float((cell * (n > 0)).sum()) for _, cell, (n,) in _strips(*_edges(boxes), boxes))


def assigned_coverage(gold: DataFrame, found: DataFrame, page: list[str], width: float, height: float) -> DataFrame:
    """E23 by page: means of coverage, overlap and trespass, and excess as a share of the area outside gold boxes.

    A page without gold or without found boxes gives no row.
    """
    def score(x: np.ndarray, y: np.ndarray) -> tuple | None:
        if not len(x) or not len(y):
            return None
        of_gold, of_found, outside = assigned_areas(x, y)
        kept = [v for v in of_gold if not np.isnan(v[0])]
        trespass = [t for i, t in of_found if i >= 0]
        free = width * height - (covered_area(x) if len(x) > 1 else float(_areas(x)[0]))
        mean = lambda v: float(np.mean(v)) if len(v) else 0.0
        return mean([c for c, _ in kept]), mean([o for _, o in kept]), mean(trespass), outside / free if free > 0 else 0.0, len(trespass)

    return _by_page(gold, found, page, "coverage double, overlap double, trespass double, excess double, n_assigned long", score)


def class_areas(gold: DataFrame, found: DataFrame, page: list[str]) -> DataFrame:
    """Rows (what, gold_label, found_label, value): coverage and overlap of each gold box, trespass of each assigned found box.

    Aggregate by gold_label for the scores of a class, and count trespass over 0.05 by both labels for the pairs of classes.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, a, b, labels, others, _ in boxes_of(batch):
                if len(a) and len(b):
                    of_gold, of_found, _ = assigned_areas(a, b)
                    for k, (c, o) in zip(labels, of_gold):
                        if not np.isnan(c):
                            rows += [("coverage", k, None, float(c)), ("overlap", k, None, float(o))]
                    rows += [("trespass", labels[i], k, t) for k, (i, t) in zip(others, of_found) if i >= 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)], names=["what", "gold_label", "found_label", "value"])

    return page_lists(gold, found, page).mapInArrow(run, "what string, gold_label string, found_label string, value double")


ERRORS = ["missing", "hallucination", "size_error", "split", "merge", "overlap_pred", "duplicate", "misclassification"]


def detection_errors(gold: np.ndarray, found: np.ndarray, gold_labels: list, found_labels: list, touch: float = 0.10, fit: float = 0.50, twin: float = 0.85) -> list[int]:
    """Counts of ERRORS on one page.

    Boxes touch from an IoU of ``touch``. Missing and hallucination touch nothing; duplicates and overlaps are pairs of found
    boxes from ``twin`` and between both; of optimal pairs that touch, those under ``fit`` are size errors and the others with
    different labels misclassifications. A split is a gold box whose pair and unpaired touching found boxes are more than one, a
    merge the same the other way round.
    """
    if not len(gold) or not len(found):
        return [len(gold) if not len(found) else 0, len(found) if not len(gold) else 0, 0, 0, 0, 0, 0, 0]
    m, own = iou_matrix(gold, found), iou_matrix(found, found)[np.triu_indices(len(found), 1)]
    pairs = [(i, j) for i, j in assignment(1.0 - m) if m[i, j] >= touch]
    of_gold, of_found = np.zeros(len(gold), int), np.zeros(len(found), int)
    near = m >= touch
    for i, j in pairs:
        of_gold[i] += 1
        of_found[j] += 1
    free_found, free_gold = of_found == 0, of_gold == 0
    splits = of_gold + (near & free_found[None, :]).sum(axis=1)
    merges = of_found + (near & free_gold[:, None]).sum(axis=0)
    size = sum(m[i, j] < fit for i, j in pairs)
    wrong = sum(m[i, j] >= fit and gold_labels[i] != found_labels[j] for i, j in pairs)
    return [int((~near).all(axis=1).sum()), int((~near).all(axis=0).sum()), int(size), int((splits > 1).sum()), int((merges > 1).sum()), int(((own >= touch) & (own < twin)).sum()), int((own >= twin).sum()), int(wrong)]


def page_errors(gold: DataFrame, found: DataFrame, page: list[str]) -> DataFrame:
    """E24 by page, with the number of found boxes; boxes have x0, y0, x1, y1, box_id and label."""
    schema = ", ".join(f"{c} {gold.schema[c].dataType.simpleString()}" for c in page) + "".join(f", {e} int" for e in ERRORS) + ", n_found int"

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("box_id"), b.sort_values("box_id")
        counts = detection_errors(a[_BOX].to_numpy(float), b[_BOX].to_numpy(float), a["label"].tolist(), b["label"].tolist())
        return pd.DataFrame([(*key, *counts, len(b))], columns=[*page, *ERRORS, "n_found"])

    return by_page(gold, found, page).applyInPandas(run, schema)


def error_rates(pages: DataFrame) -> DataFrame:
    """Errors of each kind a detection, over all pages: (error, n, rate)."""
    total = pages.agg(*[F.sum(e).alias(e) for e in ERRORS], F.sum("n_found").alias("n_found"))
    long = total.unpivot("n_found", ERRORS, "error", "n")
    return long.select("error", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("n") / F.nullif(F.col("n_found"), F.lit(0)), F.lit(0.0)).alias("rate"))


# Ranges of the area of a box in the published protocol.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
THRESHOLDS = [0.5 + 0.05 * k for k in range(10)]


def protocol_matches(gold: np.ndarray, found: np.ndarray, score: np.ndarray, least: float, low: float, high: float, most: int = 100) -> tuple[list[tuple[float, bool, bool]], int]:
    """Of one image and class: (score, hit, ignored) of the best ``most`` found boxes, and the number of gold boxes that count.

    In order of score a found box takes the free gold box of the greatest IoU of at least ``least``, one that counts before one
    outside the range of areas. Found boxes on a gold box that does not count, or free and outside the range, are ignored.
    """
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    counts = (size(gold) >= low) & (size(gold) <= high) if len(gold) else np.zeros(0, bool)
    order = np.argsort(-score, kind="stable")[:most]
    m, free, out = iou_matrix(gold, found), np.ones(len(gold), bool), []
    for j in order:
        hit = None
        for group in (counts, ~counts):
            able = np.flatnonzero(free & group & (m[:, j] >= least - 1e-10)) if len(gold) else np.zeros(0, int)
            if len(able):
                hit = int(able[m[able, j].argmax()])
                break
        if hit is not None:
            free[hit] = False
            out.append((float(score[j]), bool(counts[hit]), not counts[hit]))
        else:
            area = float(size(found[[j]])[0])
            out.append((float(score[j]), False, not low <= area <= high))
    return out, int(counts.sum())


def protocol_hits(gold: np.ndarray, found: np.ndarray, score: np.ndarray, thresholds: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``protocol_matches`` for all thresholds and ranges of areas at once, given side by side: (order of the found boxes, hits and
    misses that count, by box and place, number of gold boxes that count by place).
    """
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    order = np.argsort(-score, kind="stable")[:most]
    area = size(found[order])
    outside = (area[:, None] < low) | (area[:, None] > high)
    if not len(gold):
        return order, np.zeros_like(outside), ~outside, np.zeros(len(low), int)
    counts = (size(gold) >= low[:, None]) & (size(gold) <= high[:, None])
    m = iou_matrix(gold, found[order])
    hits, misses = np.zeros_like(outside), ~outside
    free, place, least = np.ones((len(low), len(gold)), bool), np.arange(len(low)), thresholds.min() - 1e-10
    for j in range(len(order)):
        near = np.flatnonzero(m[:, j] >= least)
        if not len(near):
            continue
        iou = m[near, j]
        able = free[:, near] & (iou >= thresholds[:, None] - 1e-10)
        first = able & counts[:, near]
        taken, counted = able.any(axis=1), first.any(axis=1)
        best = near[np.where(np.where(counted[:, None], first, able), iou, -1.0).argmax(axis=1)]
        free[place[taken], best[taken]] = False
        hits[j] = taken & counted
        misses[j] &= ~taken
    return order, hits, misses, counts.sum(axis=1)


def detection_protocol(gold: DataFrame, found: DataFrame, page: list[str], thresholds: list[float] = THRESHOLDS, areas: dict[str, tuple[float, float]] = AREAS) -> DataFrame:
    """Average precision at 101 recalls and recall at 100 boxes, by label, threshold and range of areas, after the published
    protocol. Average over labels and thresholds for the headline figures.

    Images and labels are matched in groups, for all thresholds and ranges together, and summed by score where they are matched; the
    curves are cumulated over distinct scores (six decimals), so that a label with most of the boxes is summed before it reaches
    one task. A label without gold boxes in a range gives no row.
    """
    keys = [*page, "label"]
    places = [(name, t, low, high) for name, (low, high) in areas.items() for t in thresholds]
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["label", "area", "threshold", "score", "tp", "fp", "n_gold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low, high = (np.array([p[k] for p in places]) for k in (1, 2, 3))
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(label, places[k][0], round(places[k][1], 4), score, *map(int, v[:, k])) for (label, score), v in sums.items() for k in range(len(places)) if score is None or v[:, k].any()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)], names=names)

        def add(label, score, row: int, values: np.ndarray) -> None:
            if (label, score) not in sums:
                sums[label, score] = np.zeros((3, len(places)), np.int64)
            sums[label, score][row] += values

        for batch in batches:
            labels = batch.column(len(page)).to_pylist()
            for k, a, b, _, _, score in boxes_of(batch):
                order, hits, misses, n = protocol_hits(a, b, score, at, low, high)
                add(labels[k], None, 2, n)
                for j, h, f in zip(order.tolist(), hits, misses):
                    s = round(float(score[j]), 6)
                    add(labels[k], s, 0, h)
                    add(labels[k], s, 1, f)
                if len(sums) > 5_000:
                    yield out()
        if sums:
            yield out()

    schema = "label string, area string, threshold double, score double, tp long, fp long, n_gold long"
    rows = page_lists(gold, found, keys).mapInArrow(run, schema)
    curve = ["label", "area", "threshold"]
    steps = rows.groupBy(*curve, "score").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_gold").alias("n_gold"))
    gold_n = steps.groupBy(*curve).agg(F.sum("n_gold").alias("n")).where("n > 0")
    w = W.partitionBy(*curve).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    run_ = steps.where("score is not null").withColumns({"_tp": F.sum("tp").over(w), "_fp": F.sum("fp").over(w)}).join(gold_n, curve)
    points = run_.select(*curve, (F.col("_tp") / F.col("n")).alias("recall"), (F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("precision"))
    envelope = F.max("precision").over(W.partitionBy(*curve).orderBy(F.desc("recall"), F.desc("precision")).rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.lag("recall").over(W.partitionBy(*curve).orderBy("recall", F.desc("precision"))), F.lit(-1.0))
    # each of the 101 recalls takes the precision of the first point that reaches it
    reached = (F.floor(F.col("recall") * 100 + 1e-9) - F.floor(F.col("_before") * 100 + 1e-9)).cast("long")
    parts = points.withColumns({"_p": envelope, "_before": before}).withColumn("_k", F.when(F.col("_before") < 0, F.floor(F.col("recall") * 100 + 1e-9).cast("long") + 1).otherwise(reached))
    ap = parts.groupBy(*curve).agg((F.sum(F.col("_p") * F.col("_k")) / 101).alias("ap"), F.max("recall").alias("ar"))
    return gold_n.join(ap, curve, "left").select(*curve, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"), F.col("n").alias("n_gold"))

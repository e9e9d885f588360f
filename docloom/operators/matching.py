"""Matching of boxes on a page: greedy and optimal assignment, suppression of duplicates, running-mean bands.

These depend on the order of earlier choices and run as grouped maps; a group is one page, never a key that grows with the
data. Empty sides give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    whole = size(a)[:, None] + size(b)[None, :] - both
    return np.divide(both, whole, out=np.zeros_like(both), where=whole > 0)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Kuhn-Munkres with potentials: pairs of rows and columns of least total cost, as many as the smaller side has."""
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assignment(cost.T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        j = 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = owner[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, least[1:])
            k = int(free.argmin()) + 1
            delta = free[k - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if not owner[j]:
                break
        while j:
            before = way[j]
            owner[j] = owner[before]
            j = before
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def optimal_pairs(gold: np.ndarray, found: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """One-to-one pairs of greatest total IoU; those under ``least`` are dropped."""
    m = iou_matrix(gold, found)
    return [(i, j, float(m[i, j])) for i, j in assignment(1.0 - m) if m[i, j] >= least]


def greedy_pairs(gold: np.ndarray, found: np.ndarray, gold_labels, found_labels, least: float) -> list[tuple[int, int, float]]:
    """Each gold box in turn takes the free box of its label with the greatest IoU of at least ``least``."""
    m, free, out = iou_matrix(gold, found), set(range(len(found))), []
    for i in range(len(gold)):
        best = max((j for j in free if found_labels[j] == gold_labels[i] and m[i, j] >= least), key=lambda j: (m[i, j], -j), default=None)
        if best is not None:
            free.discard(best)
            out.append((i, best, float(m[i, best])))
    return out


def suppress(boxes: np.ndarray, confidence: np.ndarray, most: float = 0.85) -> list[int]:
    """Places of the boxes kept: in order of confidence, those that overlap no kept box by more than ``most``."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda k: (-confidence[k], k)):
        if not kept or iou_matrix(boxes[[i]], boxes[kept]).max() <= most:
            kept.append(i)
    return sorted(kept)


_BOX = ["x0", "y0", "x1", "y1"]


def by_page(gold: DataFrame, found: DataFrame, page: list[str]):
    """Both sides grouped by page; the columns of ``found`` are made its own, as both may come from one table."""
    own = found.select(*[F.col(c).alias(c) for c in found.columns])
    return gold.groupBy(*page).cogroup(own.groupBy(*page))


def page_lists(gold: DataFrame, found: DataFrame, page: list[str]) -> DataFrame:
    """One row a page with the boxes of both sides in ``boxes``, gold first, by id: of side, box_id, label, x0, y0, x1, y1 and score.

    Small pages are many: they are gathered by the engine and met in batches with ``boxes_of``, not as a group each.
    """
    def side(df: DataFrame, n: int) -> DataFrame:
        score = F.col("score").cast("double") if "score" in df.columns and n else F.lit(None).cast("double")
        label = F.col("label").cast("string") if "label" in df.columns else F.lit(None).cast("string")
        return df.select(*[F.col(c).alias(c) for c in page], F.struct(F.lit(n).alias("side"), F.col("box_id").alias("box_id"), label.alias("label"), *[F.col(c).cast("double").alias(c) for c in _BOX], score.alias("score")).alias("b"))

    return side(gold, 0).unionByName(side(found, 1)).groupBy(*page).agg(F.sort_array(F.collect_list("b")).alias("boxes"))


def boxes_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list, list, np.ndarray]]:
    """For each row of ``page_lists``: its number, the boxes and labels of both sides, and the scores of the found ones."""
    lists = batch.column(batch.schema.get_field_index("boxes"))
    ends, flat = lists.offsets.to_numpy(), lists.values
    side, score = flat.field("side").to_numpy(zero_copy_only=False), flat.field("score").to_numpy(zero_copy_only=False)
    boxes = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in _BOX])
    labels = flat.field("label").to_pylist()
    later = np.concatenate([[0], np.cumsum(side)])
    for k in range(batch.num_rows):
        a, b = int(ends[k]), int(ends[k + 1])
        cut = b - int(later[b] - later[a])
        yield k, boxes[a:cut], boxes[cut:b], labels[a:cut], labels[cut:b], score[cut:b]


def match_pages(gold: DataFrame, found: DataFrame, page: list[str], least: float = 0.5, method: str = "optimal") -> DataFrame:
    """Pairs (page keys, gold_id, found_id, iou) of boxes with columns x0, y0, x1, y1, box_id and label."""
    schema = ", ".join(f"{c} {gold.schema[c].dataType.simpleString()}" for c in page) + ", gold_id string, found_id string, iou double"

    def match(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("box_id").reset_index(drop=True), b.sort_values("box_id").reset_index(drop=True)
        x, y = a[_BOX].to_numpy(float), b[_BOX].to_numpy(float)
        pairs = optimal_pairs(x, y, least) if method == "optimal" else greedy_pairs(x, y, a["label"].tolist(), b["label"].tolist(), least)
        rows = [(*key, str(a["box_id"][i]), str(b["box_id"][j]), s) for i, j, s in pairs]
        return pd.DataFrame(rows, columns=[*page, "gold_id", "found_id", "iou"])

    return by_page(gold, found, page).applyInPandas(match, schema)


def reading_bands(df: DataFrame, page: list[str], band: float = 10.0) -> DataFrame:
    """Lines of boxes whose vertical centre lies within ``band`` of the line's running mean; adds line_no and reading_order."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", line_no int, reading_order int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["_c", "x0", "box_id"], kind="stable")
        lines, mean, n = [], 0.0, 0
        for c in pdf["_c"]:
            if not lines or abs(c - mean) > band:
                lines.append(lines[-1] + 1 if lines else 0)
                mean, n = c, 1
            else:
                lines.append(lines[-1])
                n += 1
                mean += (c - mean) / n
        pdf = pdf.assign(line_no=lines).sort_values(["line_no", "x0", "box_id"], kind="stable").drop(columns="_c")
        return pdf.assign(reading_order=range(1, len(pdf) + 1)).astype({"line_no": "int32", "reading_order": "int32"})

    return df.groupBy(*page).applyInPandas(run, schema)


def deduplicate_boxes(df: DataFrame, page: list[str], most: float = 0.85) -> DataFrame:
    """G9 on pages with columns x0, y0, x1, y1, confidence and box_id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id").reset_index(drop=True)
        return pdf.iloc[suppress(pdf[_BOX].to_numpy(float), pdf["confidence"].to_numpy(float), most)]

    return df.groupBy(*page).applyInPandas(run, df.schema)

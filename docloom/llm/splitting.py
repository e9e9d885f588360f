"""Splitting oversized texts at natural boundaries by lexical cohesion.

Words: each character of a script without blanks counts as one, the rest is counted by white space. Natural boundaries are
line breaks and sentence ends. At each boundary the words of the blocks on both sides are compared; a valley of that
similarity marks a change of topic. Each piece ends at the deepest valley inside its size window, and the next piece
starts ``overlap`` words before that end.

Texts of at most ``limit`` words, null and empty texts give no rows; repeated rows of a key and text are cut once. Where a
stretch without a boundary does not fit, the piece is cut at the limit. Whole texts are cut, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[฀-๿぀-ヿ一-鿿]|[^\s฀-๿぀-ヿ一-鿿]+")
BOUNDARY = re.compile(r"\n|[.!?।](?=\s|$)|[。！？]")


def _similarities(words: list[str], places: list[int], block: int) -> list[float]:
    """Cosine of the word counts of the blocks before and after each place; words of one or two Latin letters are left out."""
    terms = [w if len(w) > 2 or w >= "฀" else "" for w in (x.lower().strip(".,;:!?()\"'|") for x in words)]
    out = []
    left: Counter = Counter()
    right: Counter = Counter()
    a0 = a1 = b1 = 0
    dot = 0.0

    def move(counter: Counter, other: Counter, term: str, step: int) -> float:
        if not term:
            return 0.0
        counter[term] += step
        return step * other[term]

    for place in places:
        while a1 < place:  # words that pass from the right block to the left one
            if a1 < b1:
                dot += move(right, left, terms[a1], -1)
            dot += move(left, right, terms[a1], 1)
            a1 += 1
        b1 = max(b1, a1)
        while b1 < min(len(terms), place + block):
            dot += move(right, left, terms[b1], 1)
            b1 += 1
        while a0 < place - block:
            dot += move(left, right, terms[a0], -1)
            a0 += 1
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        out.append(dot / norm if norm else 0.0)
    return out


def _depths(similarities: list[float]) -> list[float]:
    """Depth of each valley: how far similarity rises to the nearest peak on either side."""
    n = len(similarities)
    left, right = [0.0] * n, [0.0] * n
    for order, rise in ((range(n), left), (range(n - 1, -1, -1), right)):
        peak, previous = 0.0, None
        for i in order:
            s = similarities[i]
            peak = s if previous is None or s > previous else max(peak, s)
            if previous is not None and s > previous:
                peak = s
            rise[i] = peak - s
            previous = s
    return [a + b for a, b in zip(left, right)]


def pieces(text: str | None, limit: int = 400, overlap: int = 40, block: int = 60) -> tuple[int, list[tuple[int, int, int, bool]]]:
    """Longest stretch of words between boundaries, and (start, end, words, forced end) of each piece in code points."""
    if not text or len(text) <= limit:
        return 0, []
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    total = len(found)
    if total <= limit:
        return 0, []
    starts = [a for a, _ in found]
    places = sorted({bisect_left(starts, m.end()) for m in BOUNDARY.finditer(text)} - {0, total})
    edges = [0, *places, total]
    stretch = max(b - a for a, b in zip(edges, edges[1:]))
    depths = _depths(_similarities([text[a:b] for a, b in found], places, block)) if places else []
    out = []
    first = 0
    while True:
        if total - first <= limit:
            out.append((first, total, False))
            break
        floor, ceiling = first + max(overlap + 1, limit // 2), first + limit
        lo, hi = bisect_left(places, floor), bisect_right(places, ceiling)
        if lo == hi:  # none in the window: the last boundary that makes headway
            lo = bisect_left(places, first + overlap + 1)
            lo = max(lo, hi - 1)
        if lo < hi:
            best = max(range(lo, hi), key=lambda k: (depths[k], k))
            cut, forced = places[best], False
        else:
            cut, forced = ceiling, True
        out.append((first, cut, forced))
        first = cut - overlap
    return stretch, [(starts[a], found[b - 1][1], b - a, forced) for a, b, forced in out]


def split_oversized(texts: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = 400, overlap: int = 40) -> DataFrame:
    """Rows (key, piece_no, n_pieces, start_pos, n_chars, n_words, forced_end, boundary, piece) of every text over the limit.

    boundary: ``forced`` if some stretch between boundaries is over the limit, else ``natural``.
    """
    kind = texts.schema[key].dataType.simpleString()
    names = [key, "piece_no", "n_pieces", "start_pos", "n_chars", "n_words", "forced_end", "boundary", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stretch, cut = pieces(t, limit, overlap)
                boundary = "forced" if stretch > limit else "natural"
                rows += [(k, i, len(cut), a, b - a, n, forced, boundary, t[a:b]) for i, (a, b, n, forced) in enumerate(cut)]
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    # a text has at most as many words as characters
    long = texts.where(F.length(text) > limit).select(key, text).dropDuplicates([key, text])
    return long.mapInArrow(run, f"{key} {kind}, piece_no int, n_pieces int, start_pos long, n_chars long, n_words int, forced_end boolean, boundary string, piece string")

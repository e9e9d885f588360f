"""Evaluation passages inside a training corpus.

Every window of ``width`` words of a document and of an item is embedded by the CGK random walk (Chakraborty, Goldenberg,
Koucky 2016), which turns edit distance over words into Hamming distance. Repeated bit sampling over several walks gives
LSH keys, as many as a simulation needs for the wanted recall; windows that share a key are verified by their exact edit
distance over words.

The windows of the items go to the workers in blocks of at most BLOCK windows, and each block is searched in all
documents where they are read: only verified pairs leave a worker, one for each document and item.

Words are runs of letters and digits after NFKC and case folding, soft hyphens removed. Null texts have no words. A text
or item with fewer than ``width`` words has no window. Repeated rows give one result row. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WORD = re.compile(r"[^\W_]+")
#: Item windows sent to the workers at a time; with 16 repetitions about 0.5 kB each.
BLOCK = 100_000
STRETCH = 2  # steps of the walk for each word
DRAWS = 3  # samples of places drawn from each walk
FILTER_BITS = 20
TOKENS = 30_000  # of documents embedded at a time, so that the arrays stay in the cache


def words(text: str | None) -> list[str]:
    if not text:
        return []
    folded = unicodedata.normalize("NFKC", text).casefold()
    return WORD.findall(folded.replace("\xad", "") if "\xad" in folded else folded)


class _Hashes(dict):
    """64-bit hash of each word, kept while a worker lives; emptied when it has grown."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


Walk = tuple[int, list[dict[int, int]]]


def _plan(width: int, sampled: int, repetitions: int, seed: int = 7) -> list[Walk]:
    """Walks, each an odd multiplier with DRAWS samples of places of the embedding, and an odd multiplier for each place."""
    draw = np.random.RandomState(seed)
    plan: list[Walk] = []
    for left in range(repetitions, 0, -DRAWS):
        walk = (int(draw.randint(1, 2**31)) << 33) | (int(draw.randint(1, 2**31)) << 1) | 1
        samples = []
        for _ in range(DRAWS):
            places = np.sort(draw.choice(STRETCH * width, size=min(sampled, STRETCH * width), replace=False))
            samples.append({int(p): int(draw.randint(1, 2**31)) * 2 + 1 for p in places})
        plan.append((walk, samples[:left]))
    return plan


def window_keys(tokens: np.ndarray, width: int, plan: list[Walk]) -> list[np.ndarray]:
    """LSH keys, one array for each repetition, of all windows of ``width`` tokens; a walk stays inside its window."""
    n = len(tokens) - width + 1
    if n <= 0:
        return [np.empty(0, np.uint64) for _, samples in plan for _ in samples]
    first = np.arange(n, dtype=np.int32)
    limit = first + np.int32(width - 1)
    keys: list[np.ndarray] = []
    for walk, samples in plan:
        mixed = tokens * np.uint64(walk)
        mixed ^= mixed >> np.uint64(32)
        steps = mixed.astype(np.uint32)  # one bit for each step
        at = first.copy()
        own = [np.full(n, len(keys) + k, np.uint64) for k in range(1, len(samples) + 1)]
        last = max(map(max, samples))
        for step in range(last + 1):
            for key, places in zip(own, samples):
                if step in places:
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key += tokens.take(at) * np.uint64(places[step])
            if step < last:
                bit = steps.take(at)
                bit >>= np.uint32(step % 32)
                bit &= np.uint32(1)
                at += bit.view(np.int32)
                np.minimum(at, limit, out=at)
        for key in own:
            key ^= key >> np.uint64(29)
        keys += own
    return keys


def _edited(a: np.ndarray, edits: int, draw: np.random.RandomState) -> np.ndarray:
    """A window that many word edits away: a substitution is one, a word put in or left out is two, as the window keeps its width."""
    b, left = a, edits
    while left > 0:
        kind, at, fresh = draw.randint(3) if left > 1 else 0, draw.randint(len(a)), draw.randint(0, 2**63, 1).astype(np.uint64)
        b = np.concatenate([b[:at], fresh, b[at + 1 :]] if kind == 0 else [b[:at], b[at + 1 :], fresh] if kind == 1 else [b[:at], fresh, b[at:]])[: len(a)]
        left -= 1 if kind == 0 else 2
    return b


def bands(width: int, max_edits: int, recall: float, sampled: int, most: int = 128, trials: int = 600) -> int:
    """Repetitions so that windows ``max_edits`` apart share a key with at least the wanted probability, by simulation.

    Equal windows always share their keys. An error tells that ``most`` repetitions miss the wanted recall.
    """
    if not max_edits:
        return 1
    draw = np.random.RandomState(11)
    plan = _plan(width, sampled, most)
    left = [draw.randint(0, 2**63, width).astype(np.uint64) for _ in range(trials)]
    right = [_edited(a, max_edits, draw) for a in left]
    x, y = (window_keys(np.concatenate(side), width, plan) for side in (left, right))
    reached = np.logical_or.accumulate([p[::width] == q[::width] for p, q in zip(x, y)], axis=0).mean(axis=1)
    enough = np.flatnonzero(reached >= recall)
    if not len(enough):
        raise ValueError(f"{most} repetitions of {sampled} places reach a recall of {reached[-1]:.3f} at {max_edits} edits, not {recall}; sample fewer places")
    return int(enough[0]) + 1


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance over words, or most + 1 if it is larger; only the diagonals within ``most`` are computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        fresh = [far] * (len(b) + 1)
        if i <= most:
            fresh[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            fresh[j] = min(row[j] + 1, fresh[j - 1] + 1, row[j - 1] + (x != b[j - 1]), far)
        if min(fresh) >= far:
            return far
        row = fresh
    return row[-1]


def distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``edit_distance`` of the rows of two arrays of hashed words of one width."""
    n, width = a.shape
    far = np.int8(most + 1)
    row = np.minimum(np.arange(width + 1), far).astype(np.int8)[:, None].repeat(n, axis=1)
    for i in range(1, width + 1):
        fresh = np.full((width + 1, n), far, np.int8)
        fresh[0] = min(i, far)
        for j in range(max(1, i - most), min(width, i + most) + 1):
            np.minimum(row[j - 1] + (a[:, i - 1] != b[:, j - 1]), np.minimum(row[j], fresh[j - 1]) + np.int8(1), out=fresh[j], casting="unsafe")
        row = np.minimum(fresh, far)
    return row[width]


def _hashed(texts: list[list[str]], hashes: _Hashes) -> np.ndarray:
    flat = [w for own in texts for w in own]
    return np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))


class _Index:
    """Windows of a block of items by their keys, one sorted array for each repetition behind a bit filter."""

    def __init__(self, windows: list[str], width: int, plan: list[Walk]):
        self.windows = [w.split(" ") for w in windows]
        tokens = _hashed(self.windows, _Hashes())
        self.tokens = tokens.reshape(-1, width)
        self.keys, self.order, self.filters = [], [], []
        for key in window_keys(tokens, width, plan):
            own = key[::width]  # windows that run from one item window into the next are left out
            order = np.argsort(own, kind="stable")
            self.keys.append(own[order])
            self.order.append(order)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters.append(bits)

    def candidates(self, tokens: np.ndarray, valid: np.ndarray, width: int, plan: list[Walk]) -> np.ndarray:
        """Distinct (window of the tokens, window of the items) that share a key, as one sorted array of pairs."""
        found = []
        for k, key in enumerate(window_keys(tokens, width, plan)):
            some = np.flatnonzero(valid & self.filters[k][(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(self.keys[k], key[some]), np.searchsorted(self.keys[k], key[some], side="right")
            times = high - low
            if times.any():
                left = np.repeat(some, times)
                right = self.order[k][np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                found.append(left * len(self.windows) + right)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _search(key: str, item: str, item_type: pa.DataType, index: _Index, owners: list[list], width: int, plan: list[Walk], max_edits: int):
    """mapInArrow function: (key, text) to (key, item, edits), one row for each pair of a document and an item."""

    def look(ids: list, texts: list[list[str]], hashes: _Hashes) -> dict[tuple, int]:
        tokens = _hashed(texts, hashes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(tokens))
        pairs = index.candidates(tokens, left[: len(tokens) - width + 1] >= width, width, plan)
        at, window = np.divmod(pairs, max(1, len(index.windows)))
        best: dict[tuple, int] = {}
        if not len(at):
            return best
        given, wanted = tokens[at[:, None] + np.arange(width)], index.tokens[window]
        apart = (given != wanted).sum(axis=1)
        # as many other words as edits allow: that is the distance; only the rest can need words put in or left out
        rest = np.flatnonzero(apart > max_edits) if max_edits > 1 else np.empty(0, np.int64)
        apart[rest] = distances(given[rest], wanted[rest], max_edits)
        near = np.flatnonzero(apart <= max_edits)
        doc = np.searchsorted(ends, at[near], side="right")
        for p, d, w, n in sorted(zip(at[near].tolist(), doc.tolist(), window[near].tolist(), apart[near].tolist()), key=lambda x: x[3]):
            for owner in owners[w]:
                pair = (ids[d], owner)
                if n < best.get(pair, max_edits + 1):
                    # the words themselves decide, not their hashes
                    start = p - int(ends[d] - sizes[d])
                    exact = edit_distance(texts[d][start : start + width], index.windows[w], max_edits)
                    if exact <= max_edits:
                        best[pair] = min(exact, best.get(pair, exact))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            best: dict[tuple, int] = {}
            ids, texts, held = [], [], 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                if len(own) >= width:
                    ids.append(k)
                    texts.append(own)
                    held += len(own)
                if held > TOKENS:
                    for pair, n in look(ids, texts, hashes).items():
                        best[pair] = min(n, best.get(pair, n))
                    ids, texts, held = [], [], 0
            if texts:
                for pair, n in look(ids, texts, hashes).items():
                    best[pair] = min(n, best.get(pair, n))
            columns = list(zip(*((k, i, n) for (k, i), n in best.items()))) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], item_type), pa.array(columns[2], pa.int32())], names=[key, item, "edits"])

    return run


def item_windows(items: DataFrame, item_key: str, item_texts: tuple[str, ...], width: int) -> DataFrame:
    """Distinct windows of the items (``window``: its words joined by blanks) with the items that hold them."""
    parts = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("_item"), F.explode(F.array(*[F.col(c) for c in item_texts])).alias("_part")).where("_part is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                rows += [(k, " ".join(own[p : p + width])) for p in range(len(own) - width + 1)]
            columns = list(zip(*rows)) if rows else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string())], names=["_item", "window"])

    schema = T.StructType([T.StructField("_item", parts.schema["_item"].dataType), T.StructField("window", T.StringType())])
    return parts.mapInArrow(cut, schema).groupBy("window").agg(F.sort_array(F.collect_set("_item")).alias("owners"))


def leaked_windows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "question_id", item_texts: tuple[str, ...] = ("question", "evidence"), width: int = 12, max_edits: int = 2, recall: float = 0.95, sampled: int | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct (key, item_key, edits): the item has a window within ``max_edits`` word edits of one of the document.

    ``sampled`` places of the embedding make a key, by default 5, without edits 12. ``edits`` is the smallest distance found;
    equal windows (edits 0) are all found, others with at least the wanted recall. Two windows differ by two edits where a
    word is put in or left out, as both keep their width.
    """
    spark = docs.sparkSession
    sampled = sampled or (5 if max_edits else 12)
    plan = _plan(width, sampled, bands(width, max_edits, recall, sampled))
    asked = item_windows(items, item_key, item_texts, width)
    blocks = max(1, math.ceil(asked.count() / block))
    given = docs.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    schema = T.StructType([docs.schema[key], T.StructField(item_key, items.schema[item_key].dataType), T.StructField("edits", T.IntegerType())])
    item_type = to_arrow_type(items.schema[item_key].dataType)
    found = spark.createDataFrame([], schema)
    for number in range(blocks):
        # a block of windows, about ``block`` of them, comes to the driver and goes to the workers
        rows = asked.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number).collect() if blocks > 1 else asked.collect()
        if rows:
            rows.sort(key=lambda r: r.window)
            index = _Index([r.window for r in rows], width, plan)
            sent = spark.sparkContext.broadcast((index, [list(r.owners) for r in rows]))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                return _search(key, item_key, item_type, *sent.value, width, plan, max_edits)(batches)

            found = found.unionByName(given.mapInArrow(run, schema)) if number else given.mapInArrow(run, schema)
    return found.groupBy(key, item_key).agg(F.min("edits").alias("edits"))


def touched_documents(leaks: DataFrame, key: str = "doc_id", item_key: str = "question_id") -> DataFrame:
    """One row per touched document with the sorted items that leaked into it, and those of them that did so unchanged."""
    exact = F.array_sort(F.collect_set(F.when(F.col("edits") == 0, F.col(item_key))))
    return leaks.groupBy(key).agg(F.array_sort(F.collect_set(item_key)).alias("items"), exact.alias("unchanged")).withColumn("n_items", F.size("items"))

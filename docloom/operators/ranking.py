"""Inverted postings, rankers, fusion and ranking metrics.

A ranker gives rows (query_id, item_id, score); a ranking adds rank from 1, ties broken by item_id. The query side is small
by its nature but never assumed so: joins go by token, and a top k is cut before the exchange by the window's group limit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import text as X
from docloom.functions import vectors as V


def postings(docs: DataFrame, key: str, tokens: Column, binary: bool = True) -> DataFrame:
    """(item_id, token, tf, dl): with ``binary`` tf is 1 and dl the number of distinct tokens, as entity tokens are sets."""
    base = docs.select(F.col(key).alias("item_id"), tokens.alias("_t")).withColumn("dl", F.size(F.array_distinct("_t") if binary else F.col("_t")))
    if binary:
        return base.select("item_id", "dl", F.explode(F.array_distinct("_t")).alias("token")).withColumn("tf", F.lit(1).cast("long")).select("item_id", "token", "tf", F.col("dl").cast("long").alias("dl"))
    return base.select("item_id", "dl", F.explode("_t").alias("token")).groupBy("item_id", "token", F.col("dl").cast("long").alias("dl")).agg(F.count(F.lit(1)).alias("tf")).select("item_id", "token", "tf", "dl")


def document_frequency(posted: DataFrame) -> DataFrame:
    """(token, df); postings hold one row for each item and token."""
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def collection(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """One row: number of items and mean number of distinct tokens, as many as postings hold for it."""
    return docs.select(F.size(F.array_distinct(tokens)).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def asked_index(docs: DataFrame, key: str, tokens: Column, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Binary postings of the tokens asked for, and the one row of ``collection``, from one pass over the texts.

    What is kept is the size of each item and its postings of asked tokens; all rankers and fusions can share it.
    """
    from docloom.session import cut_lineage

    base = docs.select(F.col(key).alias("item_id"), F.array_distinct(tokens).alias("_t")).withColumn("dl", F.size("_t").cast("long"))
    known = asked.select("token").distinct().withColumn("_asked", F.lit(True))
    rows = _maybe_asked(base, known).select("item_id", "dl", F.posexplode_outer("_t").alias("_at", "token"))
    kept = rows.join(known, "token", "left").where(F.coalesce("_asked", F.lit(False)) | (F.coalesce("_at", F.lit(0)) == 0))
    kept = cut_lineage(kept.select("item_id", "token", "dl", F.coalesce("_asked", F.lit(False)).alias("_asked"), (F.coalesce("_at", F.lit(0)) == 0).alias("_one")))
    stats = kept.where("_one").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return kept.where("_asked").select("item_id", "token", F.lit(1).cast("long").alias("tf"), "dl"), stats


#: Bits of the filter of tokens asked for.
FILTER_BITS = 1 << 24


def _maybe_asked(base: DataFrame, known: DataFrame) -> DataFrame:
    """``base`` (item_id, _t, dl) with the tokens of ``known`` and few others, told by a bit of their hash, so that the rest is not exchanged."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[known.select(spot("token").alias("p")).distinct().toArrow().column("p").to_numpy()] = 1  # FILTER_BITS numbers at most
    sent = base.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, at = batch.column(2), batch.column(3).flatten().to_numpy()
            kept = (sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            counts = np.bincount(pc.list_parent_indices(lists).to_numpy()[kept], minlength=batch.num_rows)
            left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), lists.flatten().filter(pa.array(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), left], names=["item_id", "dl", "_t"])

    given = base.select("item_id", "dl", "_t", F.transform("_t", spot).alias("_p"))
    return given.mapInArrow(run, f"item_id {base.schema['item_id'].dataType.simpleString()}, dl long, _t array<string>")


def asked_tokens(queries: DataFrame, key: str, tokens: Column) -> DataFrame:
    return queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(tokens)).alias("token"))


def _parts(posted: DataFrame, stats: DataFrame, k1: float, b: float, log_idf: bool) -> DataFrame:
    df = document_frequency(posted)
    ratio = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(ratio + 1) if log_idf else F.greatest(F.lit(0.0), ratio)
    tf = F.col("tf").cast("double")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.greatest(F.lit(1.0), F.col("avg_dl"))))
    return posted.join(df, "token").crossJoin(F.broadcast(stats)).select("item_id", "token", part.alias("part"))  # stats is one row


def bm25(posted: DataFrame, asked: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75, log_idf: bool = True) -> DataFrame:
    """Q1, Q2: scores of the items that share a token. Postings are first cut to the tokens asked for."""
    wanted = posted.join(asked.select("token").distinct(), "token", "left_semi")
    return _parts(wanted, stats, k1, b, log_idf).join(asked, "token").groupBy("query_id", "item_id").agg(F.sum("part").alias("score"))


#: Pairs of a set of tokens and an item that a search scores at a time.
PAIRS = 1 << 20


def bm25_top(posted: DataFrame, asked: DataFrame, stats: DataFrame, k: int, digits: int = 9, k1: float = 1.5, b: float = 0.75, log_idf: bool = True) -> DataFrame:
    """Q1, Q2: the ``k`` best items of each query (query_id, item_id, score, rank) by the score of ``bm25``, rounded; ties go by item_id.

    Queries that share the tokens of the postings have the same items, so each set of them is searched once. A set has k items of some
    score at least, and the tokens whose greatest weights together stay below it lead to none of its best items by themselves: only items
    with another of its tokens are scored, in full. A set goes to the blocks of items that hold such a token, and no pair is written down.
    """
    from docloom.session import cut_lineage

    blocks = max(1, int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items = _parts(posted, stats, k1, b, log_idf).withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    least = F.max("part") if k == 1 else F.when(F.count(F.lit(1)) >= k, F.min("part")).otherwise(F.lit(0.0))
    bounds = items.groupBy("token").agg(F.max("part").alias("most"), least.alias("least"))
    terms = asked.join(bounds, "token").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("most", "token", "least"))).alias("terms"))
    terms = cut_lineage(terms.select("query_id", "terms", F.to_json(F.array_sort(F.transform("terms", lambda x: x["token"]))).alias("key")))
    # what k items have at least; the margin is far over the rounding of scores and sums
    sets = terms.select("key", "terms").distinct().withColumn("_floor", F.array_max(F.transform("terms", lambda x: x["least"])) * (1 - 1e-6) - 1e-6)
    upto = lambda i: F.aggregate(F.slice("terms", 1, i + 1), F.lit(0.0), lambda total, x: total + x["most"])
    needed = F.filter("terms", lambda x, i: upto(i) >= F.col("_floor"))
    sets = sets.select("key", F.array_sort(F.transform("terms", lambda x: x["token"])).alias("_tokens"), F.transform(needed, lambda x: x["token"]).alias("_needed"))
    places = F.transform("_needed", lambda x: F.array_position("_tokens", x).cast("int") - 1)
    held = items.select("token", F.col("_block").alias("_to")).distinct()
    sent = sets.select("key", places.alias("needed"), F.explode("_needed").alias("token")).join(held, "token").select("key", "needed", "_to")
    kind = posted.schema["item_id"].dataType
    types = [pa.string(), to_arrow_type(kind), pa.float64()]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        # a set comes once for each of its needed tokens
        y = y.take(pc.index_in(pc.unique(y.column("key")), value_set=y.column("key").combine_chunks())) if y.num_rows else y
        parts = list(_best_items(x, y, k, digits)) if x.num_rows and y.num_rows else []
        if not parts:
            return pa.table([pa.array([], kind) for kind in types], names=["key", "item_id", "score"])
        own, item, score = (np.concatenate(c) for c in zip(*parts))
        return pa.table([y.column("key").take(pa.array(own)).cast(types[0]), _sorted_ids(x).take(pa.array(item)).cast(types[1]), pa.array(score)], names=["key", "item_id", "score"])

    hits = items.groupBy("_block").cogroup(sent.groupBy("_to")).applyInArrow(run, f"key string, item_id {kind.simpleString()}, score double")
    best = ranked(hits.withColumnRenamed("key", "query_id"), k).withColumnRenamed("query_id", "key")
    return terms.select("query_id", "key").join(best, "key").select("query_id", "item_id", "score", "rank")


def _sorted_ids(items: pa.Table) -> pa.Array:
    ids = pc.unique(items.column("item_id"))
    return ids.take(pc.sort_indices(ids, null_placement="at_start"))


def _best_items(items: pa.Table, sets: pa.Table, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set, item, score) of the k best items of each set: items (item_id, token, part), sets (key: their tokens as JSON, needed: places in it); items by their place in ``_sorted_ids``."""
    one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    ids, known = _sorted_ids(items), one(pc.unique(items.column("token")))
    n = len(ids)
    token, owner = (pc.index_in(items.column(c), value_set=v).to_numpy().astype(np.int64) for c, v in (("token", known), ("item_id", ids)))
    place = token * n + owner  # of a posting
    order = np.argsort(place, kind="stable")
    place, owner, part = place[order], owner[order], items.column("part").to_numpy()[order]
    starts = np.searchsorted(place, np.arange(len(known) + 1) * n)
    tokens = [json.loads(text) for text in sets.column("key").to_pylist()]
    lengths = np.array([len(own) for own in tokens], np.int64)
    begins = np.cumsum(lengths) - lengths
    wanted = pc.fill_null(pc.index_in(pa.array([token for own in tokens for token in own], pa.string()), value_set=known), -1).to_numpy().astype(np.int64)
    needed = one(one(sets.column("needed")))
    of = pc.list_parent_indices(needed).to_numpy().astype(np.int64)
    via = wanted[begins[of] + needed.flatten().to_numpy()]
    via, of = via[via >= 0], of[via >= 0]  # those of this block
    met = starts[via + 1] - starts[via]
    before = np.cumsum(met) - met
    lo = 0
    while lo < len(via):
        hi = max(int(np.searchsorted(before, before[lo] + PAIRS)), lo + 1)
        hi = int(np.searchsorted(of, of[hi - 1], "right"))  # all tokens of a set
        own = met[lo:hi]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - starts[via[lo:hi]], own)
        group, item = np.divmod(np.unique(np.repeat(of[lo:hi], own) * n + owner[at]), n)
        score = np.zeros(len(group))
        for j in range(int(lengths[of[lo:hi]].max())):
            live = np.flatnonzero(lengths[group] > j)
            t = wanted[begins[group[live]] + j]
            live, key = live[t >= 0], t[t >= 0] * n + item[live[t >= 0]]
            found = np.minimum(np.searchsorted(place, key), len(place) - 1)
            there = place[found] == key
            score[live[there]] += part[found[there]]
        score = np.round(score, digits)
        order = np.lexsort((item, -score, group))
        group, item, score = group[order], item[order], score[order]
        first = np.arange(len(group)) - np.searchsorted(group, group) < k
        yield group[first], item[first], score[first]
        lo = hi


def overlap(posted: DataFrame, asked: DataFrame) -> DataFrame:
    """Q14: number of tokens shared."""
    return posted.join(asked, "token").groupBy("query_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


def tfidf(posted: DataFrame, asked: DataFrame, stats: DataFrame) -> DataFrame:
    """Q10: cosine of (1 + ln tf) * ln((N + 1) / (df + 1)) + 1 weights, query terms with weight idf."""
    df = document_frequency(posted)
    idf = df.crossJoin(F.broadcast(stats)).select("token", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = posted.join(idf, "token").select("item_id", "token", ((1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    lengths = weighted.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = asked.join(idf, "token").select("query_id", "token", F.col("idf").alias("q"))
    q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = weighted.join(q, "token").groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    return dots.join(lengths, "item_id").join(q_norm, "query_id").select("query_id", "item_id", F.coalesce(F.col("dot") / F.nullif(F.col("norm") * F.col("q_norm"), F.lit(0.0)), F.lit(0.0)).alias("score"))


#: Bytes of query vectors that go to the workers at a time.
BLOCK_BYTES = 64 << 20


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of unit length; a null vector or one without length becomes zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.to_numpy(zero_copy_only=False)
    size = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((len(rows), size))
    for k, r in enumerate(rows):
        if r is not None:
            out[k, : len(r)] = r
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _in_blocks(items: DataFrame, queries: DataFrame, extra: list[str], kernel: Callable, schema: str) -> DataFrame | None:
    """``kernel(query ids, query matrix, query extras, item ids, item matrix, item extras)`` on each batch of the items for each block of queries.

    The query set is stated by the caller and may grow; it is met in blocks of at most BLOCK_BYTES, each in a pass over the items.
    """
    spark = items.sparkSession
    asked = queries.where("query_id is not null").select("query_id", "vector", *[F.col(c).alias(f"q_{c}") for c in extra])
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-(n or 0) * max(1, dim or 1) * 8 // BLOCK_BYTES))
    given = items.where("item_id is not null").select("item_id", "vector", *extra)
    out = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else asked
        table = block.toArrow()
        if not table.num_rows:
            continue
        sent = spark.sparkContext.broadcast((table.column("query_id").to_pylist(), _matrix(table.column("vector")), [np.array(table.column(f"q_{c}").to_pylist(), object) for c in extra]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix, more = sent.value
            for batch in batches:
                if batch.num_rows:
                    right = _matrix(batch.column(1))
                    width = min(matrix.shape[1], right.shape[1])
                    scores = matrix[:, :width] @ right[:, :width].T
                    yield kernel(ids, scores, more, batch.column(0).to_pylist(), [np.array(batch.column(2 + k).to_pylist(), object) for k in range(len(extra))], batch)

        part = given.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def dense_top(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` items (item_id, vector) of the greatest cosine of each query (query_id, vector), exactly.

    Blocks of queries are multiplied with batches of items where these are read; a batch keeps its own ``k`` best of each query, so
    that the exchange sees few rows. Scores equal to nine decimals are ties and go by item_id; a zero vector has cosine 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*items.schema.fields, *queries.schema.fields)}
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double"
    query_type = to_arrow_type(queries.schema["query_id"].dataType)

    def kernel(ids, scores, _more, item_ids, _extras, batch) -> pa.RecordBatch:
        order = np.argsort(np.array(item_ids, object), kind="stable")
        rows = []
        for q, exact in zip(ids, scores[:, order]):
            own = np.round(exact, 9)
            best = np.argsort(-own, kind="stable")[:k] if len(own) <= 4 * k else _best(own, k)
            rows += [(q, item_ids[order[j]], float(exact[j])) for j in best]
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], query_type), pa.array(columns[1], batch.schema.field(0).type), pa.array(columns[2], pa.float64())], names=["query_id", "item_id", "score"])

    found = _in_blocks(items, queries, [], kernel, schema)
    found = found if found is not None else items.sparkSession.createDataFrame([], schema)
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("item_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(own: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest, ties from the left, without sorting all."""
    bound = np.partition(own, len(own) - k)[len(own) - k]
    able = np.flatnonzero(own >= bound)
    return able[np.argsort(-own[able], kind="stable")[:k]]


def first_relevant(items: DataFrame, queries: DataFrame, label: str = "label") -> DataFrame:
    """(query_id, first): rank, among all items but the query itself, of the best item with the query's label; no row without one.

    Two passes of sums: the best relevant item of each query, then the number of items before it. No ranking and no pairs of a
    label are ever written out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*items.schema.fields, *queries.schema.fields)}
    schema = f"query_id {kinds['query_id']}, score double, item_id {kinds['item_id']}"
    query_type = to_arrow_type(queries.schema["query_id"].dataType)

    def best(ids, scores, more, item_ids, extras, batch) -> pa.RecordBatch:
        names = np.array(item_ids, object)
        order = np.argsort(names, kind="stable")
        rows, labels, sorted_names = [], extras[0][order], names[order]
        for q, l, own in zip(ids, more[0], np.round(scores[:, order], 9)):
            able = np.flatnonzero((labels == l) & (sorted_names != q)) if l is not None else ()
            if len(able):
                j = int(able[own[able].argmax()])  # the first of equal ones
                rows.append((q, float(own[j]), sorted_names[j]))
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], query_type), pa.array(columns[1], pa.float64()), pa.array(columns[2], batch.schema.field(0).type)], names=["query_id", "score", "item_id"])

    found = _in_blocks(items, queries, [label], best, schema)
    if found is None:
        return items.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, first long")
    top = found.groupBy("query_id").agg(F.min_by(F.struct("score", "item_id"), F.struct(-F.col("score"), F.col("item_id"))).alias("b")).select("query_id", "b.*")
    asked = queries.join(top, "query_id").select("query_id", "vector", F.col("score").alias("bound"), F.col("item_id").alias("bound_id"))
    marked = items.select("item_id", "vector", F.lit(None).cast("double").alias("bound"), F.lit(None).cast(kinds["item_id"]).alias("bound_id"))

    def before(ids, scores, more, item_ids, _extras, batch) -> pa.RecordBatch:
        names = np.array(item_ids, object)
        counts = [int((((own > b) | ((own == b) & (names < i))) & (names != q)).sum()) for q, b, i, own in zip(ids, more[0].astype(float), more[1], np.round(scores, 9))]
        return pa.RecordBatch.from_arrays([pa.array(ids, query_type), pa.array(counts, pa.int64())], names=["query_id", "n"])

    counted = _in_blocks(marked, asked, ["bound", "bound_id"], before, f"query_id {kinds['query_id']}, n long")
    return counted.groupBy("query_id").agg((F.sum("n") + 1).alias("first"))


def maxsim_top(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Q7: items (item_id, m: array of vectors) with the greatest sum over the query's vectors (query_id, q) of the best dot product.

    As for ``dense_top`` the query set is met in blocks by batches of items where these are read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (*items.schema.fields, *queries.schema.fields)}
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double"
    spark, query_type = items.sparkSession, to_arrow_type(queries.schema["query_id"].dataType)
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.aggregate("q", F.lit(0), lambda a, v: a + F.size(v)))).first()
    blocks = max(1, -(-(n or 0) * max(1, size or 1) * 8 // BLOCK_BYTES))
    out = spark.createDataFrame([], schema)
    for number in range(blocks):
        rows = queries.where((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) & F.col("query_id").isNotNull() & (F.size("q") > 0)).select("query_id", "q").collect()  # one block
        if not rows:
            continue
        sent = spark.sparkContext.broadcast([(r.query_id, np.array(r.q, float)) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best: dict[int, list] = {}
                for item, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if vectors:
                        passage = np.array(vectors, float)
                        for place, (_, q) in enumerate(sent.value):
                            best.setdefault(place, []).append((float((q @ passage.T).max(axis=1).sum()), item))
                found = [(sent.value[p][0], i, s) for p, own in best.items() for s, i in sorted(own, key=lambda x: (-round(x[0], 9), x[1]))[:k]]
                columns = list(zip(*found)) if found else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], query_type), pa.array(columns[1], batch.schema.field(0).type), pa.array(columns[2], pa.float64())], names=["query_id", "item_id", "score"])

        out = out.unionByName(items.where(F.col("item_id").isNotNull()).select("item_id", "m").mapInArrow(run, schema))
    return ranked(out, k)


def sparse(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Q4, Q6: dot product of exploded sparse vectors (id, term, weight)."""
    return items.join(queries, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Rank by score, ties by item_id; with ``k`` only the first k of each query."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Q8: sum of 1 / (k + rank) over rankings with ranks from 1."""
    parts = [r.select("query_id", "item_id", (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "item_id").agg(F.sum("part").alias("score"))


def ranking_metrics(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query of ``gold`` (query_id, item_id) hit at 1, 5 and 10, reciprocal rank and NDCG at 10 of the first hit."""
    hits = ranking.join(gold, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return first_hit_metrics(gold.select("query_id").distinct().join(hits, "query_id", "left"))


def first_hit_metrics(first: DataFrame) -> DataFrame:
    """The measures of E12 from the rank of the first hit (query_id, first); null: none."""
    at = lambda n: F.coalesce((F.col("first") <= n).cast("double"), F.lit(0.0))
    return first.select("query_id", at(1).alias("hit_1"), at(5).alias("hit_5"), at(10).alias("hit_10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("first") <= 10, 1.0 / F.log2(F.col("first") + 1.0)).otherwise(0.0).alias("ndcg_10"))


def metric_means(per_query: DataFrame) -> DataFrame:
    """Means over queries of the measures of E12, in one row; nulls count nowhere."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])


def entity_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    return postings(docs, key, X.entity_tokens(text))

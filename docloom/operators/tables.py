"""Relational store of table cells: rows as key-value maps, an entity index, lookups and row chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import numeric as N
from docloom.functions import text as X
from docloom.operators import sequences as S
from docloom.session import cut_lineage


# Fixed value: shuffle partitions for each block of rows that a search holds at once.
BLOCK_PARTS = 8
# Tokens that may go to every worker.
SENT_TOKENS = 1 << 16


def explode_tables(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rows) of nested grids with table_id, column_headers and rows of row_label and cell_values.

    A cell without a header gets Col_i; repeated tables are stored once (the last wins by table_id is the caller's choice).
    """
    rows = tables.select("table_id", "column_headers", F.posexplode_outer("rows").alias("row_no", "row")).where("row is not null")
    rows = rows.select("table_id", F.format_string("%s_r%d", "table_id", "row_no").alias("row_id"), "row_no", F.col("row.row_label").alias("row_label"), "column_headers", F.col("row.cell_values").alias("cell_values"))
    header = F.coalesce(F.get(F.col("column_headers"), F.col("col_no")), F.concat(F.lit("Col_"), F.col("col_no").cast("string")))
    cells = rows.select("*", F.posexplode("cell_values").alias("col_no", "raw_value"))
    unit = N.unit_value("raw_value")
    return cells.select("table_id", "row_id", F.format_string("%s_c%d", "row_id", "col_no").alias("cell_id"), "row_label", header.alias("column_label"), "raw_value", unit["base_value"].alias("norm_numeric"), unit["category"].alias("unit_category")), rows


def row_maps(cells: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """F64: one row for each (table_id, row_id) with its label and a map from column label to value; a later column of the same name wins,
    whatever the session says of duplicate keys. ``values`` names more maps of the same row with the columns they hold.
    """
    values = values or {"row_kv": "raw_value"}

    def kv(column: str) -> Column:
        ordered = F.array_sort(F.transform("_cells", lambda c: F.struct(c["cell_id"], c["column_label"].alias("key"), c[column].alias("value"))))
        last = F.transform(F.array(ordered), lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda other: other["key"] == e["key"])))
        return F.map_from_entries(F.transform(F.get(last, F.lit(0)), lambda e: F.struct(e["key"], e["value"])))

    rows = cells.where("column_label is not null").groupBy("table_id", "row_id").agg(F.max("row_label").alias("row_label"), F.collect_list(F.struct("cell_id", "column_label", *dict.fromkeys(values.values()))).alias("_cells"))
    return rows.select("table_id", "row_id", "row_label", *[kv(column).alias(name) for name, column in values.items()])


def row_tokens(cells: DataFrame) -> DataFrame:
    """Entity index: distinct (row_id, table_id, token) of row labels, column labels and values."""
    text = F.concat_ws(" ", "row_label", "column_label", "raw_value")
    return cells.select("row_id", "table_id", F.explode(X.entity_tokens(text)).alias("token")).distinct()


def lookup(index: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """A1: rows by the number of distinct query tokens, at most k for each query, ties by row_id.

    Both sides hold each token once for a row or query, so that counting tokens counts distinct ones. A common token meets most rows
    in most queries, so no pair of them is written down: each block of rows counts the tokens of every query in its postings and keeps
    its k best, and only those are put together.
    """
    blocks = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BLOCK_PARTS)
    rows = index.groupBy("row_id", "table_id").agg(F.collect_list("token").alias("tokens")).withColumn("_block", F.pmod(F.xxhash64("row_id", "table_id"), F.lit(blocks)).cast("int"))
    queries = asked.groupBy("query_id").agg(F.collect_list("token").alias("tokens")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kinds = [asked.schema["query_id"].dataType, index.schema["row_id"].dataType, index.schema["table_id"].dataType]
    names, types = ["query_id", "row_id", "table_id", "hit_count"], [*map(to_arrow_type, kinds), pa.int64()]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], kind) for kind in types], names=names)
        a = a.take(pc.sort_indices(a, sort_keys=[("row_id", "ascending"), ("table_id", "ascending")], null_placement="at_start"))
        query, row, count = best_overlaps(a.column("tokens").combine_chunks(), b.column("tokens").combine_chunks(), k)
        return pa.table([b.column("query_id").take(query).cast(types[0]), a.column("row_id").take(row).cast(types[1]), a.column("table_id").take(row).cast(types[2]), count], names=names)

    schema = ", ".join(f"{n} {kind.simpleString()}" for n, kind in zip(names, kinds)) + ", hit_count long"
    hits = rows.groupBy("_block").cogroup(queries.groupBy("_block")).applyInArrow(run, schema)
    w = W.partitionBy("query_id").orderBy(F.desc("hit_count"), "row_id", "table_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def known_tokens(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key, query_tokens): the tokens of each query that the index holds and a key of that set; a query without any has no row."""
    held = asked.join(index.select("token").distinct(), "token", "left_semi")
    sets = held.groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias("query_tokens"))
    return cut_lineage(sets.select("query_id", F.to_json("query_tokens").alias("key"), "query_tokens"))


def lookup_sets(index: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """``lookup`` for the sets of ``known_tokens``: (key, row_id, table_id, hit_count, rank).

    Rows depend on the known tokens alone, which many queries share, so each set of them is searched once.
    """
    sets = known.select(F.col("key").alias("query_id"), F.explode("query_tokens").alias("token")).distinct()
    wanted = sets.select("token").distinct()
    if wanted.limit(SENT_TOKENS + 1).count() <= SENT_TOKENS:  # no row is found by other tokens
        index = index.join(F.broadcast(wanted), "token", "left_semi")
    return lookup(index, sets, k).withColumnRenamed("query_id", "key")


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def best_overlaps(rows: pa.ListArray, queries: pa.ListArray, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(query, row, tokens shared) of the k rows of each query that share most tokens, ties by place; both hold lists of distinct tokens."""
    rows, queries = _one(rows), _one(queries)
    known = pc.unique(queries.flatten())
    token = pc.index_in(rows.flatten(), value_set=known)
    there = pc.is_valid(token).to_numpy(zero_copy_only=False)
    token, owner = token.drop_null().to_numpy().astype(np.int64), pc.list_parent_indices(rows).to_numpy()[there].astype(np.int64)
    order = np.argsort(token, kind="stable")
    owner, starts = owner[order], np.searchsorted(token[order], np.arange(len(known) + 1))
    wanted, lengths = pc.index_in(queries.flatten(), value_set=known).to_numpy(), pc.list_value_length(queries).to_numpy()
    ends = np.cumsum(lengths)
    counts = np.zeros(len(rows), np.uint8 if lengths.max(initial=0) < 256 else np.int64)
    common: dict[int, np.ndarray] = {}  # tokens of many rows, as a count for every row
    query, row, count = [], [], []
    for q in range(len(queries)):
        counts[:] = 0
        for t in wanted[ends[q] - lengths[q] : ends[q]].tolist():
            own = owner[starts[t] : starts[t + 1]]
            if len(own) * 16 > len(counts):
                if t not in common:
                    common[t] = np.zeros_like(counts)
                    common[t][own] = 1
                counts += common[t]
            elif len(own):
                counts[own] += 1
        level, left = int(counts.max(initial=0)), k
        while level and left:
            best = np.flatnonzero(counts == level)[:left].copy()  # not a view, which would keep all of them
            if len(best):
                query.append(np.full(len(best), q))
                row.append(best)
                count.append(np.full(len(best), level))
                left -= len(best)
            level -= 1
    whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return whole(query), whole(row), whole(count)


def range_lookup(cells: DataFrame, metadata: DataFrame, predicates: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest cells of the category that meet a predicate (query_id, op, target, category), with their table.

    Upper bounds only need the k lowest cells of a category. For the others cells and bounds are sorted together from the highest
    value, and each bound takes the k cells seen last; the parts of the sorted table pass on their k lowest cells of a category.
    So no cell meets every predicate. Nulls and NaN meet none.
    """
    wanted = predicates.where("category is not null and target is not null").select("query_id", "op", F.col("target").cast("double").alias("target"), "category")
    numbers = cells.where(F.col("norm_numeric").isNotNull() & ~F.isnan("norm_numeric") & F.col("unit_category").isNotNull()).select("cell_id", "table_id", F.col("norm_numeric").cast("double").alias("norm_numeric"), F.col("unit_category").alias("category"))
    low = W.partitionBy("category").orderBy("norm_numeric", "cell_id")
    lowest = numbers.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k)
    upper = wanted.where("op in ('<', '<=')").join(lowest, "category").where(N.compare(F.col("op"), F.col("norm_numeric"), F.col("target"))).select("query_id", "cell_id", "table_id", "norm_numeric")
    lower = _next_cells(numbers, wanted.where("op not in ('<', '<=')"), k)
    w = W.partitionBy("query_id").orderBy("norm_numeric", "cell_id")
    first = upper.unionByName(lower).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return first.join(metadata.select("table_id", "doc_name", "section_path", "page"), "table_id")


def _next_cells(numbers: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """For bounds with =, > or >= the k lowest cells from there on: (query_id, cell_id, table_id, norm_numeric)."""
    kinds = {f.name: f.dataType.simpleString() for f in (*numbers.schema.fields, *bounds.schema.fields)}
    names = ["category", "value", "rank_", "cell_id", "table_id", "query_id", "op"]
    # from the highest value; at one value a bound with > comes before the cells, the others after them
    a = numbers.select("category", F.col("norm_numeric").alias("value"), F.lit(1).alias("rank_"), "cell_id", "table_id", F.lit(None).cast(kinds["query_id"]).alias("query_id"), F.lit(None).cast("string").alias("op"))
    b = bounds.select("category", F.col("target").alias("value"), F.when(F.col("op") == ">", 2).otherwise(0).alias("rank_"), F.lit(None).cast(kinds["cell_id"]).alias("cell_id"), F.lit(None).cast(kinds["table_id"]).alias("table_id"), "query_id", "op")
    order = [F.asc("category"), F.desc("value"), F.desc("rank_"), F.desc("cell_id")]
    part = cut_lineage(a.unionByName(b).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    low = W.partitionBy("part", "category").orderBy("value", "cell_id")
    tails = part.where("cell_id is not null").withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k).select("part", "category", "value", "cell_id", "table_id").collect()  # k rows a part and category
    sent = numbers.sparkSession.sparkContext.broadcast(sorted(((r.part, r.category, r.value, r.cell_id, r.table_id) for r in tails), key=lambda r: (r[0], r[1], -r[2], r[3])))
    schema = f"query_id {kinds['query_id']}, cell_id {kinds['cell_id']}, table_id {kinds['table_id']}, norm_numeric double"

    def run(frames):
        rows, seen, category, first = [], [], None, None
        for frame in frames:
            for c, v, r, cell, table, q, op in frame[names].itertuples(index=False):
                p = first if first is not None else int(frame["part"].iloc[0])
                first = p
                if c != category:
                    category = c
                    # what earlier parts have of this category, its k lowest last
                    seen = sorted(((x[2], x[3], x[4]) for x in sent.value if x[0] < p and x[1] == c), key=lambda x: (x[0], x[1]))[:k][::-1]
                if r == 1:
                    seen.append((v, cell, table))
                    if len(seen) > 4 * k + 64:
                        seen = seen[-2 * k :]
                else:
                    near = sorted(seen, key=lambda x: (x[0], x[1]))[:k]
                    rows += [(q, x[1], x[2], x[0]) for x in near if op != "=" or x[0] == v]
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "cell_id", "table_id", "norm_numeric"])
                rows = []

    return part.mapInPandas(run, schema)


# Words of a column label that decide for its cell.
DOMAIN_WORDS = "temperature temp degc c voltage volts v pressure psi diameter mm storage tb gb memory ram battery wh material sterilization processor cpu flow cv".split()


def best_cell(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """for each (query_id, row_id) of ``asked`` (with query_tokens) the cell with most query tokens: five for each in the column label, ten
    more for each of DOMAIN_WORDS among them, one in the value; the first of equal ones.
    """
    tokens, label = F.col("query_tokens"), F.array_intersect(X.entity_tokens("column_label"), F.col("query_tokens"))
    domain = F.size(F.array_intersect(label, F.array(*[F.lit(w) for w in DOMAIN_WORDS])))
    score = 5 * F.size(label) + F.size(F.array_intersect(X.entity_tokens("raw_value"), tokens)) + 10 * domain
    joined = cells.join(asked, ["row_id", "table_id"]).withColumn("cell_score", score)
    w = W.partitionBy("query_id", "row_id", "table_id").orderBy(F.desc("cell_score"), "cell_id")
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def search(cells: DataFrame, metadata: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, row_id, cell_id, raw_value, score, doc_name, section_path, page) for each query (query_id, query).

    A query with a predicate on a known unit takes the cells in range, with score 10; any other the rows that share most of its tokens,
    each with its best cell. Both branches run in one plan and are put together.
    """
    parsed = queries.select("query_id", "query", N.predicate("query").alias("p"))
    ranged = F.col("p.category").isNotNull()
    hits = range_lookup(cells, metadata, parsed.where(ranged).select("query_id", "p.op", "p.target", "p.category"), k)
    by_range = hits.join(cells.select("cell_id", "row_id", "raw_value").dropDuplicates(["cell_id"]), "cell_id").select("query_id", "rank", "row_id", "cell_id", "raw_value", F.lit(10.0).alias("score"), "doc_name", "section_path", "page")
    tokens = parsed.where(~F.coalesce(ranged, F.lit(False))).select("query_id", X.entity_tokens("query").alias("query_tokens"))
    rows = lookup(row_tokens(cells), tokens.select("query_id", F.explode("query_tokens").alias("token")), k)
    best = best_cell(cells, rows.join(tokens, "query_id"))
    by_row = best.join(metadata.select("table_id", "doc_name", "section_path", "page").dropDuplicates(["table_id"]), "table_id", "left").select("query_id", "rank", "row_id", "cell_id", "raw_value", F.col("hit_count").cast("double").alias("score"), "doc_name", "section_path", "page")
    return by_range.unionByName(by_row)


def row_text(section: Column, table: Column, label: Column, headers: Column, values: Column) -> Column:
    """"Section: … | Table: … | Row: … | header = value", empty cells left out."""
    pairs = F.filter(F.zip_with(headers, values, lambda h, v: F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(h, F.lit(" = "), F.trim(v)))), lambda s: s.isNotNull())
    return F.concat_ws(" | ", F.concat(F.lit("Section: "), section), F.concat(F.lit("Table: "), table), F.concat(F.lit("Row: "), label), F.array_join(pairs, " | "))


def row_chunks(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """One chunk for each row with pointers to its neighbours, the number of rows and the summary row.

    The summary row is the last whose label holds total, sum or average, else the last row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("cell_id", "column_label", "raw_value")))
    rows = cells.groupBy("table_id", "row_id").agg(F.max("row_label").alias("row_label"), ordered.alias("c"))
    number = F.regexp_extract("row_id", r"_r([0-9]+)$", 1).try_cast("int")
    # one table may hold a tenth of all rows: neighbours come by number, totals by aggregation, and no window holds a table
    rows = S.neighbours_in_order(rows.withColumn("row_index", number), ["table_id"], ["row_index", "row_id"], "row_id")
    is_sum = F.lower("row_label").rlike("total|sum|average")
    whole = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.max_by("row_id", F.when(is_sum, F.struct("row_index", "row_id"))), F.max_by("row_id", F.struct("row_index", "row_id"))).alias("summary_row_id"))
    rows = rows.join(whole, "table_id", "left").join(metadata.select("table_id", "section_path").dropDuplicates(["table_id"]), "table_id", "left")
    return rows.select(
        "table_id", "row_id", "row_index", row_text(F.col("section_path"), F.col("table_id"), F.col("row_label"), F.col("c.column_label"), F.col("c.raw_value")).alias("text"),
        F.col("prev_id").alias("prev_row_id"), F.col("next_id").alias("next_row_id"), "total_rows", "summary_row_id",
    )

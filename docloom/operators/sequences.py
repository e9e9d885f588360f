"""Order-dependent grouping: running state, gaps and islands, packing under a budget, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Prev and next keys, place in the group and its size."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumns({"prev_id": F.lag(key).over(w), "next_id": F.lead(key).over(w), "sequence_in_group": F.row_number().over(w) - 1, "total_in_group": F.count(F.lit(1)).over(W.partitionBy(*group))})


def islands(df: DataFrame, group: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number of the run a row belongs to; ``starts`` is true where a run begins."""
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(W.partitionBy(*group).orderBy(*order)))


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last value that is not null, up to and with the row."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def carry_over_pages(df: DataFrame, doc: list[str], page: str, order: list[str], value: str, name: str) -> DataFrame:
    """W4 for documents of any length: carried inside each page, and from page to page on one row a page.

    No window holds the rows of a whole document, so that one that holds a large share of all rows is no single task's.
    """
    inside = W.partitionBy(*doc, page).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = df.groupBy(*doc, page).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_co_last"))
    before = W.partitionBy(*doc).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    starts = ends.select(*[F.col(c).alias(f"_{c}") for c in (*doc, page)], F.last("_co_last", ignorenulls=True).over(before).alias("_co_start"))
    same = None
    for c in (*doc, page):
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    return df.withColumn("_co_own", F.last(value, ignorenulls=True).over(inside)).join(starts, same, "left").withColumn(name, F.coalesce("_co_own", "_co_start")).drop("_co_own", "_co_start", *[f"_{c}" for c in (*doc, page)])


def global_number(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Number of each row from 0 in a total order, without one task that holds all rows.

    The rows are range partitioned and kept; each part is numbered by itself from the number of rows in the parts before it,
    which is one row a part. ``order`` has to be unique for a defined result; ties are numbered in any order.
    """
    from docloom.session import cut_lineage

    parts = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def neighbours_in_order(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """W1, W2 for groups of any size: prev_id and next_id by the number of a row in a total order, joined by that number."""
    numbered = global_number(df, [*group, *order], "_at")
    beside = numbered.select(F.col("_at").alias("_to"), *[F.col(c).alias(f"_g_{c}") for c in group], F.col(key).alias("_key"))
    same = None
    for c in group:
        one = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        same = one if same is None else same & one
    out = numbered
    for step, name in ((-1, "prev_id"), (1, "next_id")):
        out = out.join(beside.withColumn("_to", F.col("_to") - step), (F.col("_at") == F.col("_to")) & same, "left").withColumn(name, F.col("_key")).drop("_to", "_key", *[f"_g_{c}" for c in group])
    return out.drop("_at")


def gap_clusters(df: DataFrame, group: list[str], value: str, most: Column, name: str = "cluster") -> DataFrame:
    """One-dimensional clusters cut where the gap to the value before is over ``most``."""
    w = W.partitionBy(*group).orderBy(value)
    return df.withColumn(name, F.sum(F.coalesce((F.col(value) - F.lag(value).over(w) > most).cast("int"), F.lit(0))).over(w))


def pack(sizes: Column, budget: int) -> Column:
    """For an array of sizes the number of the pack of each: a pack is closed when the next would take it over the budget."""
    start = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        over = (acc["used"] > 0) & (acc["used"] + size > budget)
        pack_no = F.when(over, acc["pack"] + 1).otherwise(acc["pack"])
        return F.struct(pack_no.alias("pack"), F.when(over, size.cast("long")).otherwise(acc["used"] + size).alias("used"), F.concat(acc["out"], F.array(pack_no)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def pack_alone(blocks: Column, budget: int) -> Column:
    """As ``pack`` for structs of n and alone: one that stands alone has a pack of its own."""
    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("shut"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        fresh = acc["shut"] | b["alone"] | (acc["used"] + b["n"] > budget)
        pack_no = F.when(fresh, acc["pack"] + 1).otherwise(acc["pack"])
        return F.struct(pack_no.alias("pack"), F.when(fresh, b["n"].cast("long")).otherwise(acc["used"] + b["n"]).alias("used"), b["alone"].alias("shut"), F.concat(acc["out"], F.array(pack_no)).alias("out"))

    return F.aggregate(blocks, start, step, lambda acc: acc["out"])


def pack_between(sizes: Column, least: int, most: int) -> Column:
    """As ``pack``, but a pack is only closed once it has reached ``least``."""
    start = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        over = (F.size(acc["out"]) > 0) & (acc["used"] + size > most) & (acc["used"] >= least)
        pack_no = F.when(over, acc["pack"] + 1).otherwise(acc["pack"])
        return F.struct(pack_no.alias("pack"), F.when(over, size.cast("long")).otherwise(acc["used"] + size).alias("used"), F.concat(acc["out"], F.array(pack_no)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def previous_over_pages(df: DataFrame, doc: list[str], page: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before in a document, over page ends too; null at its start. ``value`` must not be null."""
    given = df.withColumn("_v", value)
    inside = W.partitionBy(*doc, page).orderBy(*order)
    given = given.withColumn("_own", F.lag("_v").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    ends = given.groupBy(*doc, page).agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    before = ends.select(*[F.col(c).alias(f"_{c}") for c in (*doc, page)], F.lag("_last").over(W.partitionBy(*doc).orderBy(page)).alias("_prior"))
    same = None
    for c in (*doc, page):
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    joined = given.join(before, same, "left")
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_own"))).drop("_v", "_own", "_first", "_prior", *[f"_{c}" for c in (*doc, page)])


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, each starting size - overlap after the one before; the last reaches the end."""
    n, step = F.size(tokens), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def trim_to_budget(df: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order while their running size is within the budget; the first is always kept."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumns({"_run": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)), "_n": F.row_number().over(w)}).where((F.col("_run") <= budget) | (F.col("_n") == 1)).drop("_run", "_n")


def column_order(df: DataFrame, page: list[str], box: str = "bbox", full_width: float = 350.0, middle: float = 295.0, key: str | None = None) -> DataFrame:
    """Reading order of a two-column page: slices between full-width boxes, left column before right, then from the top.

    Adds slice_no, column_no (0 full width, 1 left, 2 right) and reading_order. Boxes at one place go by ``key``.
    """
    b = F.col(box)
    last = [key] if key else []
    wide = (b["x1"] - b["x0"]) >= full_width
    top = W.partitionBy(*page).orderBy(b["y0"], b["x0"], *last)
    df = df.withColumn("column_no", F.when(wide, 0).when((b["x0"] + b["x1"]) / 2 < middle, 1).otherwise(2))
    df = df.withColumn("slice_no", F.sum((F.col("column_no") == 0).cast("int")).over(top.rowsBetween(W.unboundedPreceding, 0)))
    order = W.partitionBy(*page).orderBy("slice_no", "column_no", b["y0"], b["x0"], *last)
    return df.withColumn("reading_order", F.row_number().over(order))


def concordance(df: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """Kendall's tau of two orders in each group, from the pairs of a group in built-in joins."""
    a = df.select(*group, F.col(left).alias("l1"), F.col(right).alias("r1"))
    b = df.select(*group, F.col(left).alias("l2"), F.col(right).alias("r2"))
    pairs = a.join(b, group).where("l1 < l2")
    sign = F.signum((F.col("r2") - F.col("r1")).cast("double"))
    return pairs.groupBy(*group).agg(F.avg(sign).alias("tau"), F.count(F.lit(1)).alias("n_pairs"))

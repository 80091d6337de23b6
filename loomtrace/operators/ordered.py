"""Operators whose result depends on an order, which every input carries as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keep(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def first_seen(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Partial limits run before the shuffle, so hot keys cost one row a task."""
    return _keep(df, keys, order, 1)


def last_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, with ``_first``: where the key was met first."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"), F.min(order).alias("_first"))
    return out.select(*keys, "_row.*", "_first")


def top_per_group(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return _keep(df, keys, order, most)


def slice_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], start: int, size: int) -> DataFrame:
    """Rows start to start + size - 1 of each group, counted from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank").between(start + 1, start + size)).drop("_rank")


def top_then_filter(df: DataFrame, order: Sequence[Column], most: int, condition: Column) -> DataFrame:
    """The first rows overall; the condition is tested after the limit, so fewer may come."""
    return df.orderBy(*order).limit(most).where(condition)


def token_windows(tokens: Column, size: int = 150, overlap: int = 75) -> Column:
    """Overlapping slices every size - overlap tokens; the last ones are shorter."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    starts = lambda t: F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(step)))
    # Named by a transform of one element: an expression within the inner one, as a split, would be worked out for each slice.
    return F.transform(F.array(tokens), lambda t: F.transform(starts(t), lambda i: F.slice(t, i + 1, size)))[0]


def page_range(first: Column, last: Column) -> Column:
    """"7" or "7 - 8"."""
    return F.when(first.eqNullSafe(last), first.cast("string")).otherwise(F.concat_ws(" - ", first.cast("string"), last.cast("string")))


def budget_prefix(df: DataFrame, group: Sequence[str], order: Sequence[Column], cost: str, start: Column, budget: Column) -> DataFrame:
    """Rows of each group while the running cost, from ``start`` on, stays within the budget. Costs aren't negative."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", start + F.sum(cost).over(w)).where(F.col("used") <= budget)


def mid_ranks(df: DataFrame, value: str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average ranks: ties share the mean of their places.

    Equal values are counted first, so what is ranked is one row a value.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = counts.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*group, value])


def running_heading(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, resets: Column, out: str) -> DataFrame:
    """The last value that isn't null, forgotten wherever ``resets`` holds."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_part", F.sum(F.when(resets, 1).otherwise(0)).over(w))
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(within)).drop("_part")


def glue_pages(df: DataFrame, doc: str, page: str, idx: str, text: str) -> DataFrame:
    """The first paragraph of a page joins the last one of the page before it: doc, page range, idx, text."""
    w = Window.partitionBy(doc).orderBy(page, idx)
    df = df.withColumn("_new", F.lag(page).over(w).isNull() | (F.lag(page).over(w) == F.col(page)))
    df = df.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(idx).alias("i"), F.col(text).alias("t"))))
    out = df.groupBy(doc, "_run").agg(parts.alias("_parts"))
    return out.select(doc, page_range(F.element_at("_parts", 1)["p"], F.element_at("_parts", -1)["p"]).alias("page_id"), F.col("_run").alias("para_idx"), F.concat_ws(" ", "_parts.t").alias(text))


def numbered_chunks(df: DataFrame, order: Sequence[Column], size: int, group: Sequence[str]) -> DataFrame:
    """Rows of a group dealt to chunks of ``size``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))

"""Ordered computations: offsets, numbering, repeats, scopes, nearest anchors, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import materialize


def global_offsets(paragraphs: DataFrame, by: str, order: str, text: str, separator: int = 2) -> DataFrame:
    """paragraphs with offset, where each begins in the document that joins them with a separator of so many characters."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("offset", F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0)).cast("long"))


def display_numbers(notes: DataFrame, by: str, order: list[str], starred: Column) -> DataFrame:
    """notes with number, counted without the starred ones, which have none."""
    w = Window.partitionBy(by).orderBy(*order)
    return notes.withColumn("number", F.when(~starred, F.sum(F.when(~starred, 1).otherwise(0)).over(w)).cast("long"))


def suppress_repeats(rows: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """rows, with column empty where it repeats the row before."""
    last = F.lag(column).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn(column, F.when(F.col(column).eqNullSafe(last) & last.isNotNull(), F.lit("")).otherwise(F.col(column)))


def first_by(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """value of the first row of each group, by order."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(value))


def top_n(rows: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The n best rows of each group with their rank; order must end in a unique column, so that ties have an answer."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def next_within(rows: DataFrame, by: str, at: str, key: str, tolerance: Column) -> DataFrame:
    """rows with next, the key of the row that follows in its group if it lies within the tolerance (a forward as-of match with one
    window instead of a join)."""
    w = Window.partitionBy(by).orderBy(at, key)
    return rows.withColumn("next", F.when(F.lead(at).over(w) - F.col(at) <= tolerance, F.lead(key).over(w)))


def in_ranges(rows: DataFrame, ranges: DataFrame, by: str, number: str) -> DataFrame:
    """rows joined to ranges (by, scope, low, high) that hold their number. Ranges are spread into their numbers first, so this is an
    equality join; ranges of pinpoints are short."""
    spread = ranges.select(by, "scope", F.explode(F.sequence(F.col("low"), F.col("high"))).alias(number))
    return rows.join(spread, [by, number])


def combined_ranges(rows: DataFrame, ranges: DataFrame, by: str, number: str, text: str) -> DataFrame:
    """One block a range, its members joined by line ends, for ranges all of whose members exist."""
    members = in_ranges(rows, ranges, by, number).groupBy(by, "scope").agg(F.array_sort(F.collect_list(F.struct(number, text))).alias("_m"))
    whole = members.join(ranges, [by, "scope"]).filter(F.size("_m") == F.col("high") - F.col("low") + 1)
    return whole.select(by, "scope", "low", "high", F.array_join(F.transform("_m", lambda m: m[text]), "\n").alias(text))


def first_overlap(parts: DataFrame, links: DataFrame, by: str, width: int = 512) -> DataFrame:
    """links (by, link, from, to) with the first part (by, part, start, end) that each overlaps. Intervals are cut into cells of
    width, so that only neighbours meet."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    p = parts.filter("start < end").withColumn("_cell", cells("start", "end"))
    ln = links.filter("from < to").withColumn("_cell", cells("from", "to"))
    met = ln.join(p, [by, "_cell"]).filter(F.greatest("start", "from") < F.least("end", "to"))
    return met.groupBy(by, "link").agg(F.min("part").alias("part"))


def running_sum(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """rows with the sum of weight over all rows up to this one, in order, which must tell rows apart. Rows are dealt by ranges of the
    order and written; the ranges' totals, one row each, are added up first, so no task sees more than a range."""
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(weight).alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.sum(weight).over(inside)).drop("_range", "_before")


def running_cap(rows: DataFrame, order: list[str], weight: str, most: int) -> DataFrame:
    """Rows in order as long as the running sum of weight stays within most."""
    return running_sum(rows, order, weight, "_sum").filter(F.col("_sum") <= most).drop("_sum")

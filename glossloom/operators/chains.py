"""Ordered operators over lines of one document: inheritance, windows between anchors, gaps, groups.

All are window functions: islands by running sums, as-of values by the last or
first one that is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys, order):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _after(keys, order):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)


def inherited(rows: DataFrame, keys: list[str], order: str, own: str, breaks: Column | None = None) -> DataFrame:
    """rows with target (own, or the nearest own one above), is_inherited and depth (lines since). Where breaks holds, nothing is inherited over the line."""
    if breaks is not None:
        up_to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("chain", F.sum(breaks.cast("int")).over(up_to))
        keys = [*keys, "chain"]
    up_to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("target", F.last(own, ignorenulls=True).over(up_to)).withColumn("island", F.count(own).over(up_to))
    depth = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(order)) - 1
    found = F.col("target").isNotNull()
    out = out.withColumn("is_inherited", found & F.col(own).isNull()).withColumn("depth", F.when(found, depth))
    return out.drop("island", "chain")


def followers(rows: DataFrame, keys: list[str], order: str, own: str) -> DataFrame:
    """For each line with an own link, how many lines below take it over."""
    up_to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    islands = rows.withColumn("island", F.count(own).over(up_to)).where("island > 0")
    return islands.groupBy(*keys, "island").agg(F.min(order).alias(order), (F.count("*") - 1).alias("n_followers")).drop("island")


def windows(rows: DataFrame, keys: list[str], order: str, own: str) -> DataFrame:
    """rows with lo and hi, the own targets nearest above and below, and the width between."""
    out = rows.withColumn("lo", F.last(own, ignorenulls=True).over(_before(keys, order))).withColumn("hi", F.first(own, ignorenulls=True).over(_after(keys, order)))
    return out.withColumn("width", F.greatest(F.lit(1), F.col("hi") - F.col("lo") + 1))


def gaps(rows: DataFrame, keys: list[str], order: str, own: str) -> DataFrame:
    """Lines without a target between two own ones that agree: keys, order, target."""
    out = windows(rows, keys, order, own)
    return out.where(F.col(own).isNull() & (F.col("lo") == F.col("hi"))).select(*keys, order, F.col("lo").alias("target"))


def groups(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Runs of lines of the same value: keys, value, first, last, n."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("value", value)
    marked = marked.withColumn("starts", (~F.col("value").eqNullSafe(F.lag("value").over(by)) | F.lag(F.lit(1)).over(by).isNull()).cast("int"))
    runs = marked.withColumn("run", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first("value").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def order_violations(rows: DataFrame, keys: list[str], order: str, own: str) -> DataFrame:
    """Per key: links, and how many point before the one above them."""
    linked = rows.where(F.col(own).isNotNull())
    back = (F.col(own) < F.lag(own).over(Window.partitionBy(*keys).orderBy(order))).cast("int")
    return linked.withColumn("back", F.coalesce(back, F.lit(0))).groupBy(*keys).agg(F.count("*").alias("n_links"), F.sum("back").alias("n_violations"))

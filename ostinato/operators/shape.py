"""Small helpers to shape results: one-row merges, long metric rows, ordered top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into one row, without a join."""
    names = [c for f in frames for c in f.columns]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in names])


def long_metrics(row: DataFrame, section: str | None = None) -> DataFrame:
    """A one-row frame as ``(metric, value)`` rows (values as double)."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
    out = row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    return out if section is None else out.select(F.lit(section).alias("section"), "*")


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """First row of each key in the given order; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ranked(df: DataFrame, keys: list, order: list, n: int | None = None, name: str = "rank") -> DataFrame:
    """Rank 1..n per key; with ``n`` only the first n rows of each key leave the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out if n is None else out.filter(F.col(name) <= n)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, digits))


def numbered_in_order(df: DataFrame, column: str, name: str = "position") -> DataFrame:
    """Positions 0.. of the rows in the order of a column of distinct values.

    Rows are range-partitioned and numbered inside their partitions; the offsets come from the
    partition sizes, so no task sees all rows.
    """
    from ostinato.session import cut

    placed = cut(df.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return placed.withColumn("_i", inside).join(offsets, "_p").withColumn(
        name, (F.col("_before") + F.col("_i") - 1).cast("int")).drop("_p", "_i", "_before")


def running_total(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Running sum of ``value`` in each key, this row included, for keys of any size.

    Rows are range-partitioned by key and order, so a key with very many rows spans many tasks; each task sums its own part, and what came
    before is joined to the few keys that span several tasks (at most two a task).
    """
    from ostinato.session import cut

    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()).withColumn("_v", value), "ranges")
    sizes = placed.groupBy(*keys, "_p").agg(F.sum("_v").alias("_n"))
    whole = Window.partitionBy(*keys)
    spanning = sizes.withColumn("_parts", F.count("*").over(whole)).filter("_parts > 1")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spanning.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_p") == F.col("_q")])
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = placed.withColumn("_i", inside).join(offsets, same, "left")
    return summed.select(*df.columns, (F.col("_i") + F.coalesce("_before", F.lit(0))).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Rank 1.. of all rows of each key, for keys of any size; rows equal in the whole order are numbered as they come."""
    return running_total(df, keys, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))

"""Running sums in the order of a column over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, column: str, value: str, name: str, ranges: int = 64) -> DataFrame:
    """``df``, of distinct values of ``column``, with the sum ``name`` of ``value`` up to each row and ``name``_all over all rows.
    Rows are summed within ``ranges`` of the column, and the sums of lower ranges are added; only the ranges' edges, taken from
    approximate quantiles, reach the driver. Where the edges lie changes how rows are dealt, never a result."""
    edges = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e <= F.col(column))) if edges else F.lit(0)
    rows = df.withColumn("_range", F.coalesce(F.greatest(place, F.lit(0)), F.lit(0)))
    each = rows.groupBy("_range").agg(F.sum(value).alias("_own"))
    # as many rows as ranges
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_range", F.coalesce(F.sum("_own").over(up), F.lit(0)).alias("_below"), F.sum("_own").over(Window.partitionBy()).alias(f"{name}_all"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(column))
    return rows.join(F.broadcast(each), "_range").withColumn(name, own + F.col("_below")).drop("_range", "_below")

"""Records of which several revisions exist, over two times: when one was published and when it became known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_at(revisions: DataFrame, asks: DataFrame, key: str, known: Column, published: Column, order: Column, value: Column, at: Column, span: int = 30 * 86400) -> DataFrame:
    """``asks`` with ``value`` of the revision of the same key last published (ties: greatest ``order``) of those known at ``at``; null where none was.

    Both sides are sorted together by time and a running greatest revision is taken, so there is no join by inequality. Time is cut in
    spans: a key's rows of one span are one window's, and what earlier spans leave is a window over one row a span, so a
    key that holds most rows is many tasks'.
    """
    best = F.struct(published.alias("p"), order.alias("o"), value.alias("v"))
    own = [F.col(c) for c in asks.columns]
    left = revisions.select(F.col(key).alias("_k"), known.cast("timestamp").alias("_t"), F.lit(0).alias("_ask"), best.alias("_best"), F.lit(None).cast(asks.schema).alias("_row"))
    right = asks.select(F.col(key).alias("_k"), at.cast("timestamp").alias("_t"), F.lit(1).alias("_ask"), F.lit(None).cast(left.schema["_best"].dataType).alias("_best"), F.struct(*own).alias("_row"))
    both = left.unionByName(right).withColumn("_span", F.floor(F.unix_timestamp("_t") / span))
    within = Window.partitionBy("_k", "_span").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    spans = both.groupBy("_k", "_span").agg(F.max("_best").alias("_most"))
    before = Window.partitionBy("_k").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("_k", "_span", F.max("_most").over(before).alias("_before"))
    run = both.withColumn("_run", F.max("_best").over(within)).where("_ask = 1")
    found = run.join(carried, run["_k"].eqNullSafe(carried["_k"]) & run["_span"].eqNullSafe(carried["_span"]))
    return found.select("_row.*", F.greatest("_run", "_before")["v"].alias("known_value"))

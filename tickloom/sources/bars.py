"""Bars from ticks, and the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the canonical bar schema.
BARS = "symbol string, timeframe string, session_id string, bar_ts timestamp, bar_idx int, open double, high double, low double, close double, volume double, turnover double, is_closed boolean, source string, source_seq long, ingested_at timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(bars: DataFrame) -> DataFrame:
    """``bars`` with bar_idx, from 0 along each symbol's time."""
    return bars.withColumn("bar_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts")) - 1)


def ohlcv(ticks: DataFrame, symbol, bar_ts, price, volume, order) -> DataFrame:
    """One bar per symbol and time: open and close by ``order``, aggregated before the shuffle."""
    made = ticks.groupBy(symbol.alias("symbol"), bar_ts.alias("bar_ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("double").alias("volume")
    )
    return numbered(made)


def bars_from_events(spark: SparkSession, sf_dir: str, hours: int = 4) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / (hours * 3600)) * (hours * 3600))
    return ohlcv(e, F.col("event_type"), start, F.col("value"), F.count("*"), F.struct("ts", "event_id"))


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ohlcv(li, F.col("l_returnflag"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")), F.col("l_extendedprice") / F.col("l_quantity"), F.sum("l_quantity"), order)


def bars_from_supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier's unit prices: many symbols, each with hundreds of bars."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return ohlcv(li, F.col("l_suppkey"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")), F.col("l_extendedprice") / F.col("l_quantity"), F.sum("l_quantity"), order)


#: The same bars in the oracle's SQL.
EVENTS_SQL = """select *, cast(row_number() over (partition by symbol order by bar_ts) - 1 as int) as bar_idx from (
select event_type as symbol, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') as bar_ts, arg_min(value, (ts, event_id)) as open, max(value) as high,
min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume from events group by 1, 2)"""
LINEITEM_SQL = """select *, cast(row_number() over (partition by symbol order by bar_ts) - 1 as int) as bar_idx from (
select l_returnflag as symbol, date_trunc('day', l_shipdate) as bar_ts, arg_min(p, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as open, max(p) as high, min(p) as low,
arg_max(p, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as close, sum(l_quantity) as volume
from (select *, l_extendedprice / l_quantity as p from lineitem) group by 1, 2)"""
SUPPLIES_SQL = """select *, cast(row_number() over (partition by symbol order by bar_ts) - 1 as int) as bar_idx from (
select l_suppkey as symbol, date_trunc('day', l_shipdate) as bar_ts, arg_min(p, (l_orderkey, l_linenumber, l_partkey)) as open, max(p) as high, min(p) as low,
arg_max(p, (l_orderkey, l_linenumber, l_partkey)) as close, sum(l_quantity) as volume
from (select *, l_extendedprice / l_quantity as p from lineitem) group by 1, 2)"""

"""Structured Streaming: bars from ticks with a watermark, idempotent signals with direction flips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.text import key_of


def stream_bars(ticks: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Closed bars (symbol, bar_ts, OHLCV) of ticks (symbol, ts, price, seq); later ticks than ``late`` are dropped. Works on batches too."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def signal_key(*columns: str):
    return key_of(*[F.col(c).cast("string") for c in columns])


def once(signals: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each signal once, with its key: repeated deliveries within the watermark go."""
    return signals.withColumn("signal_key", signal_key(*keys)).withWatermark("bar_ts", late).dropDuplicatesWithinWatermark(["signal_key"])


def status(signals: DataFrame, now, stale_seconds: int, least_bars: int) -> DataFrame:
    """OK, INSUFFICIENT (too few bars yet) or ERROR (the last closed bar is too old)."""
    old = F.unix_timestamp(now) - F.unix_timestamp("bar_ts") > stale_seconds
    return signals.withColumn("status", F.when(F.col("bars") < least_bars, "INSUFFICIENT").when(old, "ERROR").otherwise("OK"))


def flips(signals: DataFrame) -> DataFrame:
    """Changes of direction (symbol, bar_ts, direction, before) of a stream of signals (symbol, bar_ts, direction); none for
    a symbol's first signal. The state of a symbol is its last direction and bar; bars up to that one are skipped."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("bar_ts")
        out = []
        for ts, direction in zip(rows["bar_ts"], rows["direction"], strict=True):
            us = int(ts.value // 1000)
            if at is not None and us <= at:
                continue
            if last is not None and direction != last:
                out.append((key[0], ts, direction, last))
            last, at = direction, us
        state.update((last, at))
        yield pd.DataFrame(out, columns=["symbol", "bar_ts", "direction", "before"])

    return signals.groupBy("symbol").applyInPandasWithState(run, "symbol string, bar_ts timestamp, direction string, before string", "last string, at long", "append", GroupStateTimeout.NoTimeout)


def flips_batch(signals: DataFrame) -> DataFrame:
    """The same over a table."""
    from pyspark.sql import Window

    before = F.lag("direction").over(Window.partitionBy("symbol").orderBy("bar_ts"))
    return signals.withColumn("before", before).where(F.col("direction") != F.col("before")).select("symbol", "bar_ts", "direction", "before")

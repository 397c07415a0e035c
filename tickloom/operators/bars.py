"""Checks, de-duplication and upkeep of bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_bar(mode: str = "model") -> Column:
    """Whether a bar holds: ``model`` and ``frame`` ask for positive prices in order and volume from 0,
    ``upload`` also takes no volume at all, ``density`` only finite prices in order, ``action`` allows 1e-12 of slack."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    o, h, low, c = prices
    finite = lambda x: F.coalesce(F.abs(x) <= 1.7976931348623157e308, F.lit(False))
    every = lambda f: f(o) & f(h) & f(low) & f(c)
    slack = 1e-12 if mode == "action" else 0.0
    ordered = (h >= F.greatest(o, c, low) - slack) & (low <= F.least(o, c, h) + slack)
    positive = every(lambda x: x > 0)
    volume = {"model": F.col("volume") >= 0, "frame": finite(F.col("volume")) & (F.col("volume") >= 0), "upload": F.col("volume").isNull() | (F.col("volume") >= 0)}.get(mode, F.lit(True))
    return F.coalesce(every(finite) & ordered & (F.lit(True) if mode == "density" else positive) & volume, F.lit(False))


def backwards(rows: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """Rows whose time lies before that of the row that came in just before them."""
    return rows.withColumn("_before", F.lag(ts).over(Window.partitionBy(key).orderBy(seq))).where(F.col(ts) < F.col("_before")).drop("_before")


def closed_for_all(bars: DataFrame) -> DataFrame:
    """Bars of the times that are closed for every symbol."""
    return bars.withColumn("_all", F.min("is_closed").over(Window.partitionBy("bar_ts"))).where("_all").drop("_all")


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol; bar_idx has no gaps, so one small aggregate finds them."""
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    return bars.join(last, "symbol").where(F.col("bar_idx") > F.col("_last") - n).drop("_last")


def dedupe(rows: DataFrame, keys: list[str], seq: str, policy: str) -> DataFrame:
    """One row a key: the ``last`` or the ``first`` one, or ``last_at_first``: the last values at the first place. Aggregated before the shuffle."""
    s = F.struct(*[c for c in rows.columns if c not in keys])
    pick = F.min_by(s, seq) if policy == "first" else F.max_by(s, seq)
    out = rows.groupBy(*keys).agg(pick.alias("s"), F.min(seq).alias("_first")).select(*keys, "s.*", "_first")
    return (out.withColumn(seq, F.col("_first")) if policy == "last_at_first" else out).drop("_first")


def changes(stored: DataFrame, remote: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer difference with change: inserted, revised, unchanged or kept (only stored), and the values to keep."""
    a = stored.select(*keys, F.struct(*values).alias("_old"))
    b = remote.select(*keys, F.struct(*values).alias("_new"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("revised")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"), F.coalesce("_new", "_old").alias("s")).select(*keys, "change", "s.*")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last writer by ``seq`` wins; on a tie the fresh row does."""
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    s = F.struct(*[c for c in stored.columns if c not in keys])
    return both.groupBy(*keys).agg(F.max_by(s, F.struct(seq, "_fresh")).alias("s")).select(*keys, "s.*")


def mark_deleted(rows: DataFrame, gone: DataFrame, key: str, when: Column) -> DataFrame:
    """Rows whose key is in ``gone`` get deleted_at; others keep theirs."""
    g = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return rows.join(g, key, "left").withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", when)).otherwise(F.col("deleted_at"))).drop("_gone")


def revive(rows: DataFrame, synced: DataFrame, key: str) -> DataFrame:
    """A new sync clears the mark."""
    g = synced.select(key).distinct().withColumn("_back", F.lit(True))
    return rows.join(g, key, "left").withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at"))).drop("_back")


def prune(rows: DataFrame, ts: str, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def repair_status(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Per key: repaired (all bars there), partial, failed (none) or skipped (nothing expected)."""
    n = actual.groupBy(key).agg(F.count("*").alias("found"))
    j = expected.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return j.withColumn("status", F.when(F.col("expected") == 0, "skipped").when(F.col("found") >= F.col("expected"), "repaired").when(F.col("found") > 0, "partial").otherwise("failed"))


def keep_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; rows with a null key all stay."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    s = F.struct(*[c for c in rows.columns if c not in keys])
    latest = rows.where(~null).groupBy(*keys).agg(F.max_by(s, F.struct(*order)).alias("s")).select(*keys, "s.*")
    return latest.select(*rows.columns).unionByName(rows.where(null))


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest dotted version, compared by its numbers."""
    parts = F.transform(F.split(F.col(version), r"\."), lambda x: x.cast("int"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), parts).alias("s")).select("s.*")


#: Compact forms of a session's time beside ISO, with their lengths.
SESSION_FORMS = (("yyyyMMddHHmmss", 14), ("yyyyMMddHHmm", 12), ("yyyyMMdd", 8), ("yyyy/MM/dd HH:mm:ss", 19), ("yyyy/MM/dd", 10))


def session_time(c: Column) -> Column:
    """A session id's instant; times without a zone are UTC, what can't be read is null."""
    s = F.trim(c)
    tries = [F.when((F.length(s) == n) & ~s.contains("-"), F.try_to_timestamp(s, F.lit(f))) for f, n in SESSION_FORMS]
    return F.coalesce(*tries, F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp")))


def epoch_time(c: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds by their size."""
    a = F.abs(c)
    return F.when(a < 10**11, F.timestamp_seconds(c)).when(a < 10**14, F.timestamp_millis(c)).when(a < 10**17, F.timestamp_micros(c)).otherwise(F.timestamp_micros(F.floor(c / 1000).cast("long")))


def number_of(c: Column) -> Column:
    """A number written with thousands commas, spaces or a percent sign."""
    return F.regexp_replace(F.trim(c), "[,%\\s]", "").try_cast("double")


def market_code(symbol: Column) -> Column:
    """Market number and digits of a listed share: 1. for codes from 5, 6 or 9, 0. for others; null where there are no six digits."""
    code = F.regexp_extract(F.upper(symbol), r"(\d{6})", 1)
    return F.when(code == "", None).otherwise(F.concat(F.when(code.rlike("^[569]"), "1.").otherwise("0."), code))


def timeframe_seconds(c: Column) -> Column:
    """``15m``, ``4h``, ``1d``, ``1w`` in seconds."""
    unit = F.create_map(*[x for k, v in {"m": 60, "h": 3600, "d": 86400, "w": 604800}.items() for x in (F.lit(k), F.lit(v))])
    return F.regexp_extract(c, r"^(\d+)", 1).try_cast("int") * unit[F.right(F.lower(c), F.lit(1))]

"""Provider payloads, feeds and text sinks of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import BARS

CHART = "struct<timestamp: array<bigint>, open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>"


def from_arrays(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Charts of parallel arrays: a row a bar; the last one is not closed yet; rows without a price go."""
    p = payloads.withColumn("_p", F.from_json(column, CHART))
    rows = p.select("symbol", F.size("_p.timestamp").alias("_n"), F.posexplode(F.arrays_zip(*[F.col(f"_p.{c}") for c in ("timestamp", "open", "high", "low", "close", "volume")])).alias("_i", "b"))
    made = rows.select("symbol", F.timestamp_seconds("b.timestamp").alias("bar_ts"), "b.open", "b.high", "b.low", "b.close", "b.volume", (F.col("_i") < F.col("_n") - 1).alias("is_closed"))
    return made.where("open is not null and high is not null and low is not null and close is not null")


def from_lines(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Klines as ``date,open,close,high,low,volume`` lines in a JSON array."""
    line = payloads.select("symbol", F.explode(F.from_json(column, "array<string>")).alias("_l")).withColumn("v", F.split("_l", ","))
    return line.select("symbol", F.to_timestamp(F.col("v")[0]).alias("bar_ts"), *[F.col("v")[i].try_cast("double").alias(n) for i, n in ((1, "open"), (3, "high"), (4, "low"), (2, "close"), (5, "volume"))])


def from_positions(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Klines as arrays [date, open, close, high, low, volume] of strings."""
    row = payloads.select("symbol", F.explode(F.from_json(column, "array<array<string>>")).alias("v"))
    return row.select("symbol", F.to_timestamp(F.col("v")[0]).alias("bar_ts"), *[F.col("v")[i].try_cast("double").alias(n) for i, n in ((1, "open"), (3, "high"), (4, "low"), (2, "close"), (5, "volume"))])


def board(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Ranking boards: rows of JSON by place, without those of no amount or of excluded names."""
    p = payloads.select(F.posexplode(F.from_json(column, "array<struct<code: string, name: string, amount: double>>")).alias("place", "r")).select((F.col("place") + 1).alias("place"), "r.*")
    return p.where((F.col("amount") > 0) & ~F.col("name").rlike(r"^(\*?ST|N|C)|退"))


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """RSS or Atom entries: title, link, published (first of four date fields), summary."""
    x = spark.read.format("xml").option("rowTag", tag).schema("title string, link string, pubDate string, published string, updated string, date string, description string, summary string").load(path)
    written = F.coalesce("pubDate", "published", "updated", "date")
    return x.select("title", "link", F.coalesce(F.try_to_timestamp(written, F.lit("EEE, dd MMM yyyy HH:mm:ss Z")), written.try_cast("timestamp")).alias("published"), F.coalesce("description", "summary").alias("summary"))


def feeds_csv(spark: SparkSession, path: str) -> DataFrame:
    """A list of feeds: name, url, enabled, tags, with quotes doubled inside quotes."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").schema("name string, url string, enabled boolean, tags string").csv(path)


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """Bars as JSON lines; a row that doesn't fit the schema fails the read."""
    return spark.read.schema(BARS).option("mode", "FAILFAST").json(path)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def line_protocol(measurement: str, tags: list[str], fields: dict[str, Column], ts: Column) -> Column:
    """A point as text: escaped tags, typed fields (nulls and non-finite numbers left out), nanoseconds."""
    safe = lambda c: F.regexp_replace(c.cast("string"), r"([,= ])", r"\\$1")
    own = F.array_compact(F.array(*[F.when(F.abs(v.cast("double")) <= 1.7976931348623157e308, F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in fields.items()]))
    return F.concat_ws(" ", F.concat_ws(",", F.lit(measurement), *[F.concat(F.lit(f"{t}="), safe(F.col(t))) for t in tags]), F.array_join(own, ","), (F.unix_micros(ts) * 1000).cast("string"))


def write_csv(bars: DataFrame, path: str) -> None:
    bars.select("bar_ts", "open", "high", "low", "close", "volume").write.option("header", True).csv(path)


def report(row: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("document"))


def fingerprint(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """A hash of each ``by``'s rows: hashes of rows in order, hashed; only 64 bytes a row meet."""
    h = rows.select(by, F.struct(*keys).alias("k"), F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("h"))
    return h.groupBy(by).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), ""), 256).alias("hash"))

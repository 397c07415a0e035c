"""Queries over payloads, streams, lookups and schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.filters import filtered
from tickloom.operators import levels as L
from tickloom.operators import schedule as G
from tickloom.plans.catalog import query
from tickloom.plans.market_queries import BE, r6
from tickloom.sources import payloads as P
from tickloom.sources.bars import bars_from_events, table
from tickloom.sources.shared import with_checkpoints
from tickloom.streaming import signals as Z

OHLC = ("open", "high", "low", "close", "volume")


def _values(c: str):
    return F.transform("s", lambda x: x[c]).alias(c)


def _chart(spark, d) -> DataFrame:
    b = bars_from_events(spark, d).withColumn("block", F.floor(F.col("bar_idx") / 50))
    s = F.array_sort(F.collect_list(F.struct("bar_ts", *OHLC)))
    each = b.groupBy("symbol", "block").agg(s.alias("s"))
    at = F.transform("s", lambda x: F.unix_timestamp(x["bar_ts"])).alias("timestamp")
    return each.select("symbol", F.to_json(F.struct(at, *map(_values, OHLC))).alias("payload"))


@query("source_chart_arrays", f"select symbol, cast(epoch(bar_ts) as bigint) as t, open, high, low, close, volume, bar_idx % 50 <> 49 and bar_idx <> max(bar_idx) over (partition by symbol) as is_closed from {BE}")
def source_chart(spark, d):
    return P.from_arrays(_chart(spark, d)).select("symbol", F.unix_timestamp("bar_ts").alias("t"), *OHLC, "is_closed")


for _name, _parse, _shape in (("source_kline_lines", P.from_lines, "line"), ("source_kline_positions", P.from_positions, "row")):

    @query(_name, f"select symbol, cast(epoch(bar_ts) as bigint) as t, open, high, low, close, volume from {BE}")
    def source_kline(spark, d, parse=_parse, shape=_shape):
        b = bars_from_events(spark, d)
        own = [F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss"), *[F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume")]]
        made = b.groupBy("symbol", F.floor(F.col("bar_idx") / 50).alias("k")).agg(F.to_json(F.collect_list(F.concat_ws(",", *own) if shape == "line" else F.array(*own))).alias("payload"))
        return parse(made).select("symbol", F.unix_timestamp("bar_ts").alias("t"), *OHLC)


@query("source_ranking_board", "select row_number() over (order by s_suppkey) as place, 'c' || s_suppkey as code, s_acctbal as amount from supplier qualify s_acctbal > 0 and s_suppkey % 5 <> 0")
def source_board(spark, d):
    s = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 5 == 0, "ST x").otherwise("plain")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_acctbal", name.alias("n")))), lambda x: F.struct(F.concat(F.lit("c"), x["s_suppkey"]).alias("code"), x["n"].alias("name"), x["s_acctbal"].alias("amount")))
    return P.board(s.agg(F.to_json(rows).alias("payload"))).select(F.col("place").cast("long").alias("place"), "code", "amount")


@query("line_protocol", f"select 'market_bar,symbol=' || symbol || ' volume=' || cast(cast(volume as bigint) as varchar) || ' ' || cast(cast(epoch(bar_ts) as bigint) as varchar) || '000000000' as line from {BE}")
def line_protocol(spark, d):
    return bars_from_events(spark, d).select(P.line_protocol("market_bar", ["symbol"], {"volume": F.col("volume").cast("long"), "nothing": F.lit(None).cast("double")}, F.col("bar_ts")).alias("line"))


@query("csv_round_trip", f"select cast(epoch(bar_ts) as bigint) as t, open, high, low, close, volume from {BE}")
def csv_round_trip(spark, d):
    path = f"{with_checkpoints(spark)}/csv-{uuid.uuid4().hex}"
    P.write_csv(bars_from_events(spark, d), path)
    return spark.read.schema("bar_ts timestamp, open double, high double, low double, close double, volume double").option("header", True).csv(path).select(F.unix_timestamp("bar_ts").alias("t"), *OHLC)


@query("dataset_fingerprints")
def fingerprints(spark, d):
    return P.fingerprint(bars_from_events(spark, d).select("symbol", "bar_idx", *OHLC), ["bar_idx"], "symbol")


@query("json_props", "select event_id, cast(props->>'k' as bigint) as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("records_with_title", "select o_orderkey, coalesce(c_name, '') as title from orders left join customer on o_custkey = c_custkey and c_mktsegment = 'BUILDING'")
def records_with_title(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("title"))


@query("watch_semi_join", "select count(*) as n from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def watch_semi(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").agg(F.count("*").alias("n"))


@query("nearest_level", "select o_orderkey, arg_min(p_partkey, (abs(p_retailprice - o_totalprice % 2000), p_partkey)) as level from orders join part on p_size = o_custkey % 50 + 1 group by 1")
def nearest_level(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 2000).alias("x"), (F.col("o_custkey") % 50 + 1).alias("p_size"))
    parts = table(spark, d, "part").select(F.col("p_size").cast("long").alias("p_size"), "p_partkey", "p_retailprice")
    return L.nearest(o, "o_orderkey", "p_size", "x", parts, "p_retailprice", "p_partkey")


@query("page_of_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def page_of_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("facets", "select distinct o_orderpriority as facet, count(*) over (partition by o_orderpriority) as n from orders")
def facets(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("facet")).agg(F.count("*").alias("n"))


@query("stock_snapshots", f"""select symbol, round(100 * (last / first - 1), 6) as change, round(sd * sqrt(252e0), 6) as volatility, round(v * last, 6) as turnover from (select symbol, arg_max(close, bar_idx) as last, arg_min(close, bar_idx) as first, stddev_samp(r) as sd, avg(volume) as v from (
select *, close / lag(close) over (partition by symbol order by bar_idx) - 1 as r from {BE} qualify row_number() over (partition by symbol order by bar_idx desc) <= 21) group by 1)""")  # fmt: skip
def stock_snapshots(spark, d):
    from pyspark.sql import Window

    from tickloom.operators.bars import tail

    s = Window.partitionBy("symbol").orderBy("bar_idx")
    b = tail(bars_from_events(spark, d).withColumn("r", F.col("close") / F.lag("close").over(s) - 1), 21)
    a = b.groupBy("symbol").agg(F.max_by("close", "bar_idx").alias("last"), F.min_by("close", "bar_idx").alias("first"), F.stddev_samp("r").alias("sd"), F.avg("volume").alias("v"))
    return a.select("symbol", (100 * (F.col("last") / F.col("first") - 1)).alias("change"), (F.col("sd") * F.sqrt(F.lit(252.0))).alias("volatility"), (F.col("v") * F.col("last")).alias("turnover")).select("symbol", *r6("change", "volatility", "turnover"))


# ------------------------------------------------------------------ schedules


@query("due_times", "select plan, cast(epoch(s) as bigint) + k * seconds as t from (select c_custkey as plan, timestamp '2024-01-01' + c_custkey % 24 * interval 1 hour as s, (c_custkey % 5 + 1) * 21600 as seconds, unnest(range(0, 20)) as k from customer) where epoch(s) + k * seconds <= epoch(timestamp '2024-01-03')")
def due_times(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"), F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") % 24 * 3600).alias("start"), ((F.col("c_custkey") % 5 + 1) * 21600).alias("seconds"))
    return G.due(p, F.lit("2024-01-03").cast("timestamp")).select("plan", F.unix_timestamp("fire_at").alias("t"))


@query("dag_levels", "with recursive e as (select s_suppkey as before, s_suppkey * 2 as after from supplier where s_suppkey > 0 union select s_suppkey, s_suppkey * 3 from supplier where s_suppkey > 0), w(node, level) as (select distinct before, 0 from e where before not in (select after from e) union all select e.after, w.level + 1 from w join e on e.before = w.node) select node, max(level) as level from w group by 1")
def dag_levels(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey > 0").select("s_suppkey")
    e = s.select(F.col("s_suppkey").alias("before"), F.explode(F.array(F.col("s_suppkey") * 2, F.col("s_suppkey") * 3)).alias("after"))
    return G.levels(spark, e)


@query("task_gates", "select id, case when d is null then 'READY' when coalesce(ds, 'FAILED') = 'FAILED' then 'BLOCKED' when ds = 'SUCCESS' then 'READY' else 'WAITING' end as gate from (select a.c_custkey as id, case when a.c_custkey % 4 <> 0 then a.c_custkey + 1 end as d, case when b.c_custkey is null then null when b.c_custkey % 3 = 0 then 'SUCCESS' when b.c_custkey % 3 = 1 then 'FAILED' else 'RUNNING' end as ds from customer a left join customer b on b.c_custkey = case when a.c_custkey % 4 <> 0 then a.c_custkey + 1 end)")
def task_gates(spark, d):
    c = table(spark, d, "customer")
    state = F.when(F.col("c_custkey") % 3 == 0, "SUCCESS").when(F.col("c_custkey") % 3 == 1, "FAILED").otherwise("RUNNING")
    return G.gates(c.select(F.col("c_custkey").alias("id"), state.alias("state"), F.when(F.col("c_custkey") % 4 != 0, F.array(F.col("c_custkey") + 1)).otherwise(F.array().cast("array<bigint>")).alias("depends_on")))


@query("trading_days", "select distinct cast(epoch(date_trunc('day', o_orderdate)) as bigint) as t, dayofweek(o_orderdate) not in (0, 6) and o_orderdate::date <> date '1995-01-02' as trading from orders")
def trading_days(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select(F.unix_timestamp(F.col("day").cast("timestamp")).alias("t"), G.trading_day(F.col("day"), F.array(F.lit("1995-01-02").cast("date"))).alias("trading"))


# ------------------------------------------------------------------ streams


def _streamed(spark, df: DataFrame, transform, schema: DataFrame, files: int = 4) -> DataFrame:
    """A table as a stream of ``files`` a step through ``transform`` into Parquet, all of it; both lie in the shared folder."""
    base = f"{with_checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    out = transform(source)
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(schema.schema).parquet(f"{base}/out")


@query("stream_bars", f"select symbol, cast(epoch(bar_ts) as bigint) as t, open, high, low, close, volume from {BE}")
def stream_bars(spark, d):
    ticks = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))
    # a last tick far ahead lets the watermark close every bar
    last = ticks.groupBy("symbol").agg(F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("seq"))
    f = lambda t: Z.stream_bars(t, late="60 days")
    # all files in one step, so that none is behind the watermark of another one
    made = _streamed(spark, ticks.unionByName(last), f, f(ticks), 2**31 - 1)
    return made.where("bar_ts < '2029-01-01'").select("symbol", F.unix_timestamp("bar_ts").alias("t"), "open", "high", "low", "close", "volume")


def _directions(spark, d) -> DataFrame:
    b = bars_from_events(spark, d)
    return b.select("symbol", "bar_ts", F.when(F.col("close") > F.col("open"), "LONG").otherwise("SHORT").alias("direction"))


_FLIPS = f"select symbol, cast(epoch(bar_ts) as bigint) as t, direction, before from (select symbol, bar_ts, direction, lag(direction) over (partition by symbol order by bar_ts) as before from (select *, case when close > open then 'LONG' else 'SHORT' end as direction from {BE})) where direction <> before"


@query("flip_events", _FLIPS)
def flip_events(spark, d):
    return Z.flips_batch(_directions(spark, d)).select("symbol", F.unix_timestamp("bar_ts").alias("t"), "direction", "before")


@query("stream_flip_events", _FLIPS)
def stream_flips(spark, d):
    s = _directions(spark, d)
    return _streamed(spark, s.coalesce(1), Z.flips, Z.flips_batch(s)).select("symbol", F.unix_timestamp("bar_ts").alias("t"), "direction", "before")


@query("stream_signals_once", f"select symbol, cast(epoch(bar_ts) as bigint) as t, sha256(symbol || chr(31) || strftime(bar_ts, '%Y-%m-%d %H:%M:%S')) as signal_key from {BE}")
def stream_once(spark, d):
    s = _directions(spark, d)
    f = lambda x: Z.once(x, ["symbol", "bar_ts"], "60 days")
    return _streamed(spark, s.unionByName(s), f, f(s)).select("symbol", F.unix_timestamp("bar_ts").alias("t"), "signal_key")


@query("signal_status", f"select symbol, bar_idx, case when bar_idx + 1 < 20 then 'INSUFFICIENT' when epoch(timestamp '2024-01-31') - epoch(bar_ts) > 864000 then 'ERROR' else 'OK' end as status from {BE}")
def signal_status(spark, d):
    b = bars_from_events(spark, d).withColumn("bars", F.col("bar_idx") + 1)
    return Z.status(b, F.lit("2024-01-31").cast("timestamp"), 864000, 20).select("symbol", "bar_idx", "status")


#: Orders in the middle of the prices of some states, or of the last days, but for one priority.
_FILTER = {"and": [
    {"or": [{"and": [{"column": "o_totalprice", "is": ">=", "value": 100000.5}, {"column": "o_totalprice", "is": "<", "value": 300000}, {"column": "o_orderstatus", "is": "in", "value": ["F", "O"]}]}, {"column": "o_orderdate", "is": ">", "value": "2000-06-01"}]},
    {"not": {"column": "o_orderpriority", "is": "starts", "value": "5"}}, {"column": "o_custkey", "is": "null", "value": False},
]}


@query("user_filter", "select o_orderkey from orders where ((o_totalprice >= 100000.5 and o_totalprice < 300000 and o_orderstatus in ('F', 'O')) or o_orderdate > timestamp '2000-06-01') and not starts_with(o_orderpriority, '5') and o_custkey is not null")
def user_filter(spark, d):
    return filtered(table(spark, d, "orders"), _FILTER).select("o_orderkey")

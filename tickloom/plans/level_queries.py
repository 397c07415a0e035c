"""Queries over price levels, indicators and price action."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import levels as Q
from tickloom.plans.catalog import query
from tickloom.plans.market_queries import BE, r6, s6
from tickloom.sources.bars import bars_from_events, table

W = "partition by symbol order by bar_idx"
TR = f"(select *, greatest(high - low, abs(high - coalesce(lag(close) over ({W}), close)), abs(low - coalesce(lag(close) over ({W}), close))) as tr from {BE})"
ATR = f"(select *, sum(tr) over ({W} rows between 14 preceding and current row) / least(bar_idx + 1, 14) as atr from {TR})"


@query("density_atr", f"select symbol, bar_idx, {s6('tr', 'atr')} from {ATR}")
def density_atr(spark, d):
    return Q.density_atr(bars_from_events(spark, d)).select("symbol", "bar_idx", *r6("tr", "atr"))


def _seeded(x: str, n: int, a: str) -> str:
    return f"case when bar_idx >= {n - 1} then list_reduce(list_concat([list_avg(list({x}) over ({W})[1:{n}])], list({x}) over ({W})[{n + 1}:]), lambda e, v: {a} * v + (1e0 - {a}) * e) end"


IND = f"""(select *, (ema20 - lag(ema20, 5) over ({W})) / atr14 as slope20, lag(ema20, 5) over ({W}) as ema20_lag5 from (
select *, case when bar_idx >= 9 then avg(overlap) over ({W} rows between 9 preceding and current row) end as overlap10,
case when bar_idx >= 20 then case when sum(step) over ({W} rows between 19 preceding and current row) > 0 then abs(close - lag(close, 20) over ({W})) / sum(step) over ({W} rows between 19 preceding and current row) else 0 end end as er20,
case when bar_idx >= 19 then avg(close * volume) over ({W} rows between 19 preceding and current row) end as adv20, {_seeded('close', 20, '(2e0 / 21)')} as ema20, {_seeded('close', 60, '(2e0 / 61)')} as ema60, {_seeded('tr', 14, '(1e0 / 14)')} as atr14 from (
select *, case when high > low then (close - low) / (high - low) else 0.5 end as clv, case when high > low then abs(close - open) / (high - low) else 0 end as body_ratio, abs(close - lag(close) over ({W})) as step,
case when lag(high) over ({W}) > low and lag(low) over ({W}) < high then (least(high, lag(high) over ({W})) - greatest(low, lag(low) over ({W}))) / (greatest(high, lag(high) over ({W})) - least(low, lag(low) over ({W}))) else 1 end as overlap from {TR})))"""
_IND = ("ema20", "ema60", "atr14", "clv", "body_ratio", "overlap10", "er20", "slope20", "adv20")


@query("indicators", f"select symbol, bar_idx, {s6(*_IND)} from {IND}")
def indicators(spark, d):
    return Q.indicators(bars_from_events(spark, d)).select("symbol", "bar_idx", *r6(*_IND))


@query("regimes", f"""select symbol, bar_idx, case when overlap10 is null or er20 is null or slope20 is null then 'INVALID' when overlap10 >= 0.65 and er20 <= 0.2 and abs(slope20) <= 0.25 then 'CHAOS'
when close > ema20 and ema20 > ema60 and slope20 >= 0.25 and er20 >= 0.25 then 'UPTREND' when close < ema20 and ema20 < ema60 and slope20 <= -0.25 then 'DOWNTREND' else 'NEUTRAL' end as regime,
case when ema60 is null or ema20_lag5 is null then 'UNKNOWN' when close > ema60 and ema20 >= ema20_lag5 then 'RISK_ON' else 'RISK_OFF' end as gate from {IND}""")  # fmt: skip
def regimes(spark, d):
    return Q.indicators(bars_from_events(spark, d)).select("symbol", "bar_idx", Q.regime().alias("regime"), Q.market_gate().alias("gate"))


def _pivots(k: int, strict: bool) -> str:
    sides = []
    for kind, c, f, sign in ((1, "high", "max", ">"), (-1, "low", "min", "<")):
        test = f"{c} {sign} {f}({c}) over ({W} rows between {k} preceding and 1 preceding) and {c} {sign} {f}({c}) over ({W} rows between 1 following and {k} following)" if strict else f"{c} = {f}({c}) over ({W} rows between {k} preceding and {k} following)"
        sides.append(f"select symbol, bar_idx, {kind} as kind, {c} as price, bar_idx + {k} as confirm_idx from (select *, {test} as ok, max(bar_idx) over (partition by symbol) as last from {BE}) where ok and bar_idx >= {k} and bar_idx <= last - {k}")
    return " union all ".join(sides)


for _name, _k, _strict in (("fractal_pivots", 2, True), ("fractal_pivots_wide", 5, False)):

    @query(_name, _pivots(_k, _strict))
    def fractal(spark, d, k=_k, strict=_strict):
        return Q.fractals(bars_from_events(spark, d), k, strict)


@query("pivots_visible", f"select symbol, t, count(*) as n, max(price) as top from (select distinct symbol, bar_idx as t from {BE}) join ({_pivots(2, True)}) p using (symbol) where confirm_idx <= t and bar_idx >= t - 60 group by 1, 2")
def pivots_visible(spark, d):
    b = bars_from_events(spark, d)
    at = b.select("symbol", F.col("bar_idx").alias("t"))
    return Q.visible(Q.fractals(b, 2), at, 60).groupBy("symbol", "t").agg(F.count("*").alias("n"), F.max("price").alias("top"))


@query("zigzag")
def zigzag(spark, d):
    return Q.zigzag(bars_from_events(spark, d))


_PROFILE = f"""(select symbol, bin, sum(w) as volume from (select symbol, v / (hi - lo + 1) as w, unnest(range(lo, hi + 1)) as bin from (select b.symbol, volume as v, least(cast(floor((low - p0) / ((p1 - p0) / 50)) as bigint), 49) as lo, least(cast(floor((high - p0) / ((p1 - p0) / 50)) as bigint), 49) as hi
from {BE} b join (select symbol, min(low) as p0, max(high) as p1 from {BE} group by 1) e on b.symbol = e.symbol)) group by 1, 2)"""
_GRID = f"(select symbol, bin, coalesce(volume, 0e0) as volume from (select distinct symbol, unnest(range(0, 50)) as bin from {BE}) left join {_PROFILE} using (symbol, bin))"


@query("volume_profile", f"select symbol, bin, {s6('volume')} from {_GRID}")
def volume_profile(spark, d):
    return Q.volume_profile(bars_from_events(spark, d)).select("symbol", "bin", *r6("volume"))


@query("profile_blur", f"""select symbol, bin, round(sum(v * k) / sum(k), 6) + 0e0 as volume from (select a.symbol, a.bin, b.volume as v, exp(-0.5e0 * power((a.bin - b.bin) / 1e0, 2)) as k from {_GRID} a join {_GRID} b on a.symbol = b.symbol and abs(a.bin - b.bin) <= 3) group by 1, 2""")
def profile_blur(spark, d):
    return Q.blur(Q.volume_profile(bars_from_events(spark, d)), 1.0).select("symbol", "bin", *r6("volume"))


@query("robust_z", f"""with g as {_GRID}, m as (select symbol, quantile_cont(volume, 0.5) as m, max(volume) as x from g group by 1), s as (select symbol, 1.4826e0 * quantile_cont(abs(volume - m), 0.5) as s from g join m using (symbol) group by 1)
select symbol, bin, round(case when s < 1e-12 then case when x > 1e-12 then volume / x else 0 end else 1 / (1 + exp(-(volume - m) / s / 2)) end, 5) + 0e0 as z from g join m using (symbol) join s using (symbol)""")  # fmt: skip
def robust_z(spark, d):
    return Q.robust_z(Q.volume_profile(bars_from_events(spark, d))).select("symbol", "bin", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("profile_peaks")
def profile_peaks(spark, d):
    return Q.spaced(Q.peaks(Q.blur(Q.volume_profile(bars_from_events(spark, d)), 1.0)), 3)


_ZONES = f"(select symbol, 1 as zone, quantile_cont(close, 0.5) * 0.98 as lo, quantile_cont(close, 0.5) * 1.02 as hi, true as support from {BE} group by 1 union all select symbol, 2, quantile_cont(close, 0.5) * 0.98, quantile_cont(close, 0.5) * 1.02, false from {BE} group by 1)"


def zones(b):
    m = b.groupBy("symbol").agg(F.percentile("close", F.lit(0.5)).alias("m"))
    return m.select("symbol", (F.col("m") * 0.98).alias("lo"), (F.col("m") * 1.02).alias("hi"), F.explode(F.array(F.struct(F.lit(1).alias("zone"), F.lit(True).alias("support")), F.struct(F.lit(2).alias("zone"), F.lit(False).alias("support")))).alias("z")).select("symbol", "z.zone", "lo", "hi", "z.support")


_TOUCH = f"""(with a as {ATR}, e as (select a.symbol, zone, support, lo, hi, atr, bar_idx from (select *, coalesce(lag(close) over ({W}), close) as before from a) a join {_ZONES} z using (symbol) where low <= hi and high >= lo and case when support then before > hi else before < lo end)
select symbol, zone, bar_idx, case when b is null and g is null then null else coalesce(g, 1000000000) <= coalesce(b, 1000000000) end as held from (select e.symbol, e.zone, e.bar_idx,
min(n.bar_idx) filter (where case when support then n.close < e.lo - 0.5 * e.atr else n.close > e.hi + 0.5 * e.atr end) as b, min(n.bar_idx) filter (where case when support then n.high >= e.hi + e.atr else n.low <= e.lo - e.atr end) as g
from e join a n on n.symbol = e.symbol and n.bar_idx between e.bar_idx and e.bar_idx + 10 group by 1, 2, 3))"""


@query("touch_outcomes", f"select * from {_TOUCH}")
def touch_outcomes(spark, d):
    b = bars_from_events(spark, d)
    return Q.touches(b, zones(b))


@query("touch_stats")
def touch_stats(spark, d):
    b = bars_from_events(spark, d)
    t = Q.cooled(Q.touches(b, zones(b))).where("held is not null").groupBy("symbol", "zone").agg(F.count("*").alias("n"), F.sum(F.when(F.col("held"), 1).otherwise(0)).alias("held"))
    lo, hi = Q.wilson(F.col("held"), F.col("n"))
    return t.withColumns({"low": F.round(lo, 6), "high": F.round(hi, 6)})


@query("wilson_bounds", f"""select symbol, zone, n, k, round(greatest(0, (p + 3.8416e0 / (2 * n) - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n))) / (1 + 3.8416e0 / n)), 6) as low from (select symbol, zone, count(held) as n, count(*) filter (where held) as k, count(*) filter (where held) / count(held) as p from {_TOUCH} group by 1, 2 having count(held) > 0)""")
def wilson_bounds(spark, d):
    b = bars_from_events(spark, d)
    t = Q.touches(b, zones(b)).groupBy("symbol", "zone").agg(F.count("held").alias("n"), F.sum(F.when(F.col("held"), 1).otherwise(0)).alias("k")).where("n > 0")
    return t.withColumn("low", F.round(Q.wilson(F.col("k"), F.col("n"))[0], 6))


@query("round_bonus", """select p_partkey, round(case when c > 0 then greatest(0.4e0 * exp(-0.5e0 * power(abs(c - round_even(c / s, 0) * s) / 2, 2)), 0.7e0 * exp(-0.5e0 * power(abs(c - round_even(c / (5 * s), 0) * 5 * s) / 2, 2)), exp(-0.5e0 * power(abs(c - round_even(c / (10 * s), 0) * 10 * s) / 2, 2))) else 0 end, 6) as bonus
from (select p_partkey, p_retailprice as c, power(10e0, floor(log10(p_retailprice)) - 1) as s from part)""")  # fmt: skip
def round_bonus(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(Q.round_bonus(F.col("p_retailprice"), F.lit(10.0)), 6).alias("bonus"))


@query("mtf_band_join", "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_size = b.p_size and a.p_partkey < b.p_partkey and abs(a.p_retailprice - b.p_retailprice) <= 5")
def mtf_band_join(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_size").alias("sa"), F.col("p_retailprice").alias("pa"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_size").alias("sb"), F.col("p_retailprice").alias("pb"))
    return Q.near(a, b, "pa", "pb", F.lit(5.0), 5.0, ("sa", "sb")).where("a < b").select("a", "b")


@query("score_buckets", "select p_size, count(*) as n, len(list_filter([10, 20, 30, 40], lambda e: e <= p_size)) + 1 as bucket from part group by 1, 3")
def score_buckets(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", "n", Q.bucket(F.col("p_size"), [10, 20, 30, 40]).cast("long").alias("bucket"))


@query("sr_probability", "select l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-least(greatest(0.2e0 + (l_quantity - 25) / 14 * 0.5e0 - (l_discount - 0.05e0) / 0.03e0 * 0.7e0, -30), 30))), 6) as p from lineitem")
def sr_probability(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(Q.logistic(["l_quantity", "l_discount"], [25.0, 0.05], [14.0, 0.03], [0.2, 0.5, -0.7]), 6).alias("p"))


@query("auc_brier", """select round((sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as auc, round(avg(power(p - y, 2)), 6) as brier from (
select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2e0 as r from (select l_discount * 10 as p, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem))""")  # fmt: skip
def auc_brier(spark, d):
    s = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return Q.auc_brier(s, "p", "y").select(F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))


@query("logistic_fit")
def logistic_fit(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.log1p("n_chars").alias("size"), (F.size(F.split("text", "\n")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("lines"), F.col("quality").cast("double").alias("y"))
    m = Q.fit_logistic(docs, ["size", "lines"], "y")
    return Q.auc_brier(docs.withColumn("p", Q.logistic(m["columns"], m["mean"], m["sd"], m["coef"])), "p", "y")


@query("level_zones")
def level_zones(spark, d):
    return Q.level_zones(bars_from_events(spark, d))


@query("swing_structure", f"""select symbol, case when h1 > h2 and l1 > l2 then 'UP' when h1 < h2 and l1 < l2 then 'DOWN' else 'RANGE' end as structure from (select symbol, max(price) filter (where kind = 1 and n = 1) as h1, max(price) filter (where kind = 1 and n = 2) as h2, max(price) filter (where kind = -1 and n = 1) as l1,
max(price) filter (where kind = -1 and n = 2) as l2 from (select *, row_number() over (partition by symbol, kind order by bar_idx desc) as n from ({_pivots(2, True)})) group by 1)""")  # fmt: skip
def swing_structure(spark, d):
    return Q.swings(Q.fractals(bars_from_events(spark, d), 2))


@query("pa_breakouts", f"select symbol, bar_idx, kind from (select symbol, bar_idx, case when close > max(high) over ({W} rows between unbounded preceding and 1 preceding) then 1 when close < min(low) over ({W} rows between unbounded preceding and 1 preceding) then -1 end as kind from {BE}) where kind is not null")
def pa_breakouts(spark, d):
    return Q.breakouts(bars_from_events(spark, d)).select("symbol", "bar_idx", "kind")


@query("volume_state", f"""select symbol, bar_idx, round(ratio, 6) + 0e0 as ratio, case when ratio >= 1.2 then 'EXPANDING' when ratio <= 0.8 then 'CONTRACTING' else 'NORMAL' end as state from (select symbol, bar_idx, avg(volume) over ({W} rows between 4 preceding and current row) / avg(volume) over ({W} rows between 24 preceding and 5 preceding) as ratio from {BE})""")
def volume_state(spark, d):
    return Q.volume_state(bars_from_events(spark, d)).select("symbol", "bar_idx", *r6("ratio"), "state")


@query("position_size", "select p_partkey, case when s >= e then 0 else cast(floor(floor(250e0 / (greatest(e - s, 0.01e0) + 0.25e0)) / 100) * 100 as bigint) end as shares from (select p_partkey, p_retailprice / 100 as e, p_retailprice / 100 - (p_partkey % 5) * 0.2e0 as s from part)")
def position_size(spark, d):
    e = F.col("p_retailprice") / 100
    return table(spark, d, "part").select("p_partkey", Q.size_position(F.lit(100000.0), e, e - (F.col("p_partkey") % 5) * 0.2, F.lit(0.5)).alias("shares"))


@query("retest_strategy")
def retest_strategy(spark, d):
    return Q.retest_strategy(Q.with_resistance(bars_from_events(spark, d)))


@query("mtf_fusion", """select symbol, round(up, 6) + 0e0 as up, round(down, 6) + 0e0 as down, round(coverage, 6) as coverage, round((up - down) * (1 - 0.45e0 * least(up, down) / greatest(up, down, 1e-9)), 6) + 0e0 as score from (
select event_type as symbol, sum(case when m > 0 then w * m else 0 end) as up, sum(case when m < 0 then -w * m else 0 end) as down, sum(w) / 1.0e0 as coverage from (select event_type, k as tf, avg(value) / 245e0 - 1 as m from (select *, event_id % 3 as k from events) group by 1, 2) join (values (0, 0.4e0), (1, 0.3e0), (2, 0.2e0), (3, 0.1e0)) r(k, w) on k = tf group by 1)""")  # fmt: skip
def mtf_fusion(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), (F.col("event_id") % 3).cast("string").alias("timeframe")).agg((F.avg("value") / 245 - 1).alias("score"))
    roles = spark.createDataFrame([("0", "trend", 0.4), ("1", "setup", 0.3), ("2", "entry", 0.2), ("3", "timing", 0.1)], "timeframe string, role string, weight double")
    return Q.fuse(e, roles).select("symbol", *r6("up", "down", "coverage", "score"))

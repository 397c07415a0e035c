"""Queries over bars: upkeep, backtests and factor scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import Duck, Program, X
from tickloom.operators import backtest as B
from tickloom.operators import bars as K
from tickloom.operators import mining as M
from tickloom.plans import formula
from tickloom.plans.catalog import query
from tickloom.sources.bars import EVENTS_SQL, LINEITEM_SQL, bars_from_events, bars_from_lineitem, table

BE = f"({EVENTS_SQL})"
SIGNAL = [formula.token("RET"), formula.token("TS_MEAN_5")]


def r6(*names: str) -> list:
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 as {n}" for n in names)


def epoch():
    return F.unix_timestamp("bar_ts").alias("t")


@query("ohlcv_bars", f"select symbol, bar_idx, cast(epoch(bar_ts) as bigint) as t, open, high, low, close, volume from {BE}")
def ohlcv_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars_from_events(spark, d).select("symbol", "bar_idx", epoch(), "open", "high", "low", "close", "volume")


@query("ohlcv_bars_daily", f"select symbol, bar_idx, cast(epoch(bar_ts) as bigint) as t, open, high, low, close, volume from ({LINEITEM_SQL})")
def ohlcv_bars_daily(spark, d):
    return bars_from_lineitem(spark, d).select("symbol", "bar_idx", epoch(), "open", "high", "low", "close", "volume")


_ODD = "case when bar_idx % 7 = 0 then high * 1.01e0 else low end as low, case when bar_idx % 11 = 0 then -1e0 when bar_idx % 13 = 0 then null else volume end as volume, case when bar_idx % 17 = 0 then -open else open end as open"


def odd_bars(spark, d):
    return bars_from_events(spark, d).selectExpr("symbol", "bar_idx", "high", "close", *_ODD.split(", "))


_P, _OK = "open > 0 and high > 0 and low > 0 and close > 0", "high >= greatest(open, close, low) and low <= least(open, close, high)"


@query("bars_valid", f"""select symbol, sum(case when {_P} and {_OK} and volume >= 0 then 1 else 0 end)::bigint as model, sum(case when {_P} and {_OK} and volume >= 0 then 1 else 0 end)::bigint as frame,
sum(case when {_P} and {_OK} and (volume is null or volume >= 0) then 1 else 0 end)::bigint as upload, sum(case when {_OK} then 1 else 0 end)::bigint as density, sum(case when {_P} and {_OK} then 1 else 0 end)::bigint as action
from (select symbol, bar_idx, high, close, {_ODD} from {BE}) group by 1""")  # fmt: skip
def bars_valid(spark, d):
    return odd_bars(spark, d).groupBy("symbol").agg(*[F.sum(F.when(K.valid_bar(m), 1).otherwise(0)).alias(m) for m in ("model", "frame", "upload", "density", "action")])


@query("bars_backwards", "select event_type as symbol, count(*) as n from (select *, lag(ts) over (partition by event_type order by event_id) as b from events) where ts < b group by 1")
def bars_backwards(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return K.backwards(e, "symbol", "ts", "event_id").groupBy("symbol").agg(F.count("*").alias("n"))


@query("bars_closed_for_all", f"select symbol, bar_idx from (select *, min(case when (bar_idx + length(symbol)) % 5 <> 0 then 1 else 0 end) over (partition by bar_ts) as m from {BE}) where m = 1")
def bars_closed(spark, d):
    return K.closed_for_all(bars_from_events(spark, d).withColumn("is_closed", (F.col("bar_idx") + F.length("symbol")) % 5 != 0)).select("symbol", "bar_idx")


@query("bars_tail", f"select symbol, bar_idx, close from {BE} qualify row_number() over (partition by symbol order by bar_idx desc) <= 20")
def bars_tail(spark, d):
    return K.tail(bars_from_events(spark, d), 20).select("symbol", "bar_idx", "close")


@query("bars_time_slice", f"select symbol, bar_idx, close from {BE} where bar_ts >= timestamp '2024-01-05' and bar_ts < timestamp '2024-01-10'")
def bars_slice(spark, d):
    return bars_from_events(spark, d).where("bar_ts >= timestamp '2024-01-05' and bar_ts < timestamp '2024-01-10'").select("symbol", "bar_idx", "close")


_TICKS = "select user_id, date_trunc('day', ts) as day, event_id as seq, value from events"
for _policy, _value, _seq in (("last", "arg_max(value, event_id)", "max(event_id)"), ("first", "arg_min(value, event_id)", "min(event_id)"), ("last_at_first", "arg_max(value, event_id)", "min(event_id)")):

    @query(f"bars_dedupe_{_policy}", f"select user_id, cast(epoch(date_trunc('day', ts)) as bigint) as day, {_value} as value, {_seq} as seq from events group by user_id, date_trunc('day', ts)")
    def bars_dedupe(spark, d, policy=_policy):
        e = table(spark, d, "events").select("user_id", F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("day"), "value", F.col("event_id").alias("seq"))
        return K.dedupe(e, ["user_id", "day"], "seq", policy)


@query("bars_diff_sync", f"""with s as (select symbol, bar_idx, close from {BE} where bar_idx % 3 <> 0), r as (select symbol, bar_idx, case when bar_idx % 5 = 0 then close + 1 else close end as close from {BE} where bar_idx % 4 <> 0)
select change, count(*) as n, round(sum(close), 4) as closes from (select case when s.close is null then 'inserted' when r.close is null then 'kept' when s.close = r.close then 'unchanged' else 'revised' end as change, coalesce(r.close, s.close) as close
from s full join r using (symbol, bar_idx)) group by 1""")  # fmt: skip
def bars_sync(spark, d):
    b = bars_from_events(spark, d).select("symbol", "bar_idx", "close")
    remote = b.where("bar_idx % 4 <> 0").withColumn("close", F.when(F.col("bar_idx") % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    c = K.changes(b.where("bar_idx % 3 <> 0"), remote, ["symbol", "bar_idx"], ["close"])
    return c.groupBy("change").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("closes"))


@query("upsert_last_wins", "select o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as price, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def upsert_last(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return K.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "seq").drop("seq")


@query("soft_delete_revive", "select count(*) filter (where s_suppkey % 3 = 0 and s_suppkey % 6 <> 0) as deleted, count(*) filter (where not (s_suppkey % 3 = 0 and s_suppkey % 6 <> 0)) as live from supplier")
def soft_delete(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.lit(None).cast("timestamp").alias("deleted_at"))
    gone = K.mark_deleted(s, s.where("s_suppkey % 3 = 0"), "s_suppkey", F.lit("2024-01-01").cast("timestamp"))
    back = K.revive(gone, s.where("s_suppkey % 6 = 0"), "s_suppkey")
    return back.agg(F.count("deleted_at").alias("deleted"), F.sum(F.when(F.col("deleted_at").isNull(), 1).otherwise(0)).alias("live"))


@query("retention_prune", "select event_type, count(*) as n from events where ts >= timestamp '2024-01-30' - interval 10 days group by 1")
def retention(spark, d):
    return K.prune(table(spark, d, "events"), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 10).groupBy("event_type").agg(F.count("*").alias("n"))


@query("repair_status", "select status, count(*) as n from (select case when e = 0 then 'skipped' when f >= e then 'repaired' when f > 0 then 'partial' else 'failed' end as status from (select c_custkey, c_custkey % 20 as e, count(o_orderkey) as f from customer left join orders on o_custkey = c_custkey group by 1, 2)) group by 1")
def repair(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 20).alias("expected"))
    return K.repair_status(c, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k").groupBy("status").agg(F.count("*").alias("n"))


@query("keep_latest", "select o_orderkey from (select *, row_number() over (partition by nullif(o_custkey % 100, 7), o_orderpriority order by o_orderdate desc, o_orderkey desc) as n, nullif(o_custkey % 100, 7) as k from orders) where n = 1 or k is null")
def keep_latest(spark, d):
    o = table(spark, d, "orders").select(F.nullif(F.col("o_custkey") % 100, F.lit(7)).alias("k"), "o_orderpriority", "o_orderdate", "o_orderkey")
    return K.keep_latest(o, ["k", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("latest_version", "select k, arg_max(v, (a, b)) as v from (select p_size as k, (p_partkey % 12) || '.' || (p_partkey % 101) as v, p_partkey % 12 as a, p_partkey % 101 as b from part) group by 1")
def latest_version(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("k"), F.concat_ws(".", F.col("p_partkey") % 12, F.col("p_partkey") % 101).alias("v"))
    return K.latest_version(p, "k", "v")


@query("session_times", "select event_id, cast(epoch(date_trunc('second', ts)) as bigint) as t from events")
def session_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    forms = ["yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    written = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", forms[0])).when(F.col("event_id") % 3 == 1, F.date_format("ts", forms[1])).otherwise(F.date_format("ts", forms[2]))
    return e.select("event_id", F.unix_timestamp(K.session_time(written)).alias("t"))


@query("epoch_units", "select event_id, cast(floor(epoch(ts)) as bigint) as t from events")
def epoch_units(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.floor(us / 1000000)).when(F.col("event_id") % 4 == 1, F.floor(us / 1000)).when(F.col("event_id") % 4 == 2, us).otherwise(us * 1000).cast("long").alias("v"))
    return e.select("event_id", F.unix_seconds(K.epoch_time(F.col("v"))).alias("t"))


@query("number_parse", "select o_orderkey, o_totalprice as v from orders")
def number_parse(spark, d):
    o = table(spark, d, "orders")
    whole = F.format_number("o_totalprice", 2)
    return o.select("o_orderkey", K.number_of(F.when(F.col("o_orderkey") % 2 == 0, whole).otherwise(F.concat(F.lit(" "), whole, F.lit("%")))).alias("v"))


@query("market_codes", "select c, case when substr(c, 3, 1) in ('5', '6', '9') then '1.' else '0.' end || substr(c, 3, 6) as code from (select 'sh' || (100000 + (p_partkey * 7919) % 900000) as c from part)")
def market_codes(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("sh"), 100000 + (F.col("p_partkey") * 7919) % 900000).alias("c"))
    return p.select("c", K.market_code(F.col("c")).alias("code"))


@query("timeframe_seconds", "select p_partkey, tf, p_size * case right(tf, 1) when 'm' then 60 when 'h' then 3600 when 'd' then 86400 when 'w' then 604800 end as n from (select *, p_size || case p_partkey % 5 when 0 then 'm' when 1 then 'h' when 2 then 'd' when 3 then 'w' else 'x' end as tf from part)")
def timeframes(spark, d):
    unit = F.element_at(F.array(*map(F.lit, "mhdwx")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("tf")).select("p_partkey", "tf", K.timeframe_seconds(F.col("tf")).alias("n"))


# ------------------------------------------------------------------ backtests


def signal(spark, d, lag: int = 1) -> DataFrame:
    keep = ("symbol", "bar_idx", "bar_ts", "open", "close")
    return B.schedule(formula.positions(formula.evaluate(bars_from_events(spark, d), SIGNAL, keep=keep)), lag)


def _sim_sql(stress: str = "1e0", extra: str = "", key: str = "symbol") -> str:
    p = Program(Duck())
    f = p.sql(EVENTS_SQL, {"factor": formula.compile_tokens(p, SIGNAL)}, ("symbol", "bar_idx", "bar_ts", "open", "close"))
    w = f"partition by {key} order by bar_idx"
    return f"""select *, 1 - equity / max(equity) over ({w}) as drawdown from (select *, exp(sum(ln(growth)) over ({w})) as equity, growth - 1 as ret from (
select *, greatest((1 + held * gap) * (1 - {stress} * (abs(delta) * 0.00051e0 + case when delta < 0 then -delta * 0.0005e0 else 0 end)) * (1 + target * (close / open - 1)), 1e-6) as growth from (
select *, target - held as delta from (select *, coalesce(lag(target) over ({w}), 0e0) as held, coalesce(open / lag(close) over ({w}) - 1, 0e0) as gap from (
select * {extra} from (select *, coalesce(lag(case when abs(tanh(factor)) < 0.01 then 0e0 else tanh(factor) end) over (partition by symbol order by bar_idx), 0e0) as target from ({f})))))))"""


SIM = f"({_sim_sql()})"
STRESS = f"({_sim_sql('stress', ', unnest([0e0, 1e0, 2e0, 3e0]) as stress', 'symbol, stress')})"
_SAFE = "case when {1} > 1e-12 then {0} / {1} else 0 end"


def _metrics_sql(source: str, keys: str, rounded: bool = True) -> str:
    names = ("total_return", "annualized_return", "annualized_volatility", "max_drawdown", "sharpe", "sortino", "calmar", "turnover", "average_turnover")
    return f"""select {keys}, n, {s6(*names) if rounded else ', '.join(names)} from (select *, {_SAFE.format('annualized_return', 'max_drawdown')} as calmar from (
select {keys}, n, l / f - 1 as total_return, power(l / f, 252e0 / greatest(n - 1, 1)) - 1 as annualized_return, sd * sqrt(252e0) as annualized_volatility, max_drawdown, {_SAFE.format('m', 'sd')} * sqrt(252e0) as sharpe,
{_SAFE.format('m', 'coalesce(down, 0)')} * sqrt(252e0) as sortino, turnover, turnover / n as average_turnover from (
select {keys}, count(*) as n, arg_min(equity, bar_idx) as f, arg_max(equity, bar_idx) as l, max(drawdown) as max_drawdown, avg(ret) as m, stddev_pop(ret) as sd, sqrt(avg(ret * ret) filter (where ret < 0)) as down, sum(abs(delta)) as turnover
from {source} group by {keys})))"""


_METRICS = ("total_return", "annualized_return", "annualized_volatility", "max_drawdown", "sharpe", "sortino", "calmar", "turnover", "average_turnover")


@query("bt_schedule", f"select symbol, bar_idx, {s6('target')} from {SIM}")
def bt_schedule(spark, d):
    return signal(spark, d).select("symbol", "bar_idx", *r6("target"))


@query("bt_equity", f"select symbol, bar_idx, {s6('equity', 'ret', 'drawdown', 'delta')} from {SIM}")
def bt_equity(spark, d):
    return B.simulate(signal(spark, d)).select("symbol", "bar_idx", *r6("equity", "ret", "drawdown", "delta"))


@query("bt_metrics", _metrics_sql(SIM, "symbol"))
def bt_metrics(spark, d):
    return B.metrics(B.simulate(signal(spark, d))).select("symbol", "n", *r6(*_METRICS))


@query("bt_cost_stress", _metrics_sql(STRESS, "symbol, stress"))
def bt_cost_stress(spark, d):
    return B.metrics(B.simulate(B.stressed(signal(spark, d)), stress=True), keys=("symbol", "stress")).select("symbol", "stress", "n", *r6(*_METRICS))


_COSTS = ("commission", "stamp_duty", "transfer_fee", "slippage", "total")


@query("bt_costs", f"""select symbol, {s6(*_COSTS)} from (select symbol, sum(abs(delta) * 1e6 * 0.0003e0) as commission, sum(case when delta < 0 then -delta else 0 end * 1e6 * 0.0005e0) as stamp_duty, sum(abs(delta) * 1e6 * 0.00001e0) as transfer_fee,
sum(abs(delta) * 1e6 * 0.0002e0) as slippage, sum(abs(delta) * 1e6 * 0.00051e0 + case when delta < 0 then -delta else 0 end * 1e6 * 0.0005e0) as total from {SIM} group by 1)""")  # fmt: skip
def bt_costs(spark, d):
    rows = B.simulate(signal(spark, d))
    return rows.withColumns(B.costs(F.col("delta"), F.lit(1e6))).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in _COSTS]).select("symbol", *r6(*_COSTS))


@query("bt_rolling_sharpe", f"""select symbol, bar_idx, {s6('rolling_sharpe')} from (select symbol, bar_idx, case when bar_idx >= 20 and sd > 1e-12 then m / sd * sqrt(252e0) else 0 end as rolling_sharpe from (
select *, avg(ret) over w as m, stddev_pop(ret) over w as sd from {SIM} window w as (partition by symbol order by bar_idx rows between 20 preceding and current row)))""")  # fmt: skip
def bt_rolling(spark, d):
    return B.rolling_sharpe(B.simulate(signal(spark, d)), 21).select("symbol", "bar_idx", *r6("rolling_sharpe"))


_TRADES = f"""select symbol, cast(side as int) as side, entry, exit, bars, exp(g) - 1 as pnl from (select *, coalesce(lead(entry) over (partition by symbol order by run), final) as exit from (
select symbol, run, side, min(bar_idx) as entry, max(bar_idx) as final, count(*) as bars, sum(ln(growth)) as g from (select *, sum(s) over (partition by symbol order by bar_idx) as run from (
select *, sign(target) as side, case when coalesce(lag(sign(target)) over (partition by symbol order by bar_idx), 0) <> sign(target) then 1 else 0 end as s from {SIM})) group by 1, 2, 3)) where side <> 0"""


@query("bt_trades", f"select symbol, side, entry, exit, bars, {s6('pnl')} from ({_TRADES})")
def bt_trades(spark, d):
    return B.trades(B.simulate(signal(spark, d))).select("symbol", "side", "entry", "exit", "bars", *r6("pnl"))


_STATS = ("win_rate", "gain_loss", "profit_factor", "mean_pnl", "best", "worst", "mean_bars", "median_bars")


@query("bt_trade_stats", f"""select symbol, n_trades, {s6(*_STATS)} from (select symbol, count(*) as n_trades, avg(case when pnl > 0 then 1e0 else 0e0 end) as win_rate, coalesce(avg(pnl) filter (where pnl > 0) / avg(-pnl) filter (where pnl < 0), 0) as gain_loss,
coalesce(sum(pnl) filter (where pnl > 0) / sum(-pnl) filter (where pnl < 0), 0) as profit_factor, avg(pnl) as mean_pnl, max(pnl) as best, min(pnl) as worst, avg(bars) as mean_bars, quantile_cont(bars, 0.5) as median_bars from ({_TRADES}) group by 1)""")  # fmt: skip
def bt_trade_stats(spark, d):
    return B.trade_stats(B.trades(B.simulate(signal(spark, d)))).select("symbol", "n_trades", *r6(*_STATS))


@query("bt_monthly", f"select symbol, strftime(bar_ts, '%Y-%m') as period, round(exp(sum(ln(growth))) - 1, 6) + 0e0 as ret from {SIM} group by 1, 2")
def bt_monthly(spark, d):
    return B.compounded(B.simulate(signal(spark, d)), F.date_format("bar_ts", "yyyy-MM")).select("symbol", "period", *r6("ret"))


@query("bt_subperiods", _metrics_sql(f"(select *, ntile(4) over (partition by symbol order by bar_idx) as part from {SIM})", "symbol, part"))
def bt_subperiods(spark, d):
    return B.metrics(B.subperiods(B.simulate(signal(spark, d))), keys=("symbol", "part")).select("symbol", "part", "n", *r6(*_METRICS))


@query("bt_turnover_audit", f"select symbol, {s6('total', 'mean', 'largest', 'share')} from (select symbol, sum(abs(delta)) as total, avg(abs(delta)) as mean, max(abs(delta)) as largest, avg(case when abs(delta) > 0 then 1e0 else 0e0 end) as share from {SIM} group by 1)")
def bt_turnover(spark, d):
    return B.turnover_audit(B.simulate(signal(spark, d))).select("symbol", *r6("total", "mean", "largest", "share"))


for _mode, _n in (("equal_weight", "1"), ("reference", "count(distinct symbol)")):

    @query(f"bt_portfolio_{_mode}", f"select bar_idx, round(avg(ret) / {_n}, 6) + 0e0 as ret from {SIM} group by 1")
    def bt_portfolio(spark, d, mode=_mode):
        return B.portfolio(B.simulate(signal(spark, d)), mode).select("bar_idx", *r6("ret"))


#: Bar by bar, as a recursion over each symbol's bars: the position, and the session in which it was entered.
_T1_SQL = f"""(with recursive t as materialized (select symbol, bar_idx, bar_ts::date as session, open, close, gap, least(greatest(target, 0e0), 1e0) as want from {SIM}),
r as (select symbol, bar_idx, want as target, case when want > 1e-12 then session end as entry from t where bar_idx = 0
union all select symbol, bar_idx, now, case when was <= 1e-12 and now > 1e-12 then session else entry end from (
select t.symbol, t.bar_idx, t.session, r.entry, r.target as was, case when r.target > 0 and r.entry = t.session and t.want < r.target then r.target else t.want end as now from r join t on t.symbol = r.symbol and t.bar_idx = r.bar_idx + 1))
select *, 1 - equity / max(equity) over (partition by symbol order by bar_idx) as drawdown from (select *, exp(sum(ln(growth)) over (partition by symbol order by bar_idx)) as equity, growth - 1 as ret from (
select *, greatest((1 + held * gap) * (1 - (abs(delta) * 0.00051e0 + case when delta < 0 then -delta * 0.0005e0 else 0 end)) * (1 + target * (close / open - 1)), 1e-6) as growth from (
select symbol, bar_idx, open, close, gap, r.target, coalesce(lag(r.target) over (partition by symbol order by bar_idx), 0e0) as held, r.target - coalesce(lag(r.target) over (partition by symbol order by bar_idx), 0e0) as delta from r join t using (symbol, bar_idx)))))"""


def locked(spark, d):
    rows = signal(spark, d).withColumn("session", F.to_date("bar_ts"))
    return B.execute(rows, allow_short=False, t_plus_one=True)


#: Figures that don't grow with the product of all returns; the others are compared by their logarithms.
_STEADY = ("annualized_volatility", "max_drawdown", "sharpe", "sortino", "turnover", "average_turnover")


_GROWN = {"total": "ln(1 + total_return)", "annualized": "ln(1 + annualized_return)", "calmar_size": "sign(calmar) * ln(1 + abs(calmar))"}


@query("bt_t_plus_one", f"select symbol, n, {s6(*_STEADY)}, {', '.join(f'round({e}, 6) + 0e0 as {k}' for k, e in _GROWN.items())} from ({_metrics_sql(_T1_SQL, 'symbol', False)})")
def bt_t_plus_one(spark, d):
    m = B.metrics(B.simulate(locked(spark, d)))
    return m.select("symbol", "n", *r6(*_STEADY), *[(F.round(F.expr(e), 6) + 0.0).alias(k) for k, e in _GROWN.items()])


@query("bt_t_plus_one_positions", f"select symbol, bar_idx, {s6('target')} from {_T1_SQL}")
def bt_t_plus_one_positions(spark, d):
    return locked(spark, d).select("symbol", "bar_idx", *r6("target"))


@query("flagship_signal_sharpe", f"select symbol, count(*) as n_bars, round(case when stddev_pop(ret) > 1e-12 then avg(ret) / stddev_pop(ret) else 0 end * sqrt(252e0), 6) as sharpe, round(sum(ret), 6) as pnl from {SIM} group by 1")
def flagship(spark, d):
    sim = B.simulate(signal(spark, d))
    sd = F.stddev_pop("ret")
    return sim.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.round(F.when(sd > 1e-12, F.avg("ret") / sd).otherwise(0.0) * F.sqrt(F.lit(252.0)), 6).alias("sharpe"), F.round(F.sum("ret"), 6).alias("pnl"))


@query("last_decision", f"select symbol, bar_idx, round(factor, 6) + 0e0 as factor, case when target_now > 0 then 'LONG' when target_now < 0 then 'SHORT' else 'FLAT' end as direction from (select *, case when abs(tanh(factor)) < 0.01 then 0 else tanh(factor) end as target_now from {SIM} qualify row_number() over (partition by symbol order by bar_idx desc) = 1)")
def last_decision(spark, d):
    keep = ("symbol", "bar_idx")
    return formula.decisions(formula.positions(formula.evaluate(bars_from_events(spark, d), SIGNAL, keep=keep))).select("symbol", "bar_idx", *r6("factor"), "direction")


# ------------------------------------------------------------------ factor scores


def scored(spark, d, h: int = 1) -> DataFrame:
    f = formula.evaluate(bars_from_events(spark, d), SIGNAL, keep=("symbol", "bar_idx", "close"))
    return M.forward_label(formula.positions(f), h)


def _scored_sql(h: int = 1) -> str:
    p = Program(Duck())
    f = p.sql(EVENTS_SQL, {"factor": formula.compile_tokens(p, SIGNAL)}, ("symbol", "bar_idx", "close"))
    return f"(select *, ln(lead(close, {h}) over (partition by symbol order by bar_idx) / close) as label, case when abs(tanh(factor)) < 0.01 then 0e0 else tanh(factor) end as position from ({f}))"


SC = _scored_sql()


@query("forward_label", f"select symbol, bar_idx, round(label, 6) + 0e0 as label from {_scored_sql(3)}")
def forward_label(spark, d):
    return scored(spark, d, 3).select("symbol", "bar_idx", *r6("label"))


@query("ic_by_symbol", f"select symbol, count(*) as n, round(coalesce(corr(factor, label), 0), 6) + 0e0 as ic from {SC} where label is not null group by 1")
def ic_by_symbol(spark, d):
    return M.ic(scored(spark, d)).select("symbol", "n", *r6("ic"))


_RANKED = f"(select *, rank() over (partition by symbol order by factor) + (count(*) over (partition by symbol, factor) - 1) / 2e0 as rf, rank() over (partition by symbol order by label) + (count(*) over (partition by symbol, label) - 1) / 2e0 as rl from {SC} where label is not null)"


@query("rank_ic", f"select symbol, count(*) as n, round(coalesce(corr(rf, rl), 0), 6) + 0e0 as rank_ic from {_RANKED} group by 1")
def rank_ic(spark, d):
    return M.rank_ic(scored(spark, d)).select("symbol", "n", *r6("rank_ic"))


#: Bars of training, gap, validation and holdout of each fold.
_TRAIN, _GAP, _VALID, _HOLD = 40, 3, 15, 10
_FOLD_SQL = f"""(select f as fold, part, lo + f * {_VALID} as lo, hi + f * {_VALID} as hi from range(100000) r(f), (values ('train', 0, {_TRAIN}), ('validation', {_TRAIN + _GAP}, {_TRAIN + _GAP + _VALID})) p(part, lo, hi)
where f * {_VALID} + {_TRAIN + _GAP + _VALID} <= (select max(bar_idx) + 1 - {_HOLD} from {SC}))"""


@query("wf_folds", f"select fold, part, symbol, count(*) as n, round(coalesce(corr(factor, label), 0), 6) + 0e0 as ic from {SC} s join {_FOLD_SQL} v on bar_idx >= lo and bar_idx < hi where label is not null group by 1, 2, 3")
def wf_folds(spark, d):
    rows = scored(spark, d)
    n = (rows.agg(F.max("bar_idx")).first()[0] or 0) + 1
    return M.ic(M.in_folds(rows, n, _TRAIN, _GAP, _VALID, _HOLD), ("fold", "part", "symbol")).select("fold", "part", "symbol", "n", *r6("ic"))


@query("reward", f"""select {s6('ret', 'volatility', 'drawdown', 'turnover', 'score')} from (select *, ret - 0.2e0 * volatility - 0.3e0 * drawdown - 0.05e0 * turnover as score from (select avg(ret) as ret, avg(volatility) as volatility, avg(drawdown) as drawdown, avg(turnover) as turnover from (
select symbol, avg(pnl) as ret, stddev_pop(pnl) as volatility, max(1 - curve / greatest(1e0, peak)) as drawdown, avg(abs(position - before)) as turnover from (select *, max(curve) over (partition by symbol order by bar_idx) as peak from (
select *, exp(sum(ln(1 + greatest(coalesce(pnl, 0), -0.99e0))) over (partition by symbol order by bar_idx)) as curve from (select *, position * label as pnl, coalesce(lag(position) over (partition by symbol order by bar_idx), 0) as before from {SC}))) group by 1)))""")  # fmt: skip
def reward(spark, d):
    return M.reward(scored(spark, d)).select(*r6("ret", "volatility", "drawdown", "turnover", "score"))


@query("max_abs_corr", f"select round(greatest(abs(corr(factor, close)), abs(corr(factor, bar_idx))), 6) as max_abs_corr from {SC}")
def max_abs_corr(spark, d):
    return M.max_abs_corr(scored(spark, d), "factor", ["close", "bar_idx"]).select(*r6("max_abs_corr"))


@query("formula_validity", "select l_orderkey, count(*) as n, sum(d) = 1 and min(run) >= 1 as valid from (select *, sum(d) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as run from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 3 = 0 then -1 else 1 end as d from lineitem)) group by 1")
def formula_validity(spark, d):
    li = table(spark, d, "lineitem")
    t = F.when(F.col("l_partkey") % 3 == 0, formula.token("ADD")).otherwise(formula.token("RET"))
    made = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", t.alias("t")))), lambda s: s["t"]).alias("tokens"))
    return M.valid_formulas(made).select("l_orderkey", F.size("tokens").cast("long").alias("n"), "valid")


@query("formula_pool", "select k as token, score, step from (select l_quantity::int as k, max(l_extendedprice) as score, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) as step from lineitem group by 1) order by score desc, step, k limit 10")
def formula_pool(spark, d):
    li = table(spark, d, "lineitem").select(F.array(F.col("l_quantity").cast("int")).alias("tokens"), F.col("l_extendedprice").alias("score"), F.col("l_orderkey").alias("step"))
    return M.pool(li, 10).select(F.col("tokens")[0].alias("token"), "score", "step")


@query("mined_formulas")
def mined(spark, d):
    """Sampled formulas, scored together."""
    s = M.Sampler(7)
    return M.score_formulas(spark, bars_from_events(spark, d), [s.sample() for _ in range(6)])

"""Queries over profiles of several timeframes, made of each customer's orders: every order is the analysis of one timeframe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import decision as D
from tickloom.plans.catalog import query
from tickloom.sources.bars import table

#: A result per order: a third of the customers leans upwards, a third downwards; some name a timeframe that has no role.
_RESULT = {
    "timeframe": "case o_orderkey % 5 when 0 then '1d' when 1 then '1h' when 2 then '30m' when 3 then '15m' else '4h' end",
    "trend": "case when lean = 2 and turn < 4 then 'sideways' when turn = 7 then null when (turn < 6) = (lean = 0) then case when turn < 4 then 'Bullish' else 'up' end else case when turn < 4 then 'BEARISH' else ' short' end end",
    "phase": "case cast(floor(o_totalprice / 10) as bigint) % 5 when 0 then 'PULLBACK' when 1 then 'Consolidation' when 2 then 'BREAKOUT' when 3 then 'unknown' end",
    "trend_score": "cast(cast(floor(o_totalprice * 3) as bigint) % 101 as double)",
    "volatility_score": "cast(cast(floor(o_totalprice / 7) as bigint) % 100 as double)",
    "current_price": "case when turn = 3 then null else o_totalprice / 1000 end",
    "pa_action": "case cast(floor(o_totalprice / 13) as bigint) % 4 when 0 then 'LONG' when 1 then 'short' end",
    "pa_entry": "case when turn % 2 = 0 then o_totalprice / 990 end",
    "pa_stop": "case when turn % 3 = 0 then o_totalprice / 1080 end",
    "pa_target": "case when turn % 5 = 0 then o_totalprice / 800 end",
}
_LEVELS = {"supports": "o_totalprice / 1100, o_totalprice / 1030, o_totalprice / 970, -1e0", "resistances": "o_totalprice / 900, o_totalprice / 1010, 0e0"}
_BASE = "o_custkey as symbol, o_orderkey as seq, {0}, {1}"
_TURNS = "select *, o_custkey % 3 as lean, cast(floor(o_totalprice) as bigint) % 8 as turn from orders"
_RISK = {"position": "case when symbol % 4 < 2 then 'Held' when symbol % 4 = 2 then 'flat' end", "price": "case when symbol % 5 = 0 then 150e0 end", "entry": "case when symbol % 7 = 0 then 210e0 end", "stop": "case when symbol % 11 = 0 then 90e0 end", "target": "case when symbol % 13 = 0 then 300e0 end"}


def _results(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"lean": F.expr("o_custkey % 3"), "turn": F.expr("cast(floor(o_totalprice) as bigint) % 8")})
    return o.select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("at"), *[F.expr(e).alias(n) for n, e in _RESULT.items()], *[F.expr(f"array({e})").alias(n) for n, e in _LEVELS.items()])


def _roles_sql() -> str:
    made = f"select {_BASE.format(', '.join(f'{e} as {n}' for n, e in _RESULT.items()), ', '.join(f'[{e}] as {n}' for n, e in _LEVELS.items()))} from ({_TURNS})"
    row = "{" + ", ".join(f"'{n}': {n}" for n in (*D.RESULT, "seq")) + "}"
    return f"select symbol, {', '.join(f'''arg_max({row}, seq) filter (where timeframe = '{tf}') as {r}''' for r, (tf, _) in D.ROLES.items())} from ({made}) group by 1"


def _sign(x: str) -> str:
    return f"case when upper({x}) like '%BULL%' or trim(upper({x})) in ('UP', 'LONG') then 1 when upper({x}) like '%BEAR%' or trim(upper({x})) in ('DOWN', 'SHORT') then -1 else 0 end"


def _near(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5e0) / 1e4"


#: One row a (symbol, role) first, sums by symbol after; the state is read from the rows' own columns.
_LONG = " union all ".join(f"select symbol, {i} as i, '{r}' as role, '{tf}' as tf, {w}e0 as w, {r} as x from roles" for i, (r, (tf, w)) in enumerate(D.ROLES.items()))


def _one(e: str, role: str) -> str:
    return f"max({e}) filter (where role = '{role}')"


_SUMMARY = f"""with roles as materialized ({_roles_sql()}), rows as (select *, x is not null as has, {_sign('x.trend')} as way, coalesce(upper(trim(x.phase)), '') as phase, least(1e0, greatest(0.2e0, abs(x.trend_score - 50) / 50)) as strength from ({_LONG})),
led as (select *, max(case when i = 0 then way end) over (partition by symbol) as lead_way from rows),
sums as (select symbol, max(lead_way) as lead_way, sum(case when has then w else 0 end order by i) as there, sum(w order by i) as total, sum(case when has and way > 0 then w * strength else 0 end order by i) as up, sum(case when has and way < 0 then w * strength else 0 end order by i) as down,
sum(case when has and lead_way * way < 0 then case when phase in ('PULLBACK', 'CONSOLIDATION') and i > 0 then w * 0.45e0 else w end else 0 end order by i) as against, max(case when i = 0 then has end) as leads,
coalesce(string_agg(tf, '|' order by i) filter (where not has), '') as missing, max(x.seq) as as_of, {', '.join(f"{_one('way', r)} as {r}_way, {_one('phase', r)} as {r}_phase, coalesce({_one('case when phase not in (chr(0), {0}) then phase else upper(trim(x.trend)) end'.format("'', 'UNKNOWN'"), r)}, 'UNKNOWN') as {r}_state" for r in D.ROLES)} from led group by symbol),
a as (select *, there / total as cover, case when there > 0 then least(100, against / there * 100) else 0e0 end as raw from sums),
b as (select *, {_near('raw * cover')} as c0, {_near('greatest(0, 100 - raw) * cover')} as a0 from a),
f as (select *, case when leads then c0 else {_near('c0 * 0.8e0')} end as conflict_score, case when leads then a0 else {_near('a0 * 0.7e0')} end as alignment_score from b),
summary as materialized (select symbol, conflict_score, alignment_score, case when leads then strategic.trend else 'UNKNOWN' end as strategic_trend, case when leads then strategic.trend_score else 0 end as strategic_score, tactical_state as intraday_state, confirmation_state, execution_state,
case when there > 0 then {_near('least(100, up / there * 100)')} else 0 end as bullish_score, case when there > 0 then {_near('least(100, down / there * 100)')} else 0 end as bearish_score,
case when not leads then 'STRATEGIC_DATA_MISSING' when conflict_score >= 60 then case lead_way when 1 then 'BULLISH' when -1 then 'BEARISH' else 'NEUTRAL' end || '_HIGH_CONFLICT' when lead_way = 0 then 'NEUTRAL_MIXED'
when lead_way = 1 then case when tactical_phase = 'PULLBACK' and execution_way = 1 then 'BULLISH_PULLBACK_TURNING_UP' when tactical_way = -1 or confirmation_way = -1 then 'BULLISH_PULLBACK' when confirmation_phase = 'CONSOLIDATION' then 'BULLISH_CONSOLIDATING' when execution_way >= 0 then 'FULL_BULLISH_ALIGNMENT' else 'BULLISH_MIXED' end
else case when tactical_phase = 'PULLBACK' and execution_way = -1 then 'BEARISH_REBOUND_TURNING_DOWN' when tactical_way = 1 or confirmation_way = 1 then 'BEARISH_REBOUND' when confirmation_phase = 'CONSOLIDATION' then 'BEARISH_CONSOLIDATING' when execution_way <= 0 then 'FULL_BEARISH_ALIGNMENT' else 'BEARISH_MIXED' end end as summary_state,
case when conflict_score >= 60 then 'HIGH_CONFLICT' when alignment_score >= 80 then 'FULL_ALIGNMENT' when alignment_score >= 55 then 'PARTIAL_ALIGNMENT' else 'MIXED' end as alignment_state, missing, {_near('cover')} as coverage_ratio,
{_near('least(1, greatest(0, cover * (alignment_score / 100) * (1 - conflict_score / 200)))')} as profile_confidence, as_of from f join roles using (symbol))"""

SUMMARY = ("symbol", "strategic_trend", "strategic_score", "intraday_state", "confirmation_state", "execution_state", "alignment_score", "conflict_score", "bullish_score", "bearish_score", "summary_state", "alignment_state", "coverage_ratio", "profile_confidence", "as_of")


@query("mtf_summary", f"{_SUMMARY} select {', '.join(SUMMARY)}, missing from summary")
def mtf_summary(spark, d):
    return D.summary(D.by_role(_results(spark, d))).select(*SUMMARY, F.array_join("missing_timeframes", "|").alias("missing"))


def _list(words) -> str:
    return f"[{', '.join(repr(w) for w in words)}]"


def _case(of, key: str) -> str:
    return f"case {key} {' '.join(f'when {k!r} then {_list(v)}' for k, v in of.items())} else cast([] as varchar[]) end"


def _kept(*pairs: tuple[str, str]) -> str:
    return f"list_filter([{', '.join(f'case when {c} then {code!r} end' for c, code in pairs)}], lambda s: s is not null)"


def _side(which: str, below: bool) -> str:
    near, far, cmp = ("list_max", "list_min", "<") if below else ("list_min", "list_max", ">")
    real = f"list_filter(src.{which}, lambda v: v > 0)"
    return f"coalesce({near}(list_filter({real}, lambda v: inn is null or v {cmp} inn)), {far}({real}))"


_BUY, _SELL = "action in ('BUY', 'WAIT_BUY', 'HOLD')", "action in ('SELL', 'WAIT_SELL', 'REDUCE')"
_FLAGS = _kept(("missing <> ''", "missing_data"), ("conflict_score >= 60", "high_timeframe_conflict"), ("alignment_score < 55", "low_alignment"), ("execution.volatility_score >= 80", "high_volatility"), ("execution is null", "execution_data_missing"), ("way = 0", "strategic_trend_unknown"), ("ex = 0", "execution_trigger_absent"))
_REASONS = _kept(("way = 0", "strategic_unknown"), ("way <> 0 and torn", "high_conflict"), ("way <> 0 and not torn and coverage_ratio < 0.5", "coverage_low")), "[lower(summary_state)]", _kept(("missing <> ''", "missing_timeframes"), ("conflict_score >= 60", "conflict_high"), ("alignment_score < 55", "alignment_low"), ("execution is null", "execution_data_missing"), ("way > 0", "strategic_bullish"), ("way < 0", "strategic_bearish"), ("way = 0", "strategic_trend_unknown"), ("ex > 0", "execution_bullish"), ("ex < 0", "execution_bearish")), _case(D.ACTION_CODES, "action"), _kept(("conflict_score >= 60 and action = 'WATCH'", "no_buy_due_conflict"))

_DECISION = f"""{_SUMMARY}, r as (select *, {_sign('strategic_trend')} as way, {_sign('execution.trend')} as ex, conflict_score >= 60 or summary_state like '%HIGH_CONFLICT%' as torn, {', '.join(f'{e} as risk_{n}' for n, e in _RISK.items())} from summary join roles using (symbol)),
acted as (select *, case when way = 0 then case when missing = '' then 'AVOID' else 'WATCH' end when torn or coverage_ratio < 0.5 then 'WATCH'
when way = 1 then case when risk_position = 'Held' and alignment_score >= 70 then 'HOLD' when alignment_score >= 80 and conflict_score < 20 and bullish_score >= 60 and ex >= 0 then 'BUY' when coverage_ratio >= 0.75 and (ex = 1 or (upper(tactical.phase) = 'PULLBACK' and upper(confirmation.phase) in ('CONSOLIDATION', 'BREAKOUT'))) then 'WAIT_BUY' else 'WATCH' end
else case when risk_position = 'Held' and alignment_score >= 80 then 'SELL' when risk_position = 'Held' and alignment_score >= 70 then 'REDUCE' when alignment_score >= 80 and conflict_score < 20 and bearish_score >= 60 and ex <= 0 then 'SELL' when ex = -1 and coverage_ratio >= 0.75 then 'WAIT_SELL' else 'WATCH' end end as action,
coalesce(execution, tactical, confirmation, strategic) as src, coalesce(risk_entry, risk_price, execution.current_price, tactical.current_price, strategic.current_price, confirmation.current_price) as seen from r),
owned as (select *, coalesce((action in ('BUY', 'WAIT_BUY') and upper(src.pa_action) = 'LONG') or ({_SELL} and upper(src.pa_action) = 'SHORT'), false) as own from acted),
placed as (select *, coalesce(case when own then src.pa_entry end, seen) as inn from owned),
priced as (select *, coalesce(risk_entry, case when src is not null then inn end) as e, coalesce(risk_stop, case when own then src.pa_stop end, case when {_BUY} then {_side('supports', True)} when {_SELL} then {_side('resistances', False)} end) as s,
coalesce(risk_target, case when own then src.pa_target end, case when {_BUY} then {_side('resistances', False)} when {_SELL} then {_side('supports', True)} end) as t,
(alignment_score * 0.55e0 + greatest(bullish_score, bearish_score) * 0.25e0 + strategic_score * 0.2e0) / 100 * (0.6e0 + 0.4e0 * least(1, greatest(0, coverage_ratio))) * (1 - least(conflict_score, 100) / 200) as belief from placed)
select symbol, action, least({_near('least(1e0, greatest(0e0, belief))')}, case action {' '.join(f'when {k!r} then {v}e0' for k, v in D.CAPS.items())} else 0.9e0 end, case when torn then 0.55e0 else 1e0 end) as confidence,
case when {_BUY} then e end as entry, case when {_BUY} or action = 'REDUCE' then s end as stop, case when {_BUY} or action = 'SELL' then t end as target, case when action in ('BUY', 'WAIT_BUY', 'SELL') and src is not null and abs(e - s) > 0 then {_near('abs(t - e) / abs(e - s)')} end as risk_reward,
array_to_string({_case(D.TRIGGERS, 'action')}, '|') as triggers, array_to_string(list_concat({_case(D.INVALID, 'way')}, case when action = 'HOLD' then ['protective stop is breached'] else [] end), '|') as invalid, array_to_string({_FLAGS}, '|') as flags,
(select string_agg(c, '|' order by p) from (select c, min(p) as p from (select unnest(codes) as c, generate_subscripts(codes, 1) as p) group by c)) as reasons from (select *, {' || '.join(_REASONS)} as codes from priced)"""


@query("mtf_decision", _DECISION)
def mtf_decision(spark, d):
    made = D.decide(D.summary(D.by_role(_results(spark, d))), **{n: F.expr(e) for n, e in _RISK.items()})
    return made.select("symbol", "action", "confidence", "entry", "stop", "target", "risk_reward", *[F.array_join(c, "|").alias(c) for c in ("triggers", "invalid", "flags", "reasons")])


_RANKS = "unnest(range(8)) as i, unnest([" + ", ".join(repr(t) for t in D.TIMEFRAMES) + "]) as tf"
_NEAR = f"""with ranks as (select {_RANKS}), have as (select o_custkey, ranks.i, ranks.tf from (select distinct o_custkey, o_orderkey % 8 as i from orders) join ranks using (i)),
main as (select c_custkey, i, c_custkey % 9 as m from customer left join have on c_custkey = o_custkey and i <> c_custkey % 9 where true),
near as (select c_custkey, i, i > m as up, row_number() over (partition by c_custkey, i > m order by abs(i - m)) as n from main where i is not null and m < 8)
select c_custkey, coalesce(string_agg(tf, '|' order by up desc, n), '') as near from customer left join (select c_custkey, up, n, tf from near join ranks using (i) where n <= 2) using (c_custkey) group by 1"""


@query("neighbour_timeframes", _NEAR)
def neighbour_timeframes(spark, d):
    """Which timeframes lie next to each customer's own among those of its orders; a ninth of the customers has an unknown one."""
    names = F.array(*map(F.lit, D.TIMEFRAMES))
    have = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.element_at(names, (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("have"))
    c = table(spark, d, "customer").join(have, "c_custkey", "left")
    main = F.element_at(F.array(*map(F.lit, (*D.TIMEFRAMES, "2y"))), (F.col("c_custkey") % 9 + 1).cast("int"))
    return c.select("c_custkey", F.array_join(D.neighbours(main, F.col("have")), "|").alias("near"))

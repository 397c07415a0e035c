"""Queries over price action, orders at the risk gate, and missed schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import cron as N
from tickloom.operators import price_action as A
from tickloom.operators import revisions as V
from tickloom.operators import schedule as G
from tickloom.plans.catalog import query
from tickloom.plans.market_queries import BE, r6, s6
from tickloom.sources.shared import spread
from tickloom.sources.bars import SUPPLIES_SQL, bars_from_events, bars_from_supplies, table

_LAST = f"""(select *, row_number() over (partition by symbol order by bar_idx) - 1 as k, count(*) over (partition by symbol) as n, greatest(high - low, abs(high - coalesce(lag(close) over (partition by symbol order by bar_idx), close)), abs(low - coalesce(lag(close) over (partition by symbol order by bar_idx), close))) as tr
from (select * from {BE} qualify row_number() over (partition by symbol order by bar_idx desc) <= {A.LOOKBACK}) qualify count(*) over (partition by symbol) >= {A.LEAST})"""


def _avg(x: str, n: int, a: str, upto: str) -> str:
    return f"list_reduce(list_concat([list_avg({x}[1:{n}])], {x}[{n + 1}:{upto}]), lambda e, v: {a} * v + (1e0 - {a}) * e)"


def _compare(x: str, y: str) -> str:
    return f"case when {x} > {y} then 1 when {x} < -({y}) then -1 else 0 end"


_SWING = "case when len(hp) >= 2 and len(lp) >= 2 then case when hp[-1] > hp[-2] and lp[-1] > lp[-2] then 1 when hp[-1] < hp[-2] and lp[-1] < lp[-2] then -1 else 0 end end"
_LABEL = "case when {0} >= 2 then 'bullish' when {0} <= -2 then 'bearish' else 'neutral' end".format

DIRECTIONS = f"""with b as materialized {_LAST}, l as (select symbol, max(n) as n, list(close order by k) as cl, list(tr order by k) as tl, max(high) as top, min(low) as bottom, arg_max(close, k) as last from b group by 1),
a as materialized (select *, {_avg('tl', A.RANGE, f'(1e0 / {A.RANGE})', 'n')} as atr from l),
p as (select symbol, name, atr, cl, greatest(case when name = 'all' then 0 else n - back end, 0) as lo, case when name = 'behind' then greatest(greatest(0, n - 40) + 5, n - 10) else n end as hi from a, (values ('recent', 10), ('trading', 20), ('behind', 40), ('spike', 8), ('all', 0)) v(name, back)),
r as (select b.symbol, name, atr, k, k - lo as j, hi - lo as m, open, high, low, close, abs(close - open) as body, lag(high) over s as ph, lag(low) over s as pl, lag(high, 2) over s as h2, lag(low, 2) over s as l2, lead(high) over s as nh, lead(low) over s as nl, lead(high, 2) over s as nh2, lead(low, 2) over s as nl2
from b join p on b.symbol = p.symbol and k >= lo and k < hi window s as (partition by b.symbol, name order by k)),
g as (select symbol, name, max(m) as m, avg(close) filter (where j >= m // 2) - avg(close) filter (where j < m // 2) as halves,
list(round(high, 6) order by k) filter (where j >= 2 and j < m - 2 and high > greatest(ph, h2, nh, nh2)) as hp, list(round(low, 6) order by k) filter (where j >= 2 and j < m - 2 and low < least(pl, l2, nl, nl2)) as lp,
count(*) filter (where close > open and (body >= atr * 0.45e0 or body / greatest(high - low, 1e-12) >= 0.45)) as bull, count(*) filter (where close < open and (body >= atr * 0.45e0 or body / greatest(high - low, 1e-12) >= 0.45)) as bear,
round(avg(greatest(0, least(high, ph) - greatest(low, pl)) / (greatest(high, ph) - least(low, pl))) filter (where j > 0 and greatest(high, ph) > least(low, pl)), 3) as lap from r group by 1, 2),
v as (select *, {_compare('slope', 'atr * 0.06e0')} + {_compare('halves', 'atr * 0.12e0')} + coalesce({_SWING}, 0) + case when bull >= bear * 2 and bull >= 3 then 1 when bear >= bull * 2 and bear >= 3 then -1 else 0 end as raw
from (select g.*, atr, {_avg('cl', A.SPAN, '(2e0 / 21)', 'hi')} - {_avg('cl', A.SPAN, '(2e0 / 21)', 'hi - 5')} as slope from g join p on g.symbol = p.symbol and g.name = p.name where g.name in ('recent', 'trading', 'behind'))),
f as (select symbol, max(score) filter (where name = 'recent') as rs, max(score) filter (where name = 'trading') as ts, max(score) filter (where name = 'behind') as bs from (select *, raw + case when lap < 0.55 then sign(raw)::int else 0 end as score from v) group by 1),
d as (select *, {_LABEL('rs')} as rd, {_LABEL('ts')} as td, {_LABEL('bs')} as bd, {_LABEL('(ts + greatest(-1, least(1, rs)))')} as direction from f)
select d.symbol, rs as recent_score, ts as trading_score, bs as background_score, direction, bd as background, case when s.lap > 0.68 then null when s.bull >= 3 and s.bull >= s.bear * 2 then 'bullish' when s.bear >= 3 and s.bear >= s.bull * 2 then 'bearish' end as spike,
(rd = 'bullish' and td = 'bearish') or (rd = 'bearish' and td = 'bullish') or (bd = 'bullish' and direction = 'bearish') or (bd = 'bearish' and direction = 'bullish') as conflict,
coalesce(case {_SWING.replace('hp', 'w.hp').replace('lp', 'w.lp')} when 1 then 'HH+HL' when -1 then 'LL+LH' when 0 then 'mixed' end, 'insufficient') as structure, round(case when top > bottom then (last - bottom) / (top - bottom) else 0.5 end, 6) as position, o.lap as overlap, round(atr, 6) + 0e0 as atr
from d join a on a.symbol = d.symbol join g s on s.symbol = d.symbol and s.name = 'spike' join g w on w.symbol = d.symbol and w.name = 'all' join g o on o.symbol = d.symbol and o.name = 'recent'"""


@query("pa_directions", DIRECTIONS)
def pa_directions(spark, d):
    a = A.directions(bars_from_events(spark, d))
    scores = [F.col(c).cast("long").alias(c) for c in ("recent_score", "trading_score", "background_score")]
    return a.select("symbol", *scores, "direction", "background", "spike", "conflict", "structure", F.round("position", 6).alias("position"), "overlap", *r6("atr"))


#: Bar by bar, as a recursion that carries the level of the last breakout.
_EVENTS = f"""(with recursive b as materialized {_LAST}, a as (select symbol, {_avg('list(tr order by k)', A.RANGE, f'(1e0 / {A.RANGE})', f'{A.LOOKBACK}')} as atr from b group by 1),
x as materialized (select b.symbol, bar_idx, k, s * (case s when 1 then high else low end) as high, s * (case s when 1 then low else high end) as low, s * close as close, s, atr, max(s * (case s when 1 then high else low end)) over (partition by b.symbol, s order by k rows between unbounded preceding and 1 preceding) as top from b join a on a.symbol = b.symbol, (values (1), (-1)) v(s)),
r as (select symbol, s, k, bar_idx, null::double as level, null::varchar as event, null::double as shown from x where k = 0
union all select symbol, s, k, bar_idx, case when event = 'failed' then null when event = 'breakout' then top else level end, event, case when event = 'breakout' then top else level end from (
select x.*, r.level, case when x.close > x.top + greatest(x.atr * 0.01e0, 1e-10) then 'breakout' when r.level is null then null when x.close < r.level - greatest(x.atr * 0.01e0, 1e-10) then 'failed' when x.low <= r.level + x.atr * 0.25e0 and x.close > r.level then 'test' end as event from r join x on x.symbol = r.symbol and x.s = r.s and x.k = r.k + 1))
select symbol, bar_idx, case s when 1 then 'up' else 'down' end as direction, event, s * shown as level from r where event is not null)"""


@query("pa_breakout_events", f"select symbol, bar_idx, direction, event, {s6('level')} from {_EVENTS}")
def pa_breakout_events(spark, d):
    return A.breakout_events(bars_from_events(spark, d)).select("symbol", "bar_idx", "direction", "event", *r6("level"))


_LIMITS = {"max_notional": 300_000.0, "max_exposure": 500_000.0, "max_age": 60.0, "max_loss": 700.0}


@query("risk_gate", """select o_orderkey, code = '' as allowed, code, n from (select o_orderkey, case when o_custkey % 11 = 0 then 'permission_denied' when o_orderstatus <> 'F' and o_orderkey % 4 = 0 then 'strategy_not_production' when o_orderkey % 13 = 0 then 'market_closed' when o_orderkey % 17 = 0 then 'duplicate_order' when o_custkey % 70 > 60 then 'stale_signal'
when upper(o_orderpriority) not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') then 'symbol_not_allowed' when o_totalprice > 300000 or o_totalprice <= 0 then 'max_order_notional' when o_orderkey % 10 > 0 and (o_orderkey % 100) / 1000e0 > 0.05 then 'price_deviation' when o_custkey % 90 * 5000e0 + o_totalprice > 500000 then 'max_gross_exposure' when o_custkey % 50 * 10 - 1000 + o_orderkey % 900 < -700 then 'daily_loss_limit' else '' end as code,
case code when 'permission_denied' then 3 when 'strategy_not_production' then 4 when 'market_closed' then 5 when 'duplicate_order' then 6 when 'stale_signal' then 7 when 'symbol_not_allowed' then 8 when 'max_order_notional' then 9 when 'price_deviation' then 10 when 'max_gross_exposure' then 11 else 12 end as n from orders)""")  # fmt: skip
def risk_gate(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.lower("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("notional"), F.when(key % 10 > 0, 100 + (key % 100) / 10).alias("limit_price"), F.lit(100.0).alias("reference_price"), F.when((F.col("o_orderstatus") == "F") | (key % 4 != 0), "PRODUCTION").otherwise("PAPER").alias("status"),
        (cust % 11 != 0).alias("permitted"), (key % 13 != 0).alias("market_open"), (key % 17 == 0).alias("duplicate"), (cust % 70).alias("age"), (cust % 90 * 5000.0).alias("gross_exposure"), (cust % 50 * 10 - 1000 + key % 900).alias("daily_pnl"),
    )
    g = A.risk_gate(o, enabled=True, symbols=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), **_LIMITS)
    return g.select("o_orderkey", "allowed", "code", F.size("checks").cast("long").alias("n"))


def _fired(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"), F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") % 24 * 3600).alias("start"), ((F.col("c_custkey") % 5 + 1) * 21600).alias("seconds"))
    return G.due(p, F.lit("2024-01-03").cast("timestamp"))


_FIRED = "(select plan, s + k * seconds as t from (select c_custkey as plan, 1704067200 + c_custkey % 24 * 3600 as s, (c_custkey % 5 + 1) * 21600 as seconds, unnest(range(0, 20)) as k from customer) where s + k * seconds <= 1704240000)"


@query("misfires_fire_once", f"select plan, max(t) as t from {_FIRED} group by 1")
def misfires_once(spark, d):
    return G.misfires(_fired(spark, d), "FIRE_ONCE").select("plan", F.unix_timestamp("fire_at").alias("t"))


@query("misfires_catch_up", f"select plan, t from {_FIRED} qualify row_number() over (partition by plan order by t) <= 3")
def misfires_catch_up(spark, d):
    return G.misfires(_fired(spark, d), "CATCH_UP", 3).select("plan", F.unix_timestamp("fire_at").alias("t"))


#: Bar by bar: a recursion whose row is the state of the living leg; ``how`` marks the bar on which it ends.
_LEGS = f"""(with recursive x as materialized (select symbol, s, bar_idx as k, h, l, lag(h) over w as ph, lag(l) over w as pl, lag(h, 2) over w as h2, lag(h, 3) over w as h3, lag(h, 4) over w as h4, count(*) over (partition by symbol, s) as n
from (select symbol, bar_idx, s, case s when 1 then high else -low end as h, case s when 1 then low else -high end as l from ({SUPPLIES_SQL}), (values (1), (-1)) v(s)) window w as (partition by symbol, s order by bar_idx)),
r as (select symbol, s, k, n, null::int as origin, null::double as swing, 0 as cnt, false as armed, null::double as sig, null::int as last, null::varchar as how from x where k = 0
union all select symbol, s, k, n, origin, swing, case when fires then cnt + 1 else cnt end, case when fires then false else armed end, case when fires then pl else sig end, case when fires then k else last end, how from (
select *, how is null and armed and not born and h > ph as fires from (
select x.symbol, x.s, x.k, x.n, x.h, x.ph, x.pl, live or born as up, born, case when live then r.origin when born then x.k - {A.PIVOT} end as origin, case when live then r.swing when born then x.h2 end as swing, case when live then r.cnt else 0 end as cnt,
case when live then r.armed or coalesce(x.l < r.sig, false) else born end as armed, case when live then r.sig end as sig, case when live then r.last end as last, case when live and x.h > r.swing then 'broken' when live and x.k - r.origin > {A.LEG} then 'expired' end as how
from (select *, origin is not null and how is null as live from r) r join (select *, coalesce(h2 > h3 and h2 > h4 and h2 > ph and h2 > h, false) as peak from x) x on x.symbol = r.symbol and x.s = r.s and x.k = r.k + 1, lateral (select not live and peak as born))))
select symbol, s as side, origin, case when how is not null then k end as until, coalesce(how, 'open') as how, cnt, last as last_trigger, n from r where origin is not null and (how is not null or k = n - 1))"""


@query("pa_hl_legs", f"select symbol, side, origin, until, how, cnt as count, last_trigger from {_LEGS}")
def pa_hl_legs(spark, d):
    return A.hl_legs(bars_from_supplies(spark, d))


def _live(side: int, c: str) -> str:
    return f"max({c}) filter (where how = 'open' and side = {side} and n >= {A.HL_LEAST})"


@query("pa_hl_count", f"""select symbol, bull_count, bear_count, case when bull_count > 0 then 'h' || least(bull_count, 3) else 'none' end as bull_candidate, case when bear_count > 0 then 'l' || least(bear_count, 3) else 'none' end as bear_candidate, bull_last_trigger, bull_leg_start, bear_last_trigger, bear_leg_start from (
select symbol, coalesce({_live(1, 'cnt')}, 0) as bull_count, coalesce({_live(-1, 'cnt')}, 0) as bear_count, {_live(1, 'last_trigger')} as bull_last_trigger, {_live(1, 'origin')} as bull_leg_start, {_live(-1, 'last_trigger')} as bear_last_trigger, {_live(-1, 'origin')} as bear_leg_start
from (select distinct l_suppkey as symbol from lineitem) left join {_LEGS} using (symbol) group by 1)""")
def pa_hl_count(spark, d):
    return A.hl_count(bars_from_supplies(spark, d))


#: Fields of a schedule, chosen by a customer's key.
_FIELDS = {
    "mi": ("c_custkey % 5", ("*/15", "5,35", "10-50/20", "*", "59")), "ho": ("c_custkey % 4", ("*", "9-17", "0,12,23", "22-23")), "da": ("c_custkey % 7", ("*", "31", "1-7", "*/10", "29", "*", "15,30")),
    "mo": ("c_custkey % 3", ("*", "2", "1,6-8")), "we": ("c_custkey % 11", ("*", "1-5", "0", "7", "2,4", "*", "6-7", "*", "*", "3", "*")),
}
_LISTS = {"mi": (0, 59), "ho": (0, 23), "da": (1, 31), "mo": (1, 12), "we": (0, 7)}


def _choice(c: str) -> str:
    e, values = _FIELDS[c]
    return f"[{', '.join(repr(v) for v in values)}][{e} + 1] as {c}"


def _values(c: str) -> str:
    lo, hi = _LISTS[c]
    base, step = "split_part(p, '/', 1)", "coalesce(try_cast(nullif(split_part(p, '/', 2), '') as int), 1)"
    first, last = (f"case when {base} = '*' then {x} else cast(split_part({base}, '-', {k}) as int) end" for k, x in ((1, lo), (-1, hi)))
    return f"flatten(list_transform(string_split({c}, ','), lambda p: range({first}, {last} + 1, {step}))) as {c}_list"


#: Every day of the horizon, then every hour and minute of the first two that fit.
_CRON = f"""with c as (select c_custkey, timestamp '2024-02-27 08:00:00' + to_minutes(c_custkey * 37) as cutoff, {', '.join(map(_choice, _FIELDS))} from customer),
l as materialized (select *, {', '.join(map(_values, _FIELDS))} from c),
d as (select c_custkey, cutoff, mi_list, ho_list, day from (select *, cast(cutoff as date) + cast(unnest(range({N.HORIZON})) as int) as day from l)
where list_contains(mo_list, month(day)) and case when da = '*' and we = '*' then true when da = '*' then list_contains(list_transform(we_list, lambda w: w % 7), dayofweek(day)) when we = '*' then list_contains(da_list, day(day))
else list_contains(da_list, day(day)) or list_contains(list_transform(we_list, lambda w: w % 7), dayofweek(day)) end qualify row_number() over (partition by c_custkey order by day) <= 2),
m as (select c_custkey, cutoff, day, ho, unnest(mi_list) as mi from (select *, unnest(ho_list) as ho from d))
select c_custkey, cast(epoch(t) as bigint) as fires from c left join (select c_custkey, min(t) as t from (select c_custkey, cutoff, day::timestamp + to_hours(ho::int) + to_minutes(mi::int) as t from m) where t > cutoff group by 1) using (c_custkey)"""


@query("cron_next_fire", _CRON)
def cron_next_fire(spark, d):
    def chosen(c: str):
        e, values = _FIELDS[c]
        return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({e} + 1 as int)"))

    c = table(spark, d, "customer").select("c_custkey", F.timestamp_seconds(F.lit(1709020800) + F.col("c_custkey") * 37 * 60).alias("cutoff"))
    # a customer has few bytes and much to work out: its own tasks, not the file's
    return N.next_fires(spread(c), *map(chosen, _FIELDS), F.col("cutoff")).select("c_custkey", F.unix_timestamp("next_fire").alias("fires"))


@query("known_at", """select a.o_orderkey, (select arg_max(r.o_orderkey, (r.o_orderdate, r.o_orderkey)) from orders r where r.o_custkey = a.o_custkey and r.o_orderdate + to_days(cast(r.o_orderkey % 400 as int)) <= a.o_orderdate + interval 5 days) as known_value from orders a""")
def known_at(spark, d):
    """Which of a customer's orders was the last one known five days after each order; each is known some days after its date."""
    o = table(spark, d, "orders")
    known = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 400 * 86400)
    asks = o.select("o_orderkey", "o_custkey", F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 5 * 86400).alias("asked"))
    return V.known_at(o, asks, "o_custkey", known, F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_orderkey"), F.col("asked")).select("o_orderkey", "known_value")

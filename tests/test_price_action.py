"""Small tables: running sums over ranges, symbols with few bars, orders with missing values."""

import random

from pyspark.sql import functions as F

from tickloom.functions.ranges import running_total
from tickloom.operators import price_action as A


def test_running_total(spark):
    rows = spark.createDataFrame([(float(i), 1 + i % 3) for i in range(500)], "x double, n long").repartition(4)
    made = {r.x: (r.s, r.s_all) for r in running_total(rows, "x", "n", "s", 7).collect()}
    assert all(made[float(i)][0] == sum(1 + k % 3 for k in range(i + 1)) for i in range(500))
    assert running_total(rows.limit(0), "x", "n", "s").collect() == []
    nulls = spark.createDataFrame([(None, 5), (2.0, 1)], "x double, n long")
    assert sorted((r.x is None, r.s) for r in running_total(nulls, "x", "n", "s").collect()) == [(False, 6), (True, 5)]


def test_few_bars_and_flat_bars(spark):
    flat = spark.range(70).select(F.lit("A").alias("symbol"), F.col("id").cast("int").alias("bar_idx"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    few = flat.where("bar_idx < 59").withColumn("symbol", F.lit("B"))
    (r,) = A.directions(flat.unionByName(few)).collect()
    assert (r.symbol, r.direction, r.structure, r.position, r.overlap, r.spike) == ("A", "neutral", "insufficient", 0.5, None, None)
    assert A.breakout_events(flat).collect() == [] and A.directions(flat.limit(0)).collect() == []


def test_missing_values_at_the_gate(spark):
    schema = "symbol string, notional double, limit_price double, reference_price double, status string, permitted boolean, market_open boolean, age double, duplicate boolean, gross_exposure double, daily_pnl double"
    good = ("a", 10.0, None, None, "PRODUCTION", True, True, 1.0, False, 0.0, None)
    rows = spark.createDataFrame([good, (*good[:5], None, *good[6:]), ("a", 10.0, 100.0, 0.0, *good[4:])], schema)
    assert sorted(r.code for r in A.risk_gate(rows, enabled=True, max_loss=1.0).collect()) == ["", "permission_denied", "price_deviation"]
    assert {r.code for r in A.risk_gate(rows).collect()} == {"execution_disabled"}


def plain_legs(bars):
    """Bar by bar, one state."""
    out, live = [], None
    for i, (h, l) in enumerate(bars):  # noqa: E741
        if live and live["how"]:
            live = None
        o = i - 2
        if live is None:
            if o >= 2 and all(bars[o][0] > bars[k][0] for k in (o - 1, o - 2, o + 1, i)):
                live = {"origin": o, "until": None, "how": None, "count": 0, "last": None, "armed": True, "signal": None}
                out.append(live)
            continue
        if h > bars[live["origin"]][0] or i - live["origin"] > 30:
            live["how"], live["until"] = ("broken" if h > bars[live["origin"]][0] else "expired"), i
            continue
        live["armed"] |= live["signal"] is not None and l < live["signal"]
        if live["armed"] and h > bars[i - 1][0]:
            live |= {"count": live["count"] + 1, "last": i, "armed": False, "signal": bars[i - 1][1]}
    return {(x["origin"], x["until"], x["how"] or "open", x["count"], x["last"]) for x in out}


def test_legs_of_blocks_are_those_of_one_pass(spark):
    """Blocks of 40 bars, so that most legs reach over an edge; every way to end and counts above two occur."""
    rng = random.Random(3)
    series, rows = {}, []
    for s in range(12):
        x, bars = 100.0, []
        for k in range(430):
            x += rng.gauss(-0.1 if (k // 60) % 2 else 0.05, 1) if s % 2 else rng.choice([-1, 0, 1])
            bars.append((round(x + rng.random(), 1), round(x - rng.random(), 1)))
        series[f"s{s}"] = bars
        rows += [(f"s{s}", k, h, l) for k, (h, l) in enumerate(bars)]  # noqa: E741
    rows += [("short", k, float(k), 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx int, high double, low double")
    made = A.hl_legs(df, 40).collect()
    got = {}
    for r in made:
        got.setdefault((r.symbol, r.side), set()).add((r.origin, r.until, r.how, r["count"], r.last_trigger))
    for name, bars in series.items():
        assert got.get((name, 1), set()) == plain_legs(bars)
        assert got.get((name, -1), set()) == plain_legs([(-l, -h) for h, l in bars])  # noqa: E741
    assert {r.how for r in made} == {"broken", "expired", "open"} and max(r["count"] for r in made) > 2
    last = {r.symbol: r for r in A.hl_count(df).collect()}
    assert len(last) == 13 and last["short"].bull_candidate == "none" and last["short"].bull_count == 0
    assert {r.bull_candidate for r in last.values()} | {r.bear_candidate for r in last.values()} >= {"none"}
    assert A.hl_legs(df.limit(0)).count() == 0


def test_legs_meet_bars_once_and_odd_prices(spark):
    """Bars are gathered once a block, not once for each bar before them; missing prices fail comparisons, and not-a-number is above all."""
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    bars = [tuple(rng.choice(odd) if rng.random() < 0.06 else float(rng.randint(-3, 9)) for _ in range(2)) for _ in range(900)]
    df = spark.createDataFrame([("a", k, h, l) for k, (h, l) in enumerate(bars)], "symbol string, bar_idx int, high double, low double")  # noqa: E741
    made = A.hl_legs(df, 40)
    assert "collect_list" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "Window" not in plan
    top = lambda x: (x != x, 0.0 if x != x else x)

    class P(tuple):
        """A price that compares as Spark's do."""

        def __gt__(self, other):
            return None not in (self[0], other[0]) and top(self[0]) > top(other[0])

        def __lt__(self, other):
            return other > self

        def __neg__(self):
            return P((None if self[0] is None else -self[0],))

    own = [(P((h,)), P((l,))) for h, l in bars]  # noqa: E741
    want = {(1, *x) for x in plain_legs(own)} | {(-1, *x) for x in plain_legs([(-l, -h) for h, l in own])}  # noqa: E741
    assert {(r.side, r.origin, r.until, r.how, r["count"], r.last_trigger) for r in made.collect()} == want and len(want) > 40
    mixed = df.unionByName(df.withColumn("symbol", F.lit(None).cast("string")))
    assert A.hl_legs(mixed, 40).where("symbol is null").count() == 0 and A.hl_count(mixed).count() == 2

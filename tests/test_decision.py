"""Profiles of several timeframes: every state and action, and the defined cases."""

from pyspark.sql import functions as F

from tickloom.operators import decision as D
from tickloom.plans import catalog

SCHEMA = "symbol string, timeframe string, at long, trend string, phase string, trend_score double, volatility_score double, current_price double, supports array<double>, resistances array<double>, pa_action string, pa_entry double, pa_stop double, pa_target double"


def result(symbol, timeframe, trend, phase="TREND", score=100.0, at=1, price=100.0, supports=(90.0, 95.0), resistances=(110.0, 120.0), pa=(None, None, None, None)):
    return (symbol, timeframe, at, trend, phase, score, 10.0, price, list(supports) if supports is not None else None, list(resistances) if resistances is not None else None, *pa)


def all_four(symbol, *trends, **more):
    return [result(symbol, tf, trend, **more) for (tf, _), trend in zip(D.ROLES.values(), trends, strict=False)]


def decided(spark, rows, **risk):
    return {r.symbol: r for r in D.decide(D.summary(D.by_role(spark.createDataFrame(rows, SCHEMA))), **risk).collect()}


def test_actions_and_states_all_occur(spark):
    sf = "/root/testdata/sf0.01"
    states = {r.summary_state for r in catalog.load()["mtf_summary"][0](spark, sf).collect()}
    actions = {r.action for r in catalog.load()["mtf_decision"][0](spark, sf).collect()}
    assert actions == set(D.TRIGGERS) and len(states) == 14


def test_alignment_buys_and_the_last_result_counts(spark):
    rows = [*all_four("a", *["BULLISH"] * 4), result("a", "1d", "BEARISH", at=0), *all_four("b", *["BEARISH"] * 4), result("b", "15m", "up", at=2)]
    got = decided(spark, rows)
    a, b = got["a"], got["b"]
    assert (a.action, a.entry, a.stop, a.target, a.risk_reward, a.coverage_ratio, a.alignment_score) == ("BUY", 100.0, 95.0, 110.0, 2.0, 1.0, 100.0)
    assert a.summary_state == "FULL_BULLISH_ALIGNMENT" and a.confidence == 0.9 and a.reasons[0] == "full_bullish_alignment" and a.flags == []
    assert b.conflict_score == 10.0 and b.action == "WATCH" and b.entry is None


def test_small_timeframes_rest_or_stand_against(spark):
    rows = [*all_four("rest", "BULLISH", "BEARISH", "BEARISH", "up", phase="PULLBACK"), *all_four("torn", "BULLISH", "BEARISH", "BEARISH", "SHORT")]
    got = decided(spark, rows)
    assert (got["rest"].conflict_score, got["rest"].summary_state, got["rest"].action) == (22.5, "BULLISH_PULLBACK_TURNING_UP", "WAIT_BUY")
    assert (got["torn"].conflict_score, got["torn"].summary_state, got["torn"].action) == (60.0, "BULLISH_HIGH_CONFLICT", "WATCH")
    assert got["torn"].confidence <= 0.55 and "no_buy_due_conflict" in got["torn"].reasons


def test_missing_empty_and_replaced(spark):
    rows = [result("other", "4h", "BULLISH"), result("nothing", None, None, None, None, price=None, supports=None, resistances=None), *all_four("p", *["UP"] * 4, pa=("long", None, 80.0, None)), *all_four("q", *["UP"] * 4, price=None, supports=(), resistances=(-1.0,))]
    got = decided(spark, rows, stop=F.when(F.col("symbol") == "q", 70.0), position=F.when(F.col("symbol") == "q", "Open "))
    for s in ("other", "nothing"):
        assert (got[s].summary_state, got[s].action, got[s].coverage_ratio, got[s].missing_timeframes) == ("STRATEGIC_DATA_MISSING", "WATCH", 0.0, ["1d", "1h", "30m", "15m"])
    assert (got["p"].action, got["p"].entry, got["p"].stop, got["p"].target) == ("BUY", 100.0, 80.0, 110.0)
    assert (got["q"].action, got["q"].entry, got["q"].stop, got["q"].target, got["q"].risk_reward) == ("HOLD", None, 70.0, None, None)
    assert decided(spark, []) == {}


def test_neighbours(spark):
    got = spark.range(1).select(*[D.neighbours(F.lit(m), F.array(*map(F.lit, have))).alias(k) for k, m, have in (("a", " 1H", ("1m", "5m", "15m", "1d", "4h", "1w")), ("b", "1w", ("1D", "1w")), ("c", "2y", ("1d",)))], D.neighbours(F.lit(None).cast("string"), F.array(F.lit("1d"))).alias("d"), D.neighbours(F.lit("1d"), F.lit(None).cast("array<string>")).alias("e")).first()
    assert tuple(got) == (["4h", "1d", "15m", "5m"], ["1d"], [], [], [])

"""Features and operators against numpy, causality, the compiler's errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import recurrence
from tickloom.functions import vocabulary as W
from tickloom.operators import backtest as B
from tickloom.operators import levels as Q
from tickloom.operators import mining as M
from tickloom.plans import formula


@pytest.fixture(scope="module")
def frame():
    x = np.arange(90)
    close = 100 + 2 * np.sin(x / 7) + 0.03 * x
    open_ = close + 0.2 * np.cos(x / 5)
    return {"open": open_, "high": np.maximum(open_, close) + 0.5, "low": np.minimum(open_, close) - 0.5, "close": close, "volume": 1000 + 50 * np.cos(x / 3)}


@pytest.fixture(scope="module")
def bars(spark, frame):
    rows = [(s, int(i), *(float(frame[c][i]) * k for c in ("open", "high", "low", "close")), float(frame["volume"][i])) for s, k in (("A", 1.0), ("B", 1.5)) for i in range(90)]
    return spark.createDataFrame(rows, "symbol string, bar_idx int, open double, high double, low double, close double, volume double").withColumn("bar_ts", F.timestamp_seconds(F.col("bar_idx") * 60)).cache()


def rolling(x, n):
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1), x]), n)


def series(bars, tokens):
    rows = formula.evaluate(bars.where("symbol = 'A'"), [formula.token(t) for t in tokens]).orderBy("bar_idx").collect()
    return np.array([r.factor for r in rows])


def ret(c):
    return np.concatenate([[0.0], np.diff(np.log(c))])


def ema(x, n):
    out = [x[0]]
    for v in x[1:]:
        out.append(2 / (n + 1) * v + (1 - 2 / (n + 1)) * out[-1])
    return np.array(out)


def test_against_numpy(bars, frame):
    c, r = frame["close"], ret(frame["close"])
    w20 = rolling(c, 20)
    want = {
        ("RET",): r,
        ("MA_DIFF",): (c - w20.mean(1)) / w20.mean(1),
        ("RVOL",): rolling(r, 20).std(1) + 1e-9,
        ("PPO",): (ema(c, 12) - ema(c, 26)) / ema(c, 26),
        ("RET", "TS_SKEW_10"): ((rolling(r, 10) - rolling(r, 10).mean(1, keepdims=True)) ** 3).mean(1) / (rolling(r, 10).std(1) + 1e-9) ** 3,
        ("RET", "TS_QUANTILE_10"): np.quantile(rolling(r, 10), 0.5, axis=1),
        ("RET", "WINSORIZE"): np.clip(r, np.quantile(rolling(r, 20), 0.05, axis=1), np.quantile(rolling(r, 20), 0.95, axis=1)),
        ("RET", "TS_RANK_5"): (rolling(r, 5) <= r[:, None]).mean(1),
        ("RET", "TS_ARG_MAX_5"): rolling(r, 5).argmax(1) / 4,
        ("RET", "PRODUCT_5"): rolling(r, 5).prod(1),
        ("RET", "EMA_20"): ema(r, 20),
        ("RET", "TS_DECAY_EXP_5"): (rolling(r, 5) * 0.5 ** np.arange(5)).sum(1) / ((0.5 ** np.arange(5)).sum() + 1e-9),
    }
    for tokens, values in want.items():
        np.testing.assert_allclose(series(bars, tokens), values, rtol=1e-9, atol=1e-12, err_msg=str(tokens))


def test_vocabulary_is_whole():
    assert (len(W.FEATURES), len(W.OPERATORS)) == (65, 62) and W.version() == W.version()


def test_features_do_not_look_ahead(bars):
    """A change of the future leaves every feature's past as it was."""
    changed = bars.withColumn("close", F.when(F.col("bar_idx") >= 60, F.col("close") * 1.3).otherwise(F.col("close"))).withColumn("high", F.greatest("high", "close"))
    wanted = [n for n in W.FEATURES if n not in ("RET_ENTROPY_20",)]
    a, b = (formula.features(x, wanted).where("bar_idx < 60").orderBy("symbol", "bar_idx").toPandas() for x in (bars, changed))
    np.testing.assert_allclose(a.iloc[:, 2:].to_numpy(float), b.iloc[:, 2:].to_numpy(float), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("tokens", [[], [65], [0, 0], [500], [0, 65]])
def test_what_is_no_formula_is_refused(bars, tokens):
    with pytest.raises(formula.FormulaError):
        formula.evaluate(bars, tokens)


def test_other_vocabulary_is_refused(bars):
    with pytest.raises(formula.FormulaError):
        formula.evaluate(bars, [0], "v0")


def test_average_over_blocks_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "BLOCK", 7)
    x = np.random.default_rng(1).normal(size=40)
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "symbol string, bar_idx int, x double")
    got = [r.e for r in recurrence.ema(df, {"e": ("x", 9)}).orderBy("bar_idx").collect()]
    np.testing.assert_allclose(got, ema(x, 9), rtol=1e-12)


def test_signal_is_executed_on_the_next_bar(bars):
    p = bars.withColumn("position", F.when(F.col("bar_idx") == 10, 1.0).otherwise(0.0))
    rows = B.simulate(B.schedule(p)).where("symbol = 'A'").orderBy("bar_idx").collect()
    assert [r.bar_idx for r in rows if r.target] == [11] and all(r.ret == 0 for r in rows[:11]) and all(r.equity > 0 for r in rows)
    with pytest.raises(ValueError):
        B.schedule(p, 0)


def test_today_s_purchases_stay_under_t_plus_one(spark):
    rows = [("A", i, float(t), i // 3) for i, t in enumerate([1, 0, 0, 0, 1, 0])]
    df = spark.createDataFrame(rows, "symbol string, bar_idx int, target double, session int")
    got = [r.target for r in B.execute(df, t_plus_one=True).orderBy("bar_idx").collect()]
    assert got == [1, 1, 1, 0, 1, 1]


def test_t_plus_one_bar_by_bar(spark):
    """Random targets over many sessions, long and short, against a loop over bars."""
    rng, rows, want = np.random.default_rng(6), [], {}
    for symbol in "ABCDEF":
        held, entry, bar = 0.0, None, 0
        for session in range(60):
            for _ in range(rng.integers(1, 5)):
                target = float(rng.choice([-1.0, 0.0, 0.0, 0.5, 1.0]))
                rows.append((symbol, bar, target, session))
                now = held if held > 0 and entry == session and target < held else target
                entry = session if held <= 1e-12 < now else entry
                want[symbol, bar] = held = now
                bar += 1
    got = B.execute(spark.createDataFrame(rows, "symbol string, bar_idx int, target double, session int"), t_plus_one=True).collect()
    assert {(r.symbol, r.bar_idx): r.target for r in got} == want


def test_folds_keep_the_gap_and_the_holdout():
    for _, a, b, c, d in M.folds(200, 60, 5, 20, 30):
        assert b - a == 60 and c - b == 5 and d - c == 20 and d <= 170


def test_samples_are_formulas(spark):
    s = M.Sampler(3)
    rows = [(i, s.sample()) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, tokens array<int>")
    assert M.valid_formulas(df).where("not valid").count() == 0


def test_profile_keeps_volume(bars):
    p = Q.volume_profile(bars).groupBy("symbol").agg(F.sum("volume").alias("v"))
    want = {r.symbol: r.v for r in bars.groupBy("symbol").agg(F.sum("volume").alias("v")).collect()}
    for r in p.collect():
        assert abs(r.v - want[r.symbol]) < 1e-6


def test_pivots_are_known_later(bars):
    z = Q.zigzag(bars)
    assert z.where("confirm_idx <= idx").count() == 0 and z.count() > 0


def test_position_size(spark):
    row = spark.range(1).select(Q.size_position(F.lit(100000.0), F.lit(10.05), F.lit(9.40), F.lit(0.5), cost=0.03).alias("q")).first()
    assert row.q == 200


def test_prices_of_zero(spark):
    """Logarithms of zero prices are infinite and become 0, as in the reference; an error or a null before."""
    rows = [("A", i, 4.0, 8.0, 0.0 if i == 3 else 2.0, 0.0 if i == 30 else 4.0, 1.0) for i in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, bar_idx int, open double, high double, low double, close double, volume double").withColumn("bar_ts", F.timestamp_seconds(F.col("bar_idx") * 60))
    high, low, close = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
    with np.errstate(all="ignore"):
        above = np.log(high / low)
        garman = np.sqrt(np.maximum(0.5 * above**2 - (2 * np.log(2) - 1) * ret(np.maximum(close, 1e-12)) ** 2, 0))
        rogers = np.sqrt(np.maximum(rolling(np.log(high / close) * np.log(high / 4) + np.log(low / close) * np.log(low / 4), 20).mean(1), 0))
        want = {"GK_VOL": garman, "PARKINSON_VOL": np.sqrt(above**2 / (4 * np.log(2))), "RS_VOL": rogers}
    for name, w in want.items():
        w = np.where(np.isfinite(w), w, 0.0)
        assert w[3] == 0 and (w > 0).any()
        np.testing.assert_allclose(series(bars, [name]), w, atol=1e-12, err_msg=name)
    assert np.isfinite(series(bars, ["YANG_ZHANG_VOL"])).all()


def test_labels_of_zero_prices(spark):
    """A close of 0 ended forward_label and score_formulas with DIVIDE_BY_ZERO; labels are as floating point has them, and scores leave out what isn't finite."""
    close = [[4.0 + (i * 7 % 11) + k for i in range(40)] for k in range(2)]
    close[0][5] = close[0][6] = close[1][9] = 0.0
    rows = [(s, i, x, x + 1, max(x - 1, 0.0), x, 1.0 + i % 3) for s, own in zip("AB", close) for i, x in enumerate(own)]
    bars = spark.createDataFrame(rows, "symbol string, bar_idx int, open double, high double, low double, close double, volume double").withColumn("bar_ts", F.timestamp_seconds(F.col("bar_idx") * 60))
    got = {(r.symbol, r.bar_idx): r.label for r in M.forward_label(bars).collect()}
    with np.errstate(all="ignore"):
        labels = [np.log(np.array(own[1:]) / np.array(own[:-1])) for own in close]
    for s, want in zip("AB", labels):
        assert got[s, 39] is None
        np.testing.assert_allclose([got[s, i] for i in range(39)], want, atol=1e-12)
    assert got["A", 4] == -np.inf and np.isnan(got["A", 5]) and got["A", 6] == np.inf

    ranks = lambda v: (v[:, None] > v).sum(1) + (v[:, None] == v).sum(1) / 2
    score = []
    token = formula.token("RET")
    made = {(r.symbol, r.bar_idx): r.factor for r in formula.evaluate(bars, [token], keep=("symbol", "bar_idx")).collect()}
    for s, want in zip("AB", labels):
        x, fine = np.array([made[s, i] for i in range(39)]), np.isfinite(want)
        score.append(np.corrcoef(ranks(x[fine]), ranks(want[fine]))[0, 1])
    assert M.score_formulas(spark, bars, [[token]]).first().rank_ic == pytest.approx(np.mean(score))
    # as the SQL has it; 0 where all are finite and don't vary
    wide = M.forward_label(bars).withColumn("factor", F.col("open") + 0.0)
    assert all(np.isnan(r.ic) for r in M.ic(wide).collect()) and {r.ic for r in M.ic(wide.where("bar_idx > 9").withColumn("factor", F.lit(1.0))).collect()} == {0.0}

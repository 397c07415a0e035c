"""Backtests of positions over bars: execution lag, costs, equity, trades, figures and robustness.

With positions known, a bar's growth has a closed form, so equity is a running sum of logarithms in
one window per symbol; more cost multipliers or symbols are more keys, not more passes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def S():  # noqa: N802
    """Along a symbol's time."""
    return Window.partitionBy("symbol").orderBy("bar_idx")

def UP():  # noqa: N802
    """All rows up to the current one."""
    return S().rowsBetween(Window.unboundedPreceding, 0)


#: Rates of a turnover's value; stamp duty on sales alone.
RATES = {"commission": 0.0003, "stamp_duty": 0.0005, "transfer_fee": 0.00001, "slippage": 0.0002}
#: Bars a year by timeframe.
PERIODS = {"1d": 252, "1w": 52, "1h": 1008, "4h": 252, "30m": 2016, "15m": 4032, "5m": 12096, "1m": 60480}


def schedule(positions: DataFrame, lag: int = 1) -> DataFrame:
    """A signal is held from ``lag`` bars later on; nothing before."""
    if lag < 1:
        raise ValueError("a signal can't be executed on its own bar")
    return positions.withColumn("target", F.coalesce(F.lag("position", lag).over(S()), F.lit(0.0)))


def costs(delta, equity, stress=1.0) -> dict:
    """Columns of each cost of a change of exposure."""
    size = F.abs(delta) * equity
    sold = F.when(delta < 0, size).otherwise(0.0)
    own = {k: (sold if k == "stamp_duty" else size) * F.lit(r) * stress for k, r in RATES.items()}
    return own | {"total": sum(own.values(), F.lit(0.0))}


def simulate(scheduled: DataFrame, equity: float = 1.0, stress=None) -> DataFrame:
    """Per bar: held, delta, growth, equity, ret, drawdown. ``stress`` is a column of cost multipliers (else 1)."""
    keys = ["symbol", *(["stress"] if stress else [])]
    s = Window.partitionBy(*keys).orderBy("bar_idx")
    up = s.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag("target").over(s), F.lit(0.0))
    gap = F.coalesce(F.col("open") / F.lag("close").over(s) - 1, F.lit(0.0))
    rows = scheduled.withColumns({"held": before, "gap": gap, "delta": F.col("target") - before})
    rate = costs(F.col("delta"), F.lit(1.0), F.col("stress") if stress else F.lit(1.0))["total"]
    growth = F.greatest((1 + F.col("held") * F.col("gap")) * (1 - rate) * (1 + F.col("target") * (F.col("close") / F.col("open") - 1)), F.lit(1e-6))
    rows = rows.withColumn("growth", growth).withColumn("equity", equity * F.exp(F.sum(F.ln("growth")).over(up)))
    return rows.withColumn("ret", F.col("growth") - 1).withColumn("drawdown", 1 - F.col("equity") / F.max("equity").over(up))


def stressed(scheduled: DataFrame, multipliers: Iterable[float] = (0.0, 1.0, 2.0, 3.0)) -> DataFrame:
    """Rows once for each cost multiplier."""
    return scheduled.withColumn("stress", F.explode(F.array(*map(F.lit, multipliers))))


def metrics(sim: DataFrame, periods: int = 252, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Returns, volatility, Sharpe, Sortino, Calmar, turnover; the total counts from the equity after the first bar."""
    a = sim.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("equity", "bar_idx").alias("first"), F.max_by("equity", "bar_idx").alias("last"), F.max("drawdown").alias("max_drawdown"),
        F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sd"), F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")))).alias("down"), F.sum(F.abs("delta")).alias("turnover"),
    )
    year = F.lit(float(periods))
    annual = F.pow(F.col("last") / F.col("first"), year / F.greatest(F.col("n") - 1, F.lit(1))) - 1
    safe = lambda top, low: F.when(low > 1e-12, top / low).otherwise(0.0)
    return a.select(
        *keys, "n", (F.col("last") / F.col("first") - 1).alias("total_return"), annual.alias("annualized_return"), (F.col("sd") * F.sqrt(year)).alias("annualized_volatility"), "max_drawdown",
        (safe(F.col("m"), F.col("sd")) * F.sqrt(year)).alias("sharpe"), (safe(F.col("m"), F.coalesce("down", F.lit(0.0))) * F.sqrt(year)).alias("sortino"), safe(annual, F.col("max_drawdown")).alias("calmar"), "turnover", (F.col("turnover") / F.col("n")).alias("average_turnover"),
    )


def rolling_sharpe(sim: DataFrame, window: int, periods: int = 252) -> DataFrame:
    w = S().rowsBetween(1 - window, 0)
    sd = F.stddev_pop("ret").over(w)
    full = F.row_number().over(S()) >= window
    return sim.withColumn("rolling_sharpe", F.when(full & (sd > 1e-12), F.avg("ret").over(w) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0))


def trades(sim: DataFrame) -> DataFrame:
    """Runs of one direction: entry, exit (the first bar of the next run; the last bar where there is none), bars, product of growths."""
    side = F.signum("target")
    rows = sim.withColumn("side", side).withColumn("start", F.when(F.coalesce(F.lag("side").over(S()), F.lit(0.0)) != F.col("side"), 1).otherwise(0))
    runs = rows.withColumn("run", F.sum("start").over(UP())).groupBy("symbol", "run", "side").agg(F.min("bar_idx").alias("entry"), F.max("bar_idx").alias("final"), F.count("*").alias("bars"), F.sum(F.ln("growth")).alias("log_growth"))
    w = Window.partitionBy("symbol").orderBy("run")
    ended = runs.withColumn("exit", F.coalesce(F.lead("entry").over(w), F.col("final")))
    return ended.where("side != 0").select("symbol", F.col("side").cast("int").alias("side"), "entry", "exit", "bars", (F.exp("log_growth") - 1).alias("pnl"))


def trade_stats(found: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    gain, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    return found.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(F.avg(gain) / F.avg(loss), F.lit(0.0)).alias("gain_loss"),
        F.coalesce(F.sum(gain) / F.sum(loss), F.lit(0.0)).alias("profit_factor"), F.avg("pnl").alias("mean_pnl"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.avg("bars").alias("mean_bars"), F.percentile("bars", F.lit(0.5)).alias("median_bars"),
    )


def compounded(sim: DataFrame, period, name: str = "period") -> DataFrame:
    """Return of each calendar period."""
    return sim.groupBy("symbol", period.alias(name)).agg((F.exp(F.sum(F.ln("growth"))) - 1).alias("ret"))


def subperiods(sim: DataFrame, k: int = 4) -> DataFrame:
    return sim.withColumn("part", F.ntile(k).over(S()))


def turnover_audit(sim: DataFrame) -> DataFrame:
    d = F.abs("delta")
    return sim.groupBy("symbol").agg(F.sum(d).alias("total"), F.avg(d).alias("mean"), F.max(d).alias("largest"), F.avg(F.when(d > 0, 1.0).otherwise(0.0)).alias("share"))


def portfolio(sim: DataFrame, mode: str = "equal_weight") -> DataFrame:
    """Mean return over symbols per bar; ``reference`` also scales each symbol by their number first."""
    n = F.count_distinct("symbol") if mode == "reference" else F.lit(1)
    return sim.groupBy("bar_idx").agg((F.avg("ret") / n).alias("ret"))


#: Fixed value: a position above this is one.
HELD = 1e-12


def execute(scheduled: DataFrame, allow_short: bool = True, cap: float = 1.0, t_plus_one: bool = False, session: str = "session") -> DataFrame:
    """Targets after the ban on shorts, the cap and T+1: in the session in which a position is entered it isn't reduced.

    Under T+1 what a session does depends on the ones before only by whether a position is held at its opening.
    Both cases are worked by windows, and which one holds follows from the sessions' ends: the last one whose end is
    the same in both cases, and how many since then turn it round. ``session`` parts a symbol's bars in runs.
    """
    target = F.least(F.greatest(F.col("target"), F.lit(-cap if allow_short else 0.0)), F.lit(cap))
    rows = scheduled.withColumn("target", target)
    if not t_plus_one:
        return rows
    own = Window.partitionBy("symbol", session).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    up, low = F.col("target") > HELD, F.col("target") <= HELD
    # after a held opening, entries count from the first flat bar on
    rows = rows.withColumn("_flat", F.max(low).over(own) & ~(low & (F.sum(F.when(low, 1).otherwise(0)).over(own) == 1)))
    entered = lambda free: F.max(free & up).over(own)
    most = lambda free: F.max(F.when(free, F.col("target"))).over(own)
    rows = rows.withColumns({"_kept": F.when(entered(F.col("_flat")), most(F.col("_flat"))).otherwise(F.col("target")), "_new": F.when(entered(F.lit(True)), most(F.lit(True))).otherwise(F.col("target"))})
    ends = rows.groupBy("symbol", session).agg(F.min("bar_idx").alias("_from"), (F.max_by("_kept", "bar_idx") > HELD).alias("_kept_end"), (F.max_by("_new", "bar_idx") > HELD).alias("_new_end"))
    along = Window.partitionBy("symbol").orderBy("_from")
    fixed = F.when(F.col("_kept_end") == F.col("_new_end"), F.col("_new_end"))
    ends = ends.withColumns({"_fixed": fixed, "_run": F.count(fixed).over(along)})
    turns = F.sum(F.when(F.col("_new_end") & ~F.col("_kept_end"), 1).otherwise(0)).over(Window.partitionBy("symbol", "_run").orderBy("_from"))
    ends = ends.withColumn("_end", F.coalesce(F.last("_fixed", ignorenulls=True).over(along), F.lit(False)) != (turns % 2 == 1))
    opening = ends.select("symbol", session, F.coalesce(F.lag("_end").over(along), F.lit(False)).alias("_held"))
    found = rows.join(opening, ["symbol", session]).withColumn("target", F.when(F.col("_held"), F.col("_kept")).otherwise(F.col("_new")))
    return found.select(*scheduled.columns)

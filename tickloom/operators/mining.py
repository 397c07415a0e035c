"""Scores of factors: labels, information coefficients, folds, rewards, pools of formulas."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import vocabulary as W
from tickloom.functions.series import Spark


def S():  # noqa: N802
    """Along a symbol's time."""
    return Window.partitionBy("symbol").orderBy("bar_idx")



def forward_label(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Log return from this close to the one ``horizon`` bars on; null at the end, and as floating point has it where a close is 0."""
    made = bars.withColumn("_next", F.lead("close", horizon).over(S()))
    return made.withColumn("label", F.when(F.col("close").isNotNull(), F.expr(Spark().log_ratio("_next", "close")))).drop("_next")


def average_rank(column: str, by: list[str]):
    """Rank from 1 with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2


def _corr(x: str, y: str):
    """Pearson's correlation; null with no spread, where ``corr`` ends with an error."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y))))


def ic(rows: DataFrame, keys: tuple[str, ...] = ("symbol",), factor: str = "factor", label: str = "label") -> DataFrame:
    """Pearson's correlation per key; 0 with less than two rows or no spread, not a number where a value isn't finite."""
    pair = rows.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    c, finite = _corr(factor, label), F.greatest(F.max(F.abs(factor)), F.max(F.abs(label))) < math.inf
    return pair.groupBy(*keys).agg(F.count("*").alias("n"), F.when((F.count("*") < 2) | c.isNull() | (F.isnan(c) & finite), 0.0).otherwise(c).alias("ic"))


def rank_ic(rows: DataFrame, keys: tuple[str, ...] = ("symbol",), factor: str = "factor", label: str = "label") -> DataFrame:
    pair = rows.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    ranked = pair.withColumns({"_f": average_rank(factor, list(keys)), "_l": average_rank(label, list(keys))})
    return ic(ranked, keys, "_f", "_l").withColumnRenamed("ic", "rank_ic")


def folds(n: int, train: int, gap: int, validation: int, holdout: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(fold, train start, train end, validation start, validation end), ends exclusive, sliding by the validation's size."""
    out, start = [], 0
    while start + train + gap + validation <= n - holdout:
        v = start + train + gap
        out.append((len(out), start, start + train, v, v + validation))
        start += validation
    return out


def in_folds(rows: DataFrame, n: int, train: int, gap: int, validation: int, holdout: int = 0) -> DataFrame:
    """Rows with fold and part (train, validation) of the folds of ``n`` bars; one row may be in several folds.
    A bar's folds follow from its number by division, so it is exploded into the few that hold it."""
    last, at = (n - holdout - train - gap - validation) // validation, F.col("bar_idx")
    held = at - (train + gap)
    known = F.sequence(F.greatest(F.floor((at - train) / validation) + 1, F.lit(0)), F.least(F.floor(at / validation), F.lit(last)))
    known = F.when(F.greatest(F.floor((at - train) / validation) + 1, F.lit(0)) <= F.least(F.floor(at / validation), F.lit(last)), known)
    tested = F.when((held >= 0) & (F.floor(held / validation) <= last), F.array(F.floor(held / validation)))
    empty = F.array().cast("array<bigint>")
    part = lambda folds, name: F.transform(F.coalesce(folds.cast("array<bigint>"), empty), lambda f: F.struct(f.alias("fold"), F.lit(name).alias("part")))
    return rows.withColumn("_f", F.explode(F.concat(part(known, "train"), part(tested, "validation")))).select("*", "_f.fold", "_f.part").drop("_f")


def reward(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: means over symbols of return, volatility, drawdown, turnover and the weighted score."""
    w = {"ret": 1.0, "volatility": 0.2, "drawdown": 0.3, "turnover": 0.05} | (weights or {})
    pnl = rows.withColumns({"pnl": F.col("position") * F.col("label"), "_before": F.coalesce(F.lag("position").over(S()), F.lit(0.0))})
    curve = F.sum(F.ln(1 + F.greatest(F.coalesce("pnl", F.lit(0.0)), F.lit(-0.99)))).over(S().rowsBetween(Window.unboundedPreceding, 0))
    falls = pnl.withColumn("_curve", F.exp(curve)).withColumn("_fall", 1 - F.col("_curve") / F.greatest(F.lit(1.0), F.max("_curve").over(S().rowsBetween(Window.unboundedPreceding, 0))))
    own = falls.groupBy("symbol").agg(F.avg("pnl").alias("ret"), F.stddev_pop("pnl").alias("volatility"), F.max("_fall").alias("drawdown"), F.avg(F.abs(F.col("position") - F.col("_before"))).alias("turnover"))
    mean = own.agg(*[F.avg(c).alias(c) for c in ("ret", "volatility", "drawdown", "turnover")])
    return mean.withColumn("score", w["ret"] * F.col("ret") - w["volatility"] * F.col("volatility") - w["drawdown"] * F.col("drawdown") - w["turnover"] * F.col("turnover"))


def max_abs_corr(rows: DataFrame, factor: str, others: list[str]) -> DataFrame:
    return rows.agg(F.coalesce(F.greatest(*[F.abs(_corr(factor, c)) for c in others], F.lit(0.0)), F.lit(0.0)).alias("max_abs_corr"))


def repetition(tokens):
    """Share of a token list's neighbouring pairs that occur more than once in it."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(",", F.get(tokens, i), F.get(tokens, i + 1)))
    return F.when(F.size(tokens) < 2, 0.0).otherwise(1 - F.size(F.array_distinct(pairs)) / F.size(pairs))


def valid_formulas(formulas: DataFrame, tokens: str = "tokens") -> DataFrame:
    """formula_id, valid: every prefix leaves a value, and the whole leaves one."""
    arity = F.array(*[F.lit(1 - (W.OPERATORS[n][0] if n in W.OPERATORS else 0)) for n in W.names()])
    depth = F.aggregate(tokens, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, t: F.struct((a["d"] + F.get(arity, t)).alias("d"), (a["ok"] & (a["d"] + F.get(arity, t) >= 1)).alias("ok")))
    return formulas.withColumn("valid", F.coalesce(depth["ok"] & (depth["d"] == 1), F.lit(False)))


def pool(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` formulas: each token list once with its best score, ties by step, then tokens."""
    best = scored.groupBy("tokens").agg(F.max_by(F.struct("score", "step"), F.struct("score", -F.col("step"))).alias("s")).select("tokens", "s.score", "s.step")
    return best.orderBy(F.desc("score"), "step", "tokens").limit(k)


class Sampler:
    """Random formulas of bounded length, each token drawn by weight from those that can still end in one value."""

    def __init__(self, seed: int = 0, most: int = 8) -> None:
        self.rng, self.most = np.random.default_rng(seed), most
        self.delta = np.array([1 - (W.OPERATORS[n][0] if n in W.OPERATORS else 0) for n in W.names()])
        self.logits = np.zeros((most, len(self.delta)))

    def allowed(self, depth: int, left: int) -> np.ndarray:
        after = depth + self.delta
        return (after >= 1) & (after - 1 <= 2 * (left - 1)) & ~((left == 1) & (after != 1))

    def sample(self) -> list[int]:
        depth, out = 0, []
        for step in range(self.most):
            mask = self.allowed(depth, self.most - step)
            p = np.where(mask, np.exp(self.logits[step] - self.logits[step].max()), 0.0)
            t = int(self.rng.choice(len(p), p=p / p.sum()))
            out.append(t)
            depth += int(self.delta[t])
            if depth == 1 and self.rng.random() < 0.3:
                break
        return out if depth == 1 else self.sample()

    def learn(self, formulas: Sequence[Sequence[int]], rewards: Sequence[float], rate: float = 0.1) -> None:
        """A step of the policy gradient with the mean reward as baseline; updates are clipped."""
        base = float(np.mean(rewards))
        for tokens, r in zip(formulas, rewards, strict=True):
            for step, t in enumerate(tokens):
                p = np.exp(self.logits[step] - self.logits[step].max())
                g = -p / p.sum()
                g[t] += 1.0
                self.logits[step] += np.clip(rate * (r - base) * g, -1, 1)


def score_formulas(spark: SparkSession, bars: DataFrame, formulas: Sequence[Sequence[int]]) -> DataFrame:
    """(formula, rank_ic) of many formulas in one plan that shares their common columns; bars whose label isn't finite don't count."""
    from tickloom.functions.series import Program
    from tickloom.plans.formula import compile_tokens

    p = Program()
    labelled = forward_label(bars).withColumn("label", F.when(F.abs("label") < math.inf, F.col("label")))
    wide = p.run(labelled, {f"x{i}": compile_tokens(p, t) for i, t in enumerate(formulas)}, ("symbol", "bar_idx", "label"))
    long = wide.select("symbol", "bar_idx", "label", F.explode(F.array(*[F.struct(F.lit(i).alias("formula"), F.col(f"x{i}").alias("factor")) for i in range(len(formulas))])).alias("f")).select("symbol", "bar_idx", "label", "f.*")
    return rank_ic(long, ("formula", "symbol")).groupBy("formula").agg(F.avg("rank_ic").alias("rank_ic"))

"""Postfix formulas over bars: tokens to columns, positions and last decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import vocabulary as W
from tickloom.functions.series import Program, X, finite

#: Infix signs for the readable form of a formula.
_LIST = W.names()


class FormulaError(ValueError):
    pass


def token(name: str) -> int:
    return _LIST.index(name)


def feature(p: Program, name: str) -> X:
    """A feature; what isn't finite is 0."""
    return p.let(finite(p.let(W.FEATURES[name][2](p))))


def operate(p: Program, name: str, *args: X) -> X:
    return p.let(finite(p.let(W.OPERATORS[name][1](p, *args))))


def compile_tokens(p: Program, tokens: Sequence[int], vocabulary: str | None = None) -> X:
    """The formula's column; raises where it isn't a formula of this vocabulary."""
    if vocabulary is not None and vocabulary != W.version():
        raise FormulaError(f"formula of vocabulary {vocabulary}; this is {W.version()}")
    if not tokens:
        raise FormulaError("empty formula")
    stack: list[X] = []
    for t in tokens:
        if not 0 <= t < len(_LIST):
            raise FormulaError(f"no token {t}")
        if t < len(W.FEATURES):
            stack.append(feature(p, _LIST[t]))
            continue
        n, _ = W.OPERATORS[_LIST[t]]
        if len(stack) < n:
            raise FormulaError(f"{_LIST[t]} takes {n} arguments, {len(stack)} are there")
        args = stack[-n:]
        stack[-n:] = [operate(p, _LIST[t], *args)]
    if len(stack) != 1:
        raise FormulaError(f"{len(stack)} values are left, not one")
    return stack[0]


def readable(tokens: Sequence[int]) -> str:
    stack: list[str] = []
    for t in tokens:
        name = _LIST[t]
        if t < len(W.FEATURES):
            stack.append(name)
        else:
            n = W.OPERATORS[name][0]
            stack[-n:] = [f"{name}({', '.join(stack[-n:])})"]
    return " ".join(stack)


def lookback(tokens: Sequence[int]) -> int | None:
    """Rows before the current one that can matter; None where all can."""
    stack: list[int] = []
    for t in tokens:
        name = _LIST[t]
        if name in W.UNBOUNDED:
            return None
        if t < len(W.FEATURES):
            # stacked windows: a window over a 20-bar figure reaches back by both
            stack.append(2 * W.FEATURES[name][1] + 25)
        else:
            n = W.OPERATORS[name][0]
            stack[-n:] = [max(stack[-n:]) + 25]
    return stack[-1]


def recent(bars: DataFrame, tokens: Sequence[int], rows: int = 1) -> DataFrame:
    """The last bars that the last ``rows`` values of a formula need."""
    n = lookback(tokens)
    if n is None:
        return bars
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    return bars.join(last, "symbol").where(F.col("bar_idx") > F.col("_last") - n - rows).drop("_last")


def features(bars: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """symbol, bar_idx and ``f_<NAME>`` of the wanted features, with shared columns computed once."""
    p = Program()
    return p.run(bars, {f"f_{n}": feature(p, n) for n in wanted or W.FEATURES})


def evaluate(bars: DataFrame, tokens: Sequence[int], vocabulary: str | None = None, keep: Sequence[str] = ("symbol", "bar_idx")) -> DataFrame:
    p = Program()
    return p.run(bars, {"factor": compile_tokens(p, tokens, vocabulary)}, keep)


def positions(factors: DataFrame, least: float = 0.01) -> DataFrame:
    """``factors`` with position: tanh of the factor, 0 where that is smaller than ``least``."""
    raw = F.tanh("factor")
    return factors.withColumn("position", F.when(F.abs(raw) < least, 0.0).otherwise(raw))


def decisions(with_positions: DataFrame) -> DataFrame:
    """The last bar's position and direction of each symbol."""
    last = with_positions.groupBy("symbol").agg(F.max_by(F.struct("bar_idx", "factor", "position"), "bar_idx").alias("s"))
    direction = F.when(F.col("s.position") > 0, "LONG").when(F.col("s.position") < 0, "SHORT").otherwise("FLAT")
    return last.select("symbol", "s.bar_idx", F.bround("s.factor", 8).alias("factor"), F.bround("s.position", 8).alias("position"), direction.alias("direction"))

"""Registered queries: name -> (function of spark and sf_dir, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import vocabulary as W
from tickloom.functions.series import Duck, Program, shown
from tickloom.plans import formula
from tickloom.sources.bars import EVENTS_SQL, bars_from_events

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        CATALOG[name] = (f, sql)
        return f

    return add


def _formula(tokens: list[int], spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Program()
    return p.run(bars_from_events(spark, sf_dir), shown(formula.compile_tokens(p, tokens)))


def _formula_sql(tokens: list[int]) -> str:
    p = Program(Duck())
    return p.sql(EVENTS_SQL, shown(formula.compile_tokens(p, tokens)))


def _add_formula(name: str, tokens: list[int]) -> None:
    CATALOG[name] = (partial(_formula, tokens), _formula_sql(tokens))


#: Arguments of each operator's own query.
_X, _Y, _GATE = "RET", "VOL_RATIO", "PRESSURE"
for _name in W.FEATURES:
    _add_formula(f"feat_{_name.lower()}", [formula.token(_name)])
for _name, (_n, _) in W.OPERATORS.items():
    _args = {1: [_X], 2: [_X, _Y], 3: [_GATE, _X, _Y]}[_n]
    _add_formula(f"factor_op_{_name.lower()}", [*map(formula.token, _args), formula.token(_name)])
_add_formula("formula_nested", [formula.token(n) for n in ("RET", "TS_MEAN_5", "VOL_Z", "TS_CORR_10", "CS_RANK", "HL_RANGE", "MUL", "TANH_SQUASH")])


def load() -> dict[str, tuple[Query, str | None]]:
    """All queries; the modules that register them are read on first use."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"tickloom.plans.{name}")
    return CATALOG


MODULES = ("market_queries", "level_queries", "news_queries", "flow_queries", "action_queries", "decision_queries")

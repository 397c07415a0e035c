"""Several timeframes to one profile, and the profile to an action with prices and codes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Timeframes from small to large, roles with their timeframes and weights, thresholds, caps, words and codes.
TIMEFRAMES = ("1m", "5m", "15m", "30m", "1h", "4h", "1d", "1w")
ROLES = {"strategic": ("1d", 0.4), "tactical": ("1h", 0.3), "confirmation": ("30m", 0.2), "execution": ("15m", 0.1)}
HIGH_CONFLICT = 60.0
RESTING = ("PULLBACK", "CONSOLIDATION")
RESTING_SHARE = 0.45
CAPS = {"AVOID": 0.55, "WATCH": 0.6, "WAIT_BUY": 0.78, "WAIT_SELL": 0.78, "HOLD": 0.8, "REDUCE": 0.78}
OTHER_CAP = 0.9
TRIGGERS = {
    "BUY": ("execution close confirms breakout", "volume expands during breakout", "strategic trend remains bullish"),
    "WAIT_BUY": ("execution timeframe turns bullish", "confirmation timeframe closes above resistance", "strategic trend remains bullish"),
    "SELL": ("execution close confirms breakdown", "volume expands during breakdown", "strategic trend remains bearish"),
    "WAIT_SELL": ("execution timeframe turns bearish", "confirmation timeframe closes below support", "strategic trend remains bearish"),
    "REDUCE": ("price loses the nearest support",),
    "HOLD": ("strategic trend remains intact",),
    "WATCH": ("wait for clearer multi-timeframe alignment",),
    "AVOID": ("wait for clearer multi-timeframe alignment",),
}
ACTION_CODES = {
    "BUY": ("alignment_high", "buy_trigger_confirmed"),
    "WAIT_BUY": ("wait_for_buy_confirmation",),
    "SELL": ("alignment_high", "sell_trigger_confirmed"),
    "WAIT_SELL": ("wait_for_sell_confirmation",),
    "REDUCE": ("reduce_risk",),
    "HOLD": ("hold_existing_position",),
    "WATCH": ("wait_for_clear_setup",),
    "AVOID": ("wait_for_clear_setup",),
}
INVALID = {
    1: ("strategic trend turns bearish", "price closes below the nearest support"),
    -1: ("strategic trend turns bullish", "price closes above the nearest resistance"),
}

#: What a timeframe's analysis gives beside symbol, timeframe and its time.
RESULT = ("trend", "phase", "trend_score", "volatility_score", "current_price", "supports", "resistances", "pa_action", "pa_entry", "pa_stop", "pa_target")


def _near4(x: Column) -> Column:
    return F.floor(x * 10_000.0 + 0.5) / 10_000.0


def _within(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def _text(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def sign(trend: Column) -> Column:
    """1 for an upward word, -1 for a downward one, 0 for others and null."""
    t = _text(trend)
    return F.when(t.contains("BULL") | t.isin("UP", "LONG"), 1).when(t.contains("BEAR") | t.isin("DOWN", "SHORT"), -1).otherwise(0)


def neighbours(main: Column, available: Column, up: int = 2, down: int = 2) -> Column:
    """Of the ``available`` timeframes the next ``up`` larger ones, then the next ``down`` smaller ones, nearest first; nothing for
    an unknown timeframe."""
    order = F.array(*map(F.lit, TIMEFRAMES))
    clean = lambda x: F.lower(F.trim(x))
    at = F.array_position(order, F.coalesce(clean(main), F.lit("")))
    have = F.transform(F.coalesce(available, F.array().cast("array<string>")), clean)
    larger = F.filter(order, lambda x, i: (i + 1 > at) & F.coalesce(F.array_contains(have, x), F.lit(False)))
    smaller = F.reverse(F.filter(order, lambda x, i: (i + 1 < at) & F.coalesce(F.array_contains(have, x), F.lit(False))))
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice(larger, 1, up), F.slice(smaller, 1, down)))


def by_role(results: DataFrame, roles: Mapping[str, tuple[str, float]] = ROLES, at: Column | None = None) -> DataFrame:
    """(symbol, a struct of ``RESULT`` and ``at`` per role): each role's timeframe's last result by ``at``, null where there is none.
    One shuffle, with the last results picked before it."""
    at = F.col("at") if at is None else at
    row = F.struct(*RESULT, at.alias("at"))
    last = [F.max_by(F.when(F.lower(F.trim("timeframe")) == tf, row), F.when(F.lower(F.trim("timeframe")) == tf, at)).alias(role) for role, (tf, _) in roles.items()]
    return results.groupBy("symbol").agg(*last)


def summary(profiles: DataFrame, roles: Mapping[str, tuple[str, float]] = ROLES) -> DataFrame:
    """Rows of ``by_role`` with one profile of all timeframes: scores, conflict, alignment, states and what is missing. Small
    timeframes never replace the strategic one: against it they count as conflict, less so while they rest."""
    has = {r: F.col(r).isNotNull() for r in roles}
    way = {r: sign(F.col(f"{r}.trend")) for r in roles}
    phase = {r: _text(F.col(f"{r}.phase")) for r in roles}
    total = reduce(add, (w for _, w in roles.values()), 0.0)  # added up like the columns, so that all roles are exactly 1

    def summed(each) -> Column:
        return reduce(add, (each(r, w) for r, (_, w) in roles.items()), F.lit(0.0))

    def strength(r: str) -> Column:
        return _within(F.abs(F.coalesce(F.col(f"{r}.trend_score"), F.lit(0.0)) - 50.0) / 50.0, 0.2, 1.0)

    def against(r: str, w: float) -> Column:
        share = F.lit(w) if r == "strategic" else F.when(phase[r].isin(*RESTING), w * RESTING_SHARE).otherwise(w)
        return F.when(has[r] & (F.col("_way") != 0) & (way[r] != 0) & (way[r] != F.col("_way")), share).otherwise(0.0)

    def score(x: str) -> Column:
        return F.when(F.col("_there") > 0, _within(F.col(x) / F.col("_there") * 100.0, 0.0, 100.0)).otherwise(0.0)

    def state(r: str) -> Column:
        told = F.when((phase[r] != "") & (phase[r] != "UNKNOWN"), phase[r]).otherwise(_text(F.coalesce(f"{r}.trend", F.lit("UNKNOWN"))))
        return F.when(has[r], told).otherwise("UNKNOWN")

    p = profiles.withColumns({"_way": way["strategic"], "_there": summed(lambda r, w: F.when(has[r], w).otherwise(0.0))})
    p = p.withColumns({
        "_up": summed(lambda r, w: F.when(has[r] & (way[r] > 0), F.lit(w) * strength(r)).otherwise(0.0)),
        "_down": summed(lambda r, w: F.when(has[r] & (way[r] < 0), F.lit(w) * strength(r)).otherwise(0.0)),
        "_against": summed(against),
        "_cover": F.col("_there") / total if total > 0 else F.lit(0.0),
    })
    lead = has["strategic"]
    p = p.withColumn("_raw", score("_against"))
    p = p.withColumns({"conflict_score": _near4(F.col("_raw") * F.col("_cover")), "alignment_score": _near4(F.greatest(F.lit(0.0), 100.0 - F.col("_raw")) * F.col("_cover"))})
    p = p.withColumns({"conflict_score": F.when(lead, F.col("conflict_score")).otherwise(_near4(F.col("conflict_score") * 0.8)), "alignment_score": F.when(lead, F.col("alignment_score")).otherwise(_near4(F.col("alignment_score") * 0.7))})

    def sided(side: int) -> Column:
        """States of an upward (1) or downward (-1) strategic trend; the others' ways are seen from its side."""
        own, rest = ("BULLISH", "PULLBACK") if side > 0 else ("BEARISH", "REBOUND")
        turned = "UP" if side > 0 else "DOWN"
        ways = [way[r] * side for r in ("tactical", "confirmation", "execution")]
        s = F.when((phase["tactical"] == "PULLBACK") & (ways[2] > 0), f"{own}_{rest}_TURNING_{turned}")
        s = s.when((ways[0] < 0) | (ways[1] < 0), f"{own}_{rest}").when(phase["confirmation"] == "CONSOLIDATION", f"{own}_CONSOLIDATING")
        return s.when(F.least(*ways) >= 0, f"FULL_{own}_ALIGNMENT").otherwise(f"{own}_MIXED")

    torn = F.col("conflict_score") >= HIGH_CONFLICT
    told = F.when(~lead, "STRATEGIC_DATA_MISSING").when(torn & (F.col("_way") > 0), "BULLISH_HIGH_CONFLICT").when(torn & (F.col("_way") < 0), "BEARISH_HIGH_CONFLICT").when(torn, "NEUTRAL_HIGH_CONFLICT")
    told = told.when(F.col("_way") == 0, "NEUTRAL_MIXED").when(F.col("_way") > 0, sided(1)).otherwise(sided(-1))
    level = F.when(torn, "HIGH_CONFLICT").when(F.col("alignment_score") >= 80, "FULL_ALIGNMENT").when(F.col("alignment_score") >= 55, "PARTIAL_ALIGNMENT").otherwise("MIXED")
    made = {
        "strategic_trend": F.when(lead, F.col("strategic.trend")).otherwise("UNKNOWN"),
        "strategic_score": F.when(lead, F.coalesce("strategic.trend_score", F.lit(0.0))).otherwise(0.0),
        "intraday_state": state("tactical"), "confirmation_state": state("confirmation"), "execution_state": state("execution"),
        "bullish_score": _near4(score("_up")), "bearish_score": _near4(score("_down")),
        "summary_state": told, "alignment_state": level,
        "missing_timeframes": F.filter(F.array(*[F.when(~has[r], F.lit(tf)) for r, (tf, _) in roles.items()]), lambda x: x.isNotNull()),
        "coverage_ratio": _near4(F.col("_cover")),
        "profile_confidence": _near4(_within(F.col("_cover") * (F.col("alignment_score") / 100.0) * (1.0 - F.col("conflict_score") / 200.0), 0.0, 1.0)),
        "as_of": F.greatest(*[F.col(f"{r}.at") for r in roles]),
    }
    return p.withColumns(made).drop("_way", "_there", "_up", "_down", "_against", "_cover", "_raw")


def _words(of: Mapping, key: Column) -> Column:
    empty = F.array().cast("array<string>")
    return reduce(lambda so_far, k: F.when(key == k, F.array(*map(F.lit, of[k]))).otherwise(so_far), of, empty)


def _told(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def decide(profiles: DataFrame, position: Column | None = None, price: Column | None = None, entry: Column | None = None, stop: Column | None = None, target: Column | None = None) -> DataFrame:
    """Rows of ``summary`` with an action, its confidence, prices, triggers, invalidations, flags and reasons.

    ``position`` tells whether the symbol is held (held, holding, long, open), ``price`` the current price, the others replace a
    price found. Prices come from the smallest timeframe with a result: its own proposal where it points the same way, else the
    nearest level on the right side of the entry, else the outermost level."""
    none = F.lit(None).cast("double")
    price, fixed = price if price is not None else none, {"entry": entry, "stop": stop, "target": target}
    fixed = {k: v if v is not None else none for k, v in fixed.items()}
    held = F.lower(F.trim(F.coalesce(position if position is not None else F.lit("flat"), F.lit("flat")))).isin("held", "holding", "long", "open")
    c, aligned, conflict, cover = F.col, F.col("alignment_score"), F.col("conflict_score"), F.col("coverage_ratio")
    p = profiles.withColumns({"_way": sign(c("strategic_trend")), "_last": sign(c("execution.trend")), "_torn": (conflict >= HIGH_CONFLICT) | c("summary_state").contains("HIGH_CONFLICT"), "_held": held})

    sure = (aligned >= 80) & (conflict < 20)
    turning = (_text(c("tactical.phase")) == "PULLBACK") & _text(c("confirmation.phase")).isin("CONSOLIDATION", "BREAKOUT")
    up = F.when(c("_held") & (aligned >= 70), "HOLD").when(sure & (c("bullish_score") >= 60) & (c("_last") >= 0), "BUY").when(((c("_last") > 0) | turning) & (cover >= 0.75), "WAIT_BUY").otherwise("WATCH")
    down = F.when(c("_held") & (aligned >= 80), "SELL").when(c("_held") & (aligned >= 70), "REDUCE").when(sure & (c("bearish_score") >= 60) & (c("_last") <= 0), "SELL").when((c("_last") < 0) & (cover >= 0.75), "WAIT_SELL").otherwise("WATCH")
    action = F.when((c("_way") == 0) & (F.size("missing_timeframes") == 0), "AVOID").when((c("_way") == 0) | c("_torn") | (cover < 0.5), "WATCH").when(c("_way") > 0, up).otherwise(down)

    seen = F.coalesce(price, *[c(f"{r}.current_price") for r in ("execution", "tactical", "strategic", "confirmation")])
    p = p.withColumns({"action": action, "_from": F.coalesce("execution", "tactical", "confirmation", "strategic"), "_seen": F.coalesce(fixed["entry"], seen)})
    buys, sells = c("action").isin("BUY", "WAIT_BUY", "HOLD"), c("action").isin("SELL", "WAIT_SELL", "REDUCE")
    word = F.upper(c("_from.pa_action"))
    own = F.coalesce((c("action").isin("BUY", "WAIT_BUY") & (word == "LONG")) | (sells & (word == "SHORT")), F.lit(False))
    p = p.withColumns({"_own": own, "_in": F.coalesce(F.when(own, c("_from.pa_entry")), c("_seen"))})

    def level(which: str, below: bool) -> Column:
        real = F.filter(f"_from.{which}", lambda x: x > 0)
        side = F.filter(real, lambda x: c("_in").isNull() | ((x < c("_in")) if below else (x > c("_in"))))
        return F.coalesce(F.array_max(side), F.array_min(real)) if below else F.coalesce(F.array_min(side), F.array_max(real))

    low, high = level("supports", True), level("resistances", False)
    found = {"entry": F.when(c("_from").isNotNull(), c("_in")), "stop": F.coalesce(F.when(c("_own"), c("_from.pa_stop")), F.when(buys, low).when(sells, high)), "target": F.coalesce(F.when(c("_own"), c("_from.pa_target")), F.when(buys, high).when(sells, low))}
    p = p.withColumns({f"_{k}": F.coalesce(fixed[k], v) for k, v in found.items()})
    risk = F.abs(c("_entry") - c("_stop"))
    ratio = F.when(c("_from").isNotNull() & (risk > 0), _near4(F.abs(c("_target") - c("_entry")) / risk))

    belief = (aligned * 0.55 + F.greatest("bullish_score", "bearish_score") * 0.25 + c("strategic_score") * 0.2) / 100.0
    belief = belief * (0.6 + 0.4 * _within(cover, 0.0, 1.0)) * (1.0 - F.least(conflict, F.lit(100.0)) / 200.0)
    cap = reduce(lambda so_far, a: F.when(c("action") == a, CAPS[a]).otherwise(so_far), CAPS, F.lit(OTHER_CAP))
    belief = F.least(_near4(_within(belief, 0.0, 1.0)), cap, F.when(c("_torn"), 0.55).otherwise(1.0))

    torn, blind, gone = conflict >= HIGH_CONFLICT, c("execution").isNull(), F.size("missing_timeframes") > 0
    flags = _told((gone, "missing_data"), (torn, "high_timeframe_conflict"), (aligned < 55, "low_alignment"), (F.coalesce(c("execution.volatility_score") >= 80, F.lit(False)), "high_volatility"), (blind, "execution_data_missing"), (c("_way") == 0, "strategic_trend_unknown"), (c("_last") == 0, "execution_trigger_absent"))
    first = F.when(c("_way") == 0, F.array(F.lit("strategic_unknown"))).when(c("_torn"), F.array(F.lit("high_conflict"))).when(cover < 0.5, F.array(F.lit("coverage_low"))).otherwise(F.array().cast("array<string>"))
    reasons = _told(
        (gone, "missing_timeframes"), (torn, "conflict_high"), (aligned < 55, "alignment_low"), (blind, "execution_data_missing"),
        (c("_way") > 0, "strategic_bullish"), (c("_way") < 0, "strategic_bearish"), (c("_way") == 0, "strategic_trend_unknown"),
        (c("_last") > 0, "execution_bullish"), (c("_last") < 0, "execution_bearish"),
    )
    last = F.when(torn & (c("action") == "WATCH"), F.array(F.lit("no_buy_due_conflict"))).otherwise(F.array().cast("array<string>"))
    breach = F.when(c("action") == "HOLD", F.array(F.lit("protective stop is breached"))).otherwise(F.array().cast("array<string>"))
    made = {
        "confidence": belief,
        "entry": F.when(buys, c("_entry")), "stop": F.when(buys | (c("action") == "REDUCE"), c("_stop")),
        "target": F.when(buys | (c("action") == "SELL"), c("_target")), "risk_reward": F.when(c("action").isin("BUY", "WAIT_BUY", "SELL"), ratio),
        "triggers": _words(TRIGGERS, c("action")), "invalid": F.concat(_words(INVALID, c("_way")), breach), "flags": flags,
        "reasons": F.array_distinct(F.concat(first, F.array(F.lower("summary_state")), reasons, _words(ACTION_CODES, c("action")), last)),
    }
    return p.withColumns(made).drop("_way", "_last", "_torn", "_held", "_from", "_seen", "_own", "_in", "_entry", "_stop", "_target")

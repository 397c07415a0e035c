"""Price action over the last bars of each symbol: direction votes, spikes, swing labels, breakout events; the risk gate of orders.

``recent`` bounds what one symbol brings: its last ``lookback`` bars as one array, chosen by a ranked window before anything is
collected. Votes are expressions over that array.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.shared import with_checkpoints

LOOKBACK, LEAST = 120, 60
#: Bars of the seeded averages of closes and of true ranges.
SPAN, RANGE = 20, 14


def tail(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_idx"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= lookback).drop("_n")


def _seeded(x: Column, n: int, a: float) -> Column:
    """The recursive averages of an array from its place n on: first the mean of n values."""
    mean = F.aggregate(F.slice(x, 1, n), F.lit(0.0), lambda s, v: s + v) / n
    rest = F.slice(x, F.lit(n + 1), F.greatest(F.size(x) - n, F.lit(0)))
    return F.aggregate(rest, F.array(mean), lambda s, v: F.concat(s, F.array(a * v + (1 - a) * F.element_at(s, -1))))


def recent(bars: DataFrame, lookback: int = LOOKBACK, least: int = LEAST) -> DataFrame:
    """One row a symbol with ``least`` bars or more: s (its last bars in order), ema (averages from bar ``SPAN`` on), atr."""
    one = tail(bars, lookback).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bar_idx", "open", "high", "low", "close"))).alias("s")).where(F.size("s") >= least)

    def true_range(i: Column) -> Column:
        b, before = F.get("s", i), F.get("s", F.greatest(i - 1, F.lit(0)))["close"]
        flat = b["high"] - b["low"]
        return F.when(i == 0, flat).otherwise(F.greatest(flat, F.abs(b["high"] - before), F.abs(b["low"] - before)))

    one = one.withColumn("tr", F.transform(F.sequence(F.lit(0), F.size("s") - 1), true_range))
    one = one.withColumns({"ema": _seeded(F.transform("s", lambda b: b["close"]), SPAN, 2 / (SPAN + 1)), "atr": F.element_at(_seeded(F.col("tr"), RANGE, 1 / RANGE), -1)})
    last = F.element_at("s", -1)
    return one.withColumn("atr", F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.greatest(last["high"] - last["low"], F.lit(1e-10)))).drop("tr")


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def overlap(s: Column) -> Column:
    """Mean share of two neighbouring bars' span that both cover, to three digits; null where no pair has a span."""

    def of(i: Column) -> Column:
        a, b = F.get(s, i - 1), F.get(s, i)
        span = F.greatest(a["high"], b["high"]) - F.least(a["low"], b["low"])
        return F.when(span > 0, F.greatest(F.lit(0.0), F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"])) / span)

    each = F.array_compact(F.transform(F.sequence(F.lit(1), F.size(s) - 1), of))
    return F.when(F.size(each) > 0, F.round(_mean(each), 3))


def turning(s: Column, side: str) -> Column:
    """Prices of an array's bars whose high (or low) lies beyond those of two bars on either side, in order."""

    def beyond(i: Column) -> Column:
        own, others = F.get(s, i)[side], [F.get(s, i + k)[side] for k in (-2, -1, 1, 2)]
        return own > F.greatest(*others) if side == "high" else own < F.least(*others)

    at = F.filter(F.sequence(F.lit(2), F.size(s) - 3), beyond)
    return F.transform(at, lambda i: F.round(F.get(s, i)[side], 6))


def swing(s: Column) -> Column:
    """1 where the last two highs and lows both rise, -1 where both fall, 0 otherwise, null with less than two of either."""
    high, low = turning(s, "high"), turning(s, "low")
    step = lambda x: F.element_at(x, -1) - F.element_at(x, -2)
    return F.when((F.size(high) >= 2) & (F.size(low) >= 2), F.when((step(high) > 0) & (step(low) > 0), 1).when((step(high) < 0) & (step(low) < 0), -1).otherwise(0))


def trend_bars(s: Column, atr: Column) -> tuple[Column, Column]:
    """How many bars have a body that counts, upwards and downwards."""

    def big(b: Column) -> Column:
        body = F.abs(b["close"] - b["open"])
        return (body >= F.greatest(atr * 0.45, F.lit(1e-12))) | (body / F.greatest(b["high"] - b["low"], F.lit(1e-12)) >= 0.45)

    return F.size(F.filter(s, lambda b: big(b) & (b["close"] > b["open"]))), F.size(F.filter(s, lambda b: big(b) & (b["close"] < b["open"])))


def _sign(x: Column, bound: Column) -> Column:
    return F.when(x > bound, 1).when(x < -bound, -1).otherwise(0)


def vote(lo: Column, hi: Column) -> Column:
    """Score of the bars from lo to before hi (places in s of ``recent``): slope, halves, swings, bodies, and little overlap."""
    n, atr = hi - lo, F.col("atr")
    s = F.slice("s", lo + 1, n)
    at = lambda i: F.get("ema", i - (SPAN - 1))
    slope = at(hi - 1) - at(hi - 1 - F.least(F.lit(5), n - 1))
    closes, half = F.transform(s, lambda b: b["close"]), F.floor(n / 2).cast("int")
    halves = _mean(F.slice(closes, half + 1, n - half)) - _mean(F.slice(closes, F.lit(1), half))
    bull, bear = trend_bars(s, atr)
    bodies = F.when((bull >= bear * 2) & (bull >= 3), 1).when((bear >= bull * 2) & (bear >= 3), -1).otherwise(0)
    score = _sign(slope, atr * 0.06) + _sign(halves, atr * 0.12) + F.coalesce(swing(s), F.lit(0)) + bodies
    return F.when(n < 5, 0).otherwise(score + F.when(overlap(s) < 0.55, F.signum(score).cast("int")).otherwise(0))


def label(score: Column) -> Column:
    return F.when(score >= 2, "bullish").when(score <= -2, "bearish").otherwise("neutral")


def spike(s: Column, atr: Column) -> Column:
    """bullish or bearish where most of the last eight bars have bodies of one side and overlap little; else null."""
    last = F.slice(s, -8, 8)
    bull, bear = trend_bars(last, atr)
    return F.when(overlap(last) > 0.68, None).when((bull >= 3) & (bull >= bear * 2), "bullish").when((bear >= 3) & (bear >= bull * 2), "bearish")


def directions(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Per symbol: scores of the last 10, last 20 and earlier 30 bars, direction, spike, whether scales conflict, swings, place in
    the range, overlap of the last ten bars."""
    r, n = recent(bars, lookback), F.size("s")
    r = r.withColumn("n", n)
    n = F.col("n")
    start = F.greatest(F.lit(0), n - 40)
    r = r.withColumns({"recent_score": vote(n - 10, n), "trading_score": vote(n - 20, n), "background_score": vote(start, F.greatest(start + 5, n - 10))})
    c = F.col
    now, trading, behind = label(c("recent_score")), label(c("trading_score")), label(c("background_score"))
    main = label(c("trading_score") + F.greatest(F.lit(-1), F.least(F.lit(1), c("recent_score"))))
    against = lambda a, b: ((a == "bullish") & (b == "bearish")) | ((a == "bearish") & (b == "bullish"))
    high, low = F.array_max(F.transform("s", lambda b: b["high"])), F.array_min(F.transform("s", lambda b: b["low"]))
    close = F.element_at("s", -1)["close"]
    return r.select(
        "symbol", "recent_score", "trading_score", "background_score", main.alias("direction"), behind.alias("background"), spike(c("s"), c("atr")).alias("spike"), (against(now, trading) | against(behind, main)).alias("conflict"),
        F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit("HH+HL"), F.lit(-1), F.lit("LL+LH"), F.lit(0), F.lit("mixed")), swing(c("s"))), F.lit("insufficient")).alias("structure"),
        F.when(high > low, (close - low) / (high - low)).otherwise(0.5).alias("position"), overlap(F.slice("s", -10, 10)).alias("overlap"), "atr",
    )


def breakout_events(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(symbol, bar_idx, direction, event, level): closes beyond all earlier bars of the window, and what follows each of them up to
    the next one: tests of its level, and the close behind it that ends it. Windows alone: bars are numbered by the breakouts so far."""
    atr = recent(bars, lookback).select("symbol", "atr")
    b = tail(bars, lookback).select("symbol", "bar_idx", "high", "low", "close").join(atr, "symbol")
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    slack, near = F.greatest(F.col("atr") * 0.01, F.lit(1e-10)), F.col("atr") * 0.25
    sides = []
    # downwards is upwards with all prices negated
    for name, sign, high, low in (("up", 1, "high", "low"), ("down", -1, "low", "high")):
        x = b.select("symbol", "bar_idx", "atr", *[(F.col(c) * sign).alias(a) for c, a in ((high, "high"), (low, "low"), ("close", "close"))])
        x = x.withColumn("top", F.max("high").over(before)).withColumn("out", F.coalesce(F.col("close") > F.col("top") + slack, F.lit(False)))
        x = x.withColumns({"run": F.sum(F.col("out").cast("int")).over(so_far), "level": F.last(F.when(F.col("out"), F.col("top")), ignorenulls=True).over(so_far)}).where("run > 0")
        x = x.withColumn("fails", ~F.col("out") & (F.col("close") < F.col("level") - slack))
        ended = F.min(F.when(F.col("fails"), F.col("bar_idx"))).over(Window.partitionBy("symbol", "run"))
        x = x.withColumn("ended", ended).where(F.col("ended").isNull() | (F.col("bar_idx") <= F.col("ended")))
        event = F.when(F.col("out"), "breakout").when(F.col("fails"), "failed").when((F.col("low") <= F.col("level") + near) & (F.col("close") > F.col("level")), "test")
        sides.append(x.select("symbol", "bar_idx", F.lit(name).alias("direction"), event.alias("event"), (F.col("level") * sign).alias("level")).where("event is not null"))
    return sides[0].unionByName(sides[1])


#: The checks of an order in their order, each with the code of a refusal.
CHECKS = {
    "feature_flag": "execution_disabled", "kill_switch": "kill_switch_active", "user_permission": "permission_denied", "strategy_production": "strategy_not_production", "market_open": "market_closed", "duplicate_order": "duplicate_order",
    "fresh_signal": "stale_signal", "symbol_allowed": "symbol_not_allowed", "order_size": "max_order_notional", "price_deviation": "price_deviation", "gross_exposure": "max_gross_exposure", "daily_loss": "daily_loss_limit",
}


def risk_gate(
    orders: DataFrame, enabled: bool = False, killed: bool = False, production: bool = True, need_open: bool = True, max_notional: float | None = None, max_exposure: float | None = None,
    max_deviation: float | None = 0.05, max_age: float | None = None, max_loss: float | None = None, symbols: tuple[str, ...] = (),
) -> DataFrame:
    """``orders`` (symbol, notional, limit_price, reference_price, status, permitted, market_open, age, duplicate, gross_exposure,
    daily_pnl) with allowed, code (the first check that refuses, '' if none) and checks (names made, the refusing one last).
    A missing price, or a missing day's result, passes its check; any other missing value refuses."""
    c, yes = F.col, F.lit(True)
    off = F.abs(c("limit_price") - c("reference_price")) / c("reference_price")
    passes = {
        "feature_flag": F.lit(enabled), "kill_switch": F.lit(not killed), "user_permission": c("permitted"), "strategy_production": c("status") == "PRODUCTION" if production else yes,
        "market_open": c("market_open") if need_open else yes, "duplicate_order": ~c("duplicate"), "fresh_signal": yes if max_age is None else c("age").between(0, max_age),
        "symbol_allowed": F.upper("symbol").isin(*[s.upper() for s in symbols]) if symbols else yes, "order_size": yes if max_notional is None else (c("notional") > 0) & (c("notional") <= max_notional),
        "price_deviation": yes if max_deviation is None else F.when(c("limit_price").isNull() | c("reference_price").isNull(), True).when(c("reference_price") <= 0, False).otherwise(off <= max_deviation),
        "gross_exposure": yes if max_exposure is None else c("gross_exposure") + c("notional") <= max_exposure, "daily_loss": yes if max_loss is None else c("daily_pnl").isNull() | (c("daily_pnl") >= -abs(max_loss)),
    }
    first = F.coalesce(*[F.when(~F.coalesce(passes[k], F.lit(False)), i) for i, k in enumerate(CHECKS, 1)], F.lit(0))
    made = orders.withColumn("_first", first)
    codes, names = F.array(*map(F.lit, CHECKS.values())), F.array(*map(F.lit, CHECKS))
    return made.withColumns({
        "allowed": F.col("_first") == 0, "code": F.coalesce(F.get(codes, F.col("_first") - 1), F.lit("")),
        "checks": F.slice(names, F.lit(1), F.when(F.col("_first") == 0, len(CHECKS)).otherwise(F.col("_first"))),
    }).drop("_first")


#: Fixed values of the pullback counter: bars beside a pivot, bars that a leg lives, bars that a symbol needs, the highest tag.
PIVOT, LEG, HL_LEAST, HL_TAG = 2, 30, 6, 3
#: Bars of a block; blocks carry the neighbouring bars that their legs reach. Bars worked on at once in a task.
HL_BLOCK, HL_BARS = 512, 400_000
_NEVER = 1 << 60
_HOW = ("open", "broken", "expired")
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _order(x: np.ndarray) -> np.ndarray:
    """Integers in the order of Spark's doubles: not-a-number is above all and equal to itself, both zeros are equal."""
    b = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return b ^ (b >> 63 & _MOST)


def _legs(seg: np.ndarray, at: np.ndarray, own: np.ndarray, h: tuple, l: tuple) -> tuple:  # noqa: E741
    """Pivots of all blocks at once, and what becomes of each one's leg over the bars behind its confirmation.

    ``h`` and ``l`` hold the prices twice: for the left side of a comparison and for the right one, so that a missing price fails it.
    """
    pivot = own.copy()
    for k in range(1, PIVOT + 1):
        same = seg[k:] == seg[:-k]
        pivot[:k] = pivot[-k:] = False
        pivot[k:] &= same & (h[0][k:] > h[1][:-k])
        pivot[:-k] &= same & (h[0][:-k] > h[1][k:])
    p = np.flatnonzero(pivot)
    end, swing, origin = np.searchsorted(seg, seg[p], "right"), h[1][p], at[p]
    count, last, until, how = np.zeros(len(p), np.int32), np.full(len(p), -1), np.full(len(p), _NEVER), np.zeros(len(p), np.int8)
    armed, signal, live = np.ones(len(p), bool), np.full(len(p), _LEAST), np.arange(len(p))
    for d in range(PIVOT + 1, LEG + 2):
        live = live[p[live] + d < end[live]]
        j = p[live] + d
        broken = h[0][j] > swing[live]
        ended = broken | (at[j] - origin[live] > LEG)
        until[live[ended]], how[live[ended]] = at[j[ended]], np.where(broken[ended], 1, 2)
        live, j = live[~ended], j[~ended]
        ready = armed[live] | (l[0][j] < signal[live])
        fires = ready & (h[0][j] > h[1][j - 1])
        armed[live] = ready & ~fires
        f, j = live[fires], j[fires]
        count[f] += 1
        last[f], signal[f] = at[j], l[1][j - 1]
    return p, origin, until, how, count, last


def _leaves(seg: np.ndarray, start: np.ndarray, origin: np.ndarray, until: np.ndarray, size: int) -> np.ndarray:
    """Each block's function, a row of ``LEG`` + 3: on which bar it leaves its symbol free, by the bar on which it finds it so (the last: never)."""
    width, n = size + 2 * LEG, len(seg)
    key = seg * width + origin - start[seg]
    # the leg that follows each leg; none where the block has no later pivot
    after = np.searchsorted(key, np.where(until < _NEVER, seg * width + until + 1 - PIVOT - start[seg], _MOST))
    follows = (after < n) & (np.append(seg, -1)[after] == seg)
    final = np.where(follows, after, np.arange(n))
    while (final[final] != final).any():
        final = final[final]
    i = np.arange(LEG + 2)
    first = np.searchsorted(key, np.arange(len(start))[:, None] * width + i - PIVOT)
    has = np.append(seg, -1)[first] == np.arange(len(start))[:, None]
    out = np.where(has, np.append(until[final] + 1, 0)[first], start[:, None] + i)
    return np.hstack([out, np.full((len(start), 1), _NEVER)])


def _blocks(size: int):
    """From blocks of bars to their pivots' legs and their functions, for both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = max(1, HL_BARS // (size + LEG + PIVOT))
        for whole in batches:
            for batch in (whole.slice(k, few) for k in range(0, whole.num_rows, few)):
                bars, block = batch.column("s").flatten(), batch.column("block").to_numpy()
                seg = np.repeat(np.arange(len(block)), pc.list_value_length(batch.column("s")).to_numpy())
                at, high, low = (bars.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                gone = [bars.field(k).is_null().to_numpy(zero_copy_only=False) for k in (1, 2)]
                if not ((np.diff(at) > 0) | (np.diff(seg) > 0)).all():
                    o = np.lexsort((at, seg))
                    at, high, low, gone = at[o], high[o], low[o], [g[o] for g in gone]
                own = at // size == block[seg]
                n = np.bincount(seg[own], minlength=len(block))
                for side in (1, -1):
                    (h, no_h), (l, no_l) = ((high, gone[0]), (low, gone[1])) if side == 1 else ((-low, gone[1]), (-high, gone[0]))  # noqa: E741
                    h, l = _order(h), _order(l)  # noqa: E741
                    tops, lows = (np.where(no_h, _LEAST, h), np.where(no_h, _MOST, h)), (np.where(no_l, _MOST, l), np.where(no_l, _LEAST, l))
                    p, origin, until, how, count, last = _legs(seg, at, own, tops, lows)
                    ends = np.searchsorted(seg[p], np.arange(len(block) + 1)).astype(np.int32)
                    legs = pa.StructArray.from_arrays([pa.array(origin), pa.array(until), pa.array(_HOW).take(pa.array(how)), pa.array(count), pa.array(last, mask=last < 0)], ["origin", "until", "how", "count", "last"])
                    after = _leaves(seg[p], block * size, origin, until, size)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("symbol"), pa.array(np.full(len(block), side, np.int32)), batch.column("block"), pa.array(n), pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * (LEG + 3), after.ravel()), pa.ListArray.from_arrays(ends, legs)],
                        ["symbol", "side", "block", "n", "after", "legs"],
                    )

    return run


def _free(size: int):
    """From which bar on each block may begin a leg: a symbol's functions one after the other, as they come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, 0
        for batch in batches:
            after, out = batch.column("after").flatten().to_numpy().reshape(-1, LEG + 3), []
            for k, (symbol, side, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("symbol", "side", "block")), strict=True)):
                if now != (symbol, side):
                    now, free = (symbol, side), 0
                out.append(free)
                free = int(after[k, LEG + 2 if free >= _NEVER else max(0, free - block * size)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("symbol", "side", "block")), pa.array(out, pa.int64())], ["symbol", "side", "block", "free"])

    return run


def leg_blocks(bars: DataFrame, block: int = HL_BLOCK) -> DataFrame:
    """Blocks of ``block`` bars (more than ``LEG``) by side, a written table: symbol, side, block, n (its bars), after (its function), legs (of all its pivots)."""
    spark, kind = bars.sparkSession, dict(bars.dtypes)["symbol"]
    own, place = F.floor(F.col("bar_idx") / block), F.col("bar_idx") % block
    beside = F.array_compact(F.array(own, F.when(place >= block - PIVOT, own + 1), F.when((place <= LEG) & (own > 0), own - 1)))
    bar = F.struct(F.col("bar_idx").cast("long").alias("bar_idx"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"))
    rows = bars.select("symbol", F.explode(beside).alias("block"), bar.alias("bar"))
    cells = rows.groupBy("symbol", "block").agg(F.collect_list("bar").alias("s"))
    made = cells.mapInArrow(_blocks(block), f"symbol {kind}, side int, block long, n long, after array<long>, legs array<struct<origin: long, until: long, how: string, count: int, last: long>>")
    path = f"{with_checkpoints(spark)}/legs-{uuid.uuid4().hex}"
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _living(blocks: DataFrame, block: int = HL_BLOCK) -> DataFrame:
    """The legs of ``leg_blocks`` that live."""
    blocks, kind = blocks.where("symbol is not null"), dict(blocks.dtypes)["symbol"]
    functions = blocks.select("symbol", "side", "block", "after").repartition("symbol", "side").sortWithinPartitions("symbol", "side", "block")
    free = functions.mapInArrow(_free(block), f"symbol {kind}, side int, block long, free long")
    taken = lambda free, g: g["origin"] + PIVOT >= free
    none = F.struct(F.col("free").alias("free"), F.filter("legs", lambda g: F.lit(False)).alias("legs"))
    chosen = F.aggregate("legs", none, lambda s, g: F.when(taken(s["free"], g), F.struct((g["until"] + 1).alias("free"), F.concat(s["legs"], F.array(g)).alias("legs"))).otherwise(s))["legs"]
    out = blocks.select("symbol", "side", "block", "legs").join(free, ["symbol", "side", "block"]).select("symbol", "side", F.explode(chosen).alias("g"))
    return out.select("symbol", "side", "g.origin", F.when(F.col("g.how") != "open", F.col("g.until")).alias("until"), "g.how", "g.count", F.col("g.last").alias("last_trigger"))


def hl_legs(bars: DataFrame, block: int = HL_BLOCK) -> DataFrame:
    """Pullback legs of each symbol, side 1 from swing highs (H counts) and -1 from swing lows (L counts, mirrored):
    symbol, side, origin, until, how (broken, expired, open), count, last_trigger.

    A leg begins at a fractal pivot while no other one lives, and ends where its pivot is passed or after ``LEG`` bars; a
    trigger is a bar above the one before it, armed again when a bar falls below the last signal bar. What a pivot's
    leg would count depends on ``LEG`` bars behind it, so all pivots are worked on in blocks with those bars beside them, many
    blocks at once in numpy. Which legs live is a chain: a block is a function from the bar on which it finds its symbol free (one of
    ``LEG`` + 2, or never) to the one on which it leaves it, and only these functions, one short row a block, pass in a symbol's order.
    """
    return _living(leg_blocks(bars, block), block)


def hl_count(bars: DataFrame) -> DataFrame:
    """One row a symbol: triggers in the legs that live at its last bar, their tags, last triggers and pivots; no leg: 0 and none."""
    blocks = leg_blocks(bars)
    n = blocks.where("side = 1").groupBy("symbol").agg(F.sum("n").alias("n"))
    live = _living(blocks).where("how = 'open'").groupBy("symbol").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{name}_{c}") for s, name in ((1, "bull"), (-1, "bear")) for c in ("count", "last_trigger", "origin")])
    j = n.join(live, "symbol", "left")
    enough = F.col("n") >= HL_LEAST

    def tag(name: str, letter: str) -> Column:
        c = F.when(enough, F.col(f"{name}_count"))
        return F.when(c > 0, F.concat(F.lit(letter), F.least(c, F.lit(HL_TAG)).cast("string"))).otherwise("none").alias(f"{name}_candidate")

    counts = [F.coalesce(F.when(enough, F.col(f"{s}_count")), F.lit(0)).alias(f"{s}_count") for s in ("bull", "bear")]
    places = [F.when(enough, F.col(f"{s}_{c}")).alias(f"{s}_{to}") for s in ("bull", "bear") for c, to in (("last_trigger", "last_trigger"), ("origin", "leg_start"))]
    return j.select("symbol", *counts, tag("bull", "h"), tag("bear", "l"), *places)

"""Price levels: pivots, profiles, touches, probabilities, and the retest strategy over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.shared import spread

from tickloom.functions.ranges import running_total
from tickloom.functions.recurrence import ema


def S():  # noqa: N802
    """Along a symbol's time."""
    return Window.partitionBy("symbol").orderBy("bar_idx")



def rows(lo: int, hi: int):
    return S().rowsBetween(lo, hi)


def true_range(bars: DataFrame) -> DataFrame:
    before = F.coalesce(F.lag("close").over(S()), F.col("close"))
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def density_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range up to bar ``n``; from then on n + 1 ranges over n, as its calibration expects."""
    k = F.row_number().over(S())
    return true_range(bars).withColumn("atr", F.when(k <= n, F.sum("tr").over(rows(-n, 0)) / k).otherwise(F.sum("tr").over(rows(-n, 0)) / n))


def seeded_average(df: DataFrame, columns: dict[str, tuple[str, int, float]]) -> DataFrame:
    """name -> (column, n, span): null before n values, then the mean of n, then the recursion of ``span``
    (Wilder's of n has span 2n - 1)."""
    out = df
    for name, (c, n, span) in columns.items():
        seed = F.when(F.col("bar_idx") == n - 1, F.avg(c).over(rows(1 - n, 0))).otherwise(F.col(c))
        late = out.withColumn("_x", seed).where(F.col("bar_idx") >= n - 1).select("symbol", (F.col("bar_idx") - (n - 1)).alias("_k"), "_x")
        made = ema(late, {name: ("_x", span)}, at="_k").select("symbol", (F.col("_k") + (n - 1)).alias("bar_idx"), name)
        out = out.join(made, ["symbol", "bar_idx"], "left")
    return out


def indicators(bars: DataFrame) -> DataFrame:
    """ema20, ema60, atr14, clv, body_ratio, overlap10, er20, slope20, adv20; null until their windows are full."""
    made = seeded_average(true_range(bars), {"ema20": ("close", 20, 20), "ema60": ("close", 60, 60), "atr14": ("tr", 14, 27)})
    k, span = F.row_number().over(S()), F.col("high") - F.col("low")
    full = lambda n, x: F.when(k >= n, x)
    ph, pl, pc = (F.lag(c).over(S()) for c in ("high", "low", "close"))
    over = F.when((ph > F.col("low")) & (pl < F.col("high")), (F.least("high", ph) - F.greatest("low", pl)) / (F.greatest("high", ph) - F.least("low", pl))).otherwise(1.0)
    made = made.withColumns({
        "clv": F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5), "body_ratio": F.when(span > 0, F.abs(F.col("close") - F.col("open")) / span).otherwise(0.0),
        "_overlap": over, "_step": F.abs(F.col("close") - pc), "turnover": F.col("close") * F.col("volume"),
    })
    path = F.sum("_step").over(rows(-19, 0))
    return made.withColumns({
        "overlap10": full(10, F.avg("_overlap").over(rows(-9, 0))), "er20": full(21, F.when(path > 0, F.abs(F.col("close") - F.lag("close", 20).over(S())) / path).otherwise(0.0)),
        "slope20": (F.col("ema20") - F.lag("ema20", 5).over(S())) / F.col("atr14"), "adv20": full(20, F.avg("turnover").over(rows(-19, 0))), "ema20_lag5": F.lag("ema20", 5).over(S()),
    }).drop("_overlap", "_step")


def regime() -> Column:
    c = F.col
    missing = c("overlap10").isNull() | c("er20").isNull() | c("slope20").isNull()
    chaos = (c("overlap10") >= 0.65) & (c("er20") <= 0.20) & (F.abs("slope20") <= 0.25)
    up = (c("close") > c("ema20")) & (c("ema20") > c("ema60")) & (c("slope20") >= 0.25) & (c("er20") >= 0.25)
    down = (c("close") < c("ema20")) & (c("ema20") < c("ema60")) & (c("slope20") <= -0.25)
    return F.when(missing, "INVALID").when(chaos, "CHAOS").when(up, "UPTREND").when(down, "DOWNTREND").otherwise("NEUTRAL")


def market_gate() -> Column:
    known = F.col("ema60").isNotNull() & F.col("ema20").isNotNull() & F.col("ema20_lag5").isNotNull()
    return F.when(~known, "UNKNOWN").when((F.col("close") > F.col("ema60")) & (F.col("ema20") >= F.col("ema20_lag5")), "RISK_ON").otherwise("RISK_OFF")


def fractals(bars: DataFrame, k: int = 2, strict: bool = True) -> DataFrame:
    """Pivots (kind 1 high, -1 low) that are extreme among ``k`` bars on either side, known ``k`` bars later."""
    inside = (F.count("*").over(rows(-k, -1)) == k) & (F.count("*").over(rows(1, k)) == k)

    def extreme(c: str, f, above) -> Column:
        if strict:
            return above(F.col(c), f(c).over(rows(-k, -1))) & above(F.col(c), f(c).over(rows(1, k)))
        return f(c).over(rows(-k, k)) == F.col(c)

    high, low = extreme("high", F.max, lambda a, b: a > b), extreme("low", F.min, lambda a, b: a < b)
    found = bars.withColumn("_p", F.array_compact(F.array(F.when(inside & high, F.struct(F.lit(1).alias("kind"), F.col("high").alias("price"))), F.when(inside & low, F.struct(F.lit(-1).alias("kind"), F.col("low").alias("price"))))))
    return found.select("symbol", "bar_idx", F.explode("_p").alias("p")).select("symbol", "bar_idx", "p.kind", "p.price", (F.col("bar_idx") + k).alias("confirm_idx"))


def visible(pivots: DataFrame, at: DataFrame, most: int = 600) -> DataFrame:
    """For each (symbol, t) of ``at`` the pivots that are confirmed by t and not older than ``most`` bars; found through
    buckets of ``most`` bars, so that a pivot meets two buckets alone."""
    near = pivots.withColumn("_b", F.explode(F.array(F.floor(F.col("bar_idx") / most), F.floor(F.col("bar_idx") / most) + 1)))
    j = at.withColumn("_b", F.floor(F.col("t") / most)).join(near, ["symbol", "_b"])
    return j.where((F.col("confirm_idx") <= F.col("t")) & (F.col("bar_idx") >= F.col("t") - most)).drop("_b")


def zigzag(bars: DataFrame, k: float = 2.0) -> DataFrame:
    """Pivots that a reversal of ``k`` ATR confirms: symbol, idx, price, kind, confirm_idx, leg_atr. The direction depends on all
    bars before, so one grouped kernel per symbol reads them in order; only (idx, high, low, atr) go there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        at, high, low, atr = (pdf[c].to_numpy() for c in ("bar_idx", "high", "low", "atr"))
        out, side, last = [], 0, np.nan
        best = {1: (0, high[0]), -1: (0, low[0])}

        def turn(kind: int, i: int) -> None:
            nonlocal side, last
            j, price = best[kind]
            out.append((int(at[j]), float(price), kind, int(at[i]), 0.0 if np.isnan(last) else abs(price - last) / max(atr[j], 1e-12)))
            side, last = -kind, price
            best[-kind] = (i, low[i] if kind == 1 else high[i])

        for i in range(1, len(at)):
            if side >= 0 and high[i] > best[1][1]:
                best[1] = (i, high[i])
            if side <= 0 and low[i] < best[-1][1]:
                best[-1] = (i, low[i])
            size = k * max(atr[i], 1e-12)
            if side >= 0 and best[1][1] - low[i] >= size:
                turn(1, i)
            elif side <= 0 and high[i] - best[-1][1] >= size:
                turn(-1, i)
        found = pd.DataFrame(out, columns=["idx", "price", "kind", "confirm_idx", "leg_atr"])
        return found.assign(symbol=pdf["symbol"].iloc[0])[["symbol", "idx", "price", "kind", "confirm_idx", "leg_atr"]]

    need = density_atr(bars).select("symbol", "bar_idx", "high", "low", "atr")
    return need.groupBy("symbol").applyInPandas(run, "symbol string, idx long, price double, kind int, confirm_idx long, leg_atr double")


def decay(age: Column, half_life: float) -> Column:
    return F.exp(-F.lit(float(np.log(2.0))) * age / half_life)


def volume_profile(bars: DataFrame, bins: int = 50, half_life: float = 0.0) -> DataFrame:
    """Volume by price bin, each bar's spread evenly over the bins it spans: two rows a bar and a running sum."""
    edge = bars.groupBy("symbol").agg(F.min("low").alias("p0"), F.max("high").alias("p1"), F.max("bar_idx").alias("last"))
    b = bars.join(edge, "symbol").withColumn("w", (F.col("p1") - F.col("p0")) / bins)
    at = lambda c: F.least(F.floor((F.col(c) - F.col("p0")) / F.col("w")), F.lit(bins - 1))
    weight = F.col("volume") * (decay(F.col("last") - F.col("bar_idx"), half_life) if half_life > 0 else F.lit(1.0))
    b = b.withColumns({"lo": at("low"), "hi": at("high")}).withColumn("share", weight / (F.col("hi") - F.col("lo") + 1))
    ends = b.select("symbol", F.explode(F.array(F.struct(F.col("lo").alias("bin"), F.col("share").alias("d")), F.struct((F.col("hi") + 1).alias("bin"), (-F.col("share")).alias("d")))).alias("e"))
    steps = ends.groupBy("symbol", "e.bin").agg(F.sum("e.d").alias("d"))
    grid = edge.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    run = Window.partitionBy("symbol").orderBy("bin")
    return grid.join(steps, ["symbol", "bin"], "left").select("symbol", "bin", F.sum(F.coalesce("d", F.lit(0.0))).over(run).alias("volume"))


def blur(profile: DataFrame, sigma: float, value: str = "volume") -> DataFrame:
    """Gaussian mean over neighbouring bins, divided by the weights that lie inside."""
    r = int(max(1, round(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w = Window.partitionBy("symbol").orderBy("bin")
    total, norm = F.lit(0.0), F.lit(0.0)
    for step, weight in zip(range(-r, r + 1), k / k.sum(), strict=True):
        v = F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w) if step < 0 else F.col(value)
        total, norm = total + F.coalesce(v, F.lit(0.0)) * float(weight), norm + F.when(v.isNull(), 0.0).otherwise(float(weight))
    return profile.withColumn(value, total / norm)


def robust_z(profile: DataFrame, value: str = "volume") -> DataFrame:
    """0 to 1 by median and MAD; where the MAD is nothing, the share of the maximum."""
    mid = profile.groupBy("symbol").agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.max(value).alias("_x"))
    off = profile.join(mid, "symbol").withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = off.groupBy("symbol").agg((1.4826 * F.percentile("_d", F.lit(0.5))).alias("_s"))
    z = F.when(F.col("_s") < 1e-12, F.when(F.col("_x") > 1e-12, F.col(value) / F.col("_x")).otherwise(0.0)).otherwise(1 / (1 + F.exp(-(F.col(value) - F.col("_m")) / F.greatest("_s", F.lit(1e-12)) / 2)))
    return off.join(mad, "symbol").withColumn("z", z).drop("_m", "_x", "_d", "_s")


def peaks(profile: DataFrame, value: str = "volume") -> DataFrame:
    """Bins higher than both neighbours; of a flat top its middle."""
    w = Window.partitionBy("symbol").orderBy("bin")
    runs = profile.withColumn("_new", F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    flat = runs.groupBy("symbol", "_run").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.max(value).alias(value))
    r = Window.partitionBy("symbol").orderBy("_run")
    top = (F.coalesce(F.lag(value).over(r), F.lit(-1.0)) < F.col(value)) & (F.coalesce(F.lead(value).over(r), F.lit(-1.0)) < F.col(value))
    return flat.withColumn("_top", top).where("_top").select("symbol", F.floor((F.col("a") + F.col("b")) / 2).alias("bin"), value)


def spaced(found: DataFrame, least: int, value: str = "volume") -> DataFrame:
    """Greedy choice from the highest on of peaks at least ``least`` bins apart; a profile has few bins, so one kernel a symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for i, b in pdf.sort_values([value, "bin"], ascending=[False, True])["bin"].items():
            if all(abs(b - pdf.at[k, "bin"]) >= least for k in kept):
                kept.append(i)
        return pdf.loc[kept]

    return found.groupBy("symbol").applyInPandas(run, found.schema)


def touches(bars: DataFrame, zones: DataFrame, hold: int = 10, break_atr: float = 0.5, target_atr: float = 1.0) -> DataFrame:
    """Entries of zones (symbol, zone, lo, hi, support) from their own side, with what came first in ``hold`` bars: held or broken.
    A window of later bars replaces the join of every entry with its bars."""
    later = S().rowsBetween(0, hold)
    b = density_atr(bars).withColumn("before", F.coalesce(F.lag("close").over(S()), F.col("close"))).withColumn("next", F.collect_list(F.struct("high", "low", "close")).over(later))
    j = b.join(zones, "symbol").where((F.col("low") <= F.col("hi")) & (F.col("high") >= F.col("lo")) & F.when(F.col("support"), F.col("before") > F.col("hi")).otherwise(F.col("before") < F.col("lo")))
    floor, roof = F.col("lo"), F.col("hi")
    out = lambda x: F.when(F.col("support"), x["close"] < floor - break_atr * F.col("atr")).otherwise(x["close"] > roof + break_atr * F.col("atr"))
    hit = lambda x: F.when(F.col("support"), x["high"] >= roof + target_atr * F.col("atr")).otherwise(x["low"] <= floor - target_atr * F.col("atr"))
    first = lambda f: F.coalesce(F.nullif(F.array_position(F.transform("next", f), F.lit(True)), F.lit(0)), F.lit(10**9))
    j = j.withColumns({"broke": first(out), "got": first(hit)})
    return j.select("symbol", "zone", "bar_idx", F.when((F.col("broke") == 10**9) & (F.col("got") == 10**9), None).otherwise(F.col("got") <= F.col("broke")).alias("held"))


def cooled(entries: DataFrame, gap: int = 5) -> DataFrame:
    """Greedy thinning: after an entry that counts, none within ``gap`` bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], -(10**9)
        for i, at in pdf.sort_values("bar_idx")["bar_idx"].items():
            if at - last >= gap:
                keep.append(i)
                last = at
        return pdf.loc[keep]

    return entries.groupBy("symbol", "zone").applyInPandas(run, entries.schema)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share."""
    p, d = k / n, 1 + z * z / n
    c, h = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), c - h), F.least(F.lit(1.0), c + h)


def round_bonus(center: Column, atr: Column) -> Column:
    s = F.pow(F.lit(10.0), F.floor(F.log10(center)) - 1)
    each = []
    for mult, weight in ((1.0, 0.4), (5.0, 0.7), (10.0, 1.0)):
        d = F.abs(center - F.rint(center / (s * mult)) * s * mult)
        each.append(weight * F.exp(-0.5 * F.pow(d / F.greatest(0.2 * atr, F.lit(1e-12)), F.lit(2.0))))
    return F.when(center > 0, F.greatest(*each)).otherwise(0.0)


def near(left: DataFrame, right: DataFrame, a: str, b: str, width: Column, most: float, same: tuple[str, str] | None = None) -> DataFrame:
    """Band join |a - b| <= width, where width is ``most`` at most: equi-join on buckets of ``most``, each right row in three of them, and on
    the columns ``same`` (left, right) where both sides must agree."""
    near = right.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(b) / most) + k)))
    l_keys, r_keys = (["_b", *([same[k]] if same else [])] for k in (0, 1))
    l, r = spread(left.withColumn("_b", F.floor(F.col(a) / most)), *l_keys).alias("l"), spread(near, *r_keys).alias("r")  # noqa: E741
    j = l.join(r, [F.col(f"l.{x}") == F.col(f"r.{y}") for x, y in zip(l_keys, r_keys, strict=True)])
    return j.where(F.abs(F.col(f"l.{a}") - F.col(f"r.{b}")) <= width).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])


def bucket(x: Column, edges: list[float]) -> Column:
    """1 + the number of edges at or below x."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) + 1


def logistic(columns: list[str], mean: list[float], sd: list[float], coef: list[float]) -> Column:
    """Probability from standardised columns; ``coef`` starts with the intercept; the exponent is clipped at 30."""
    z = F.lit(coef[0])
    for c, m, s, k in zip(columns, mean, sd, coef[1:], strict=True):
        z = z + (F.col(c) - m) / s * k
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def fit_logistic(rows_: DataFrame, columns: list[str], label: str, l2: float = 1.0, rounds: int = 8) -> dict:
    """Newton steps of a ridge logistic model. Each step is one aggregate of (k + 1)^2 sums over all rows; the driver solves that small system."""
    stats = rows_.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean, sd = [stats[f"m{i}"] for i in range(len(columns))], [stats[f"s{i}"] or 1.0 for i in range(len(columns))]
    beta = np.zeros(len(columns) + 1)
    xs = [F.lit(1.0), *[(F.col(c) - m) / s for c, m, s in zip(columns, mean, sd, strict=True)]]
    for _ in range(rounds):
        p = logistic(columns, mean, sd, beta.tolist())
        grad = [F.sum(x * (F.col(label) - p)).alias(f"g{i}") for i, x in enumerate(xs)]
        hess = [F.sum(xs[i] * xs[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
        r = rows_.agg(*grad, *hess).first()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(xs))] for i in range(len(xs))])
        step = np.linalg.solve(h + l2 * np.eye(len(xs)), np.array([r[f"g{i}"] for i in range(len(xs))]) - l2 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return {"columns": columns, "mean": mean, "sd": sd, "coef": beta.tolist()}


def auc_brier(scored: DataFrame, p: str, y: str) -> DataFrame:
    """AUC by ranks and mean squared error. Ranks come from counts per distinct score, summed within ranges of the score."""
    per = scored.groupBy(p).agg(F.count("*").alias("n"), F.sum(y).alias("k"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("e"))
    r = running_total(per, p, "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    a = r.agg(F.sum(F.col("rank") * F.col("k")).alias("s"), F.sum("k").alias("pos"), F.sum("n").alias("all"), F.sum("e").alias("e"))
    neg = F.col("all") - F.col("pos")
    return a.select(F.when((F.col("pos") > 0) & (neg > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).alias("auc"), (F.col("e") / F.col("all")).alias("brier"))


def level_zones(bars: DataFrame, k: int = 2, width_atr: float = 0.35, per_side: int = 3) -> DataFrame:
    """Zones around fractal pivots, the nearest ``per_side`` on each side of the last close, with how many pivots lie in each."""
    p = fractals(bars, k)
    last = seeded_average(true_range(bars), {"atr14": ("tr", 14, 27)}).groupBy("symbol").agg(F.max_by("close", "bar_idx").alias("close"), F.max_by("atr14", "bar_idx").alias("atr"))
    z = p.join(last, "symbol").select("symbol", "close", "atr", F.col("price").alias("center"), "bar_idx", (F.col("price") - width_atr * F.col("atr")).alias("lo"), (F.col("price") + width_atr * F.col("atr")).alias("hi"))
    n = z.alias("a").join(p.alias("b"), (F.col("a.symbol") == F.col("b.symbol")) & F.col("b.price").between(F.col("a.lo"), F.col("a.hi"))).groupBy(*[F.col(f"a.{c}") for c in z.columns]).agg(F.count("*").alias("pivots"))
    side = n.withColumn("support", F.col("center") < F.col("close"))
    order = Window.partitionBy("symbol", "support").orderBy(F.abs(F.col("center") - F.col("close")), "bar_idx")
    return side.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_side).drop("_n")


def swings(pivots: DataFrame) -> DataFrame:
    """UP, DOWN or RANGE from the last two highs and lows of each symbol."""
    w = Window.partitionBy("symbol", "kind").orderBy(F.desc("bar_idx"))
    two = pivots.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy("symbol").agg(*[F.max(F.when((F.col("kind") == k) & (F.col("_n") == n), F.col("price"))).alias(f"{name}{n}") for k, name in ((1, "h"), (-1, "l")) for n in (1, 2)])
    up, down = (F.col("h1") > F.col("h2")) & (F.col("l1") > F.col("l2")), (F.col("h1") < F.col("h2")) & (F.col("l1") < F.col("l2"))
    return two.select("symbol", F.when(up, "UP").when(down, "DOWN").otherwise("RANGE").alias("structure"))


def breakouts(bars: DataFrame) -> DataFrame:
    """Bars that close beyond the running extreme of all bars before."""
    up = S().rowsBetween(Window.unboundedPreceding, -1)
    hi, lo = F.max("high").over(up), F.min("low").over(up)
    kind = F.when(F.col("close") > hi, 1).when(F.col("close") < lo, -1)
    return bars.withColumn("kind", kind).where("kind is not null")


def volume_state(bars: DataFrame) -> DataFrame:
    """Mean volume of five bars against the twenty before: EXPANDING from 1.2, CONTRACTING to 0.8."""
    r = F.avg("volume").over(rows(-4, 0)) / F.avg("volume").over(rows(-24, -5))
    b = bars.withColumn("ratio", r)
    return b.withColumn("state", F.when(F.col("ratio") >= 1.2, "EXPANDING").when(F.col("ratio") <= 0.8, "CONTRACTING").otherwise("NORMAL"))


def size_position(equity, entry, stop, atr, fraction: float = 0.0025, gap: float = 0.5, cost: float = 0.0, lot: int = 100) -> Column:
    risk = F.greatest(entry - stop, F.lit(0.01)) + gap * atr + cost
    return F.when((equity <= 0) | (entry <= 0) | (stop >= entry), 0).otherwise(F.floor(F.floor(equity * fraction / risk) / lot) * lot).cast("long")


def retest_strategy(rows_: DataFrame) -> DataFrame:
    """The breakout-retest states of each symbol: symbol, bar_idx, state, entry, stop, target at every change. ``rows_`` are
    ``indicators`` with zone_lo, zone_hi (the nearest resistance known at the bar, null if none) and regime."""
    need = ["symbol", "bar_idx", "open", "high", "low", "close", "atr14", "clv", "body_ratio", "zone_lo", "zone_hi", "regime"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, lo, hi, atr, before, out = "IDLE", 0.0, 0.0, 0.0, None, []
        for r in pdf.sort_values("bar_idx").itertuples():
            was, plan = state, (None, None, None)
            if state == "IDLE":
                a = r.atr14 if r.atr14 == r.atr14 else 0.0
                if a > 0 and r.zone_hi == r.zone_hi and r.close > r.zone_hi + 0.2 * a and r.close > r.open and r.clv >= 0.65 and r.body_ratio >= 0.5:
                    state, lo, hi, atr = "BREAKOUT_SEEN", r.zone_lo, r.zone_hi, a
            elif state == "BREAKOUT_SEEN" and r.close > hi:
                state = "HELD_ABOVE"
            elif state == "HELD_ABOVE" and r.low <= hi + 0.35 * atr and r.close >= lo:
                state = "RETEST_SEEN"
            elif state == "RETEST_SEEN" and r.close > r.open and r.clv >= 0.65 and r.close > hi + 0.1 * atr and r.close > (before if before is not None else r.close):
                state, stop = "CONFIRMED", min(lo, r.low) - 0.2 * atr
                plan = (r.close, stop, r.close + 2.0 * (r.close - stop))
            if state not in ("CONFIRMED", "IDLE", "INVALIDATED") and (r.close < lo - 0.5 * atr or r.regime in ("INVALID", "CHAOS", "DOWNTREND")):
                state = "INVALIDATED"
            before = r.high
            if state != was:
                out.append((r.symbol, r.bar_idx, state, *plan))
        return pd.DataFrame(out, columns=["symbol", "bar_idx", "state", "entry", "stop", "target"])

    return rows_.select(*need).groupBy("symbol").applyInPandas(run, "symbol string, bar_idx int, state string, entry double, stop double, target double")


def with_resistance(bars: DataFrame, k: int = 2, width_atr: float = 0.35) -> DataFrame:
    """``indicators`` with the latest confirmed high pivot's zone at each bar, carried on by a window."""
    made = indicators(bars)
    p = fractals(bars, k).where("kind = 1").select("symbol", F.col("confirm_idx").alias("bar_idx"), F.col("price").alias("_p"))
    j = made.join(p, ["symbol", "bar_idx"], "left")
    known = F.last("_p", ignorenulls=True).over(S().rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("_z", known)
    return j.withColumns({"zone_lo": F.col("_z") - width_atr * F.col("atr14"), "zone_hi": F.col("_z") + width_atr * F.col("atr14"), "regime": regime()}).drop("_p", "_z")


def fuse(results: DataFrame, roles: DataFrame, damping: float = 0.45) -> DataFrame:
    """Timeframe scores (symbol, timeframe, score) by weighted roles (timeframe, role, weight): strengths up and down, conflict, coverage."""
    total = roles.agg(F.sum("weight").alias("all"))
    j = results.join(F.broadcast(roles), "timeframe").crossJoin(F.broadcast(total))
    up, down = F.sum(F.when(F.col("score") > 0, F.col("weight") * F.col("score")).otherwise(0.0)), F.sum(F.when(F.col("score") < 0, -F.col("weight") * F.col("score")).otherwise(0.0))
    a = j.groupBy("symbol").agg(up.alias("up"), down.alias("down"), (F.sum("weight") / F.first("all")).alias("coverage"))
    return a.withColumn("conflict", F.least("up", "down") / F.greatest(F.greatest("up", "down"), F.lit(1e-9))).withColumn("score", (F.col("up") - F.col("down")) * (1 - damping * F.col("conflict")))


def nearest(rows: DataFrame, key: str, by: str, x: str, levels: DataFrame, price: str, name: str) -> DataFrame:
    """(key, level): the level of the same ``by`` nearest to ``x``, the smaller name of equals; rows without a level go.

    Both sides are sorted together by price; the nearest level is the last one below or the first one above, so the cost is that of a
    sort and not of the pairs.
    """
    distinct = levels.groupBy(F.col(by).alias("_by"), F.col(price).cast("double").alias("_x")).agg(F.min(name).alias("_name"))
    both = distinct.withColumn("_at", F.struct("_x", "_name")).withColumn("_key", F.lit(None).cast(dict(rows.dtypes)[key])).drop("_name").withColumn("_row", F.lit(False))
    mine = rows.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x"), F.lit(None).cast(both.schema["_at"].dataType).alias("_at"), F.col(key).alias("_key"), F.lit(True).alias("_row"))
    w = Window.partitionBy("_by").orderBy("_x")
    below, above = w.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("_by").orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
    near = both.unionByName(mine).withColumns({"_lo": F.last("_at", ignorenulls=True).over(below), "_hi": F.last("_at", ignorenulls=True).over(above)}).where("_row")
    by_distance = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["_x"] - F.col("_x")).alias("d"), F.col(c)["_name"].alias("n")))
    return near.select(F.col("_key").alias(key), F.least(by_distance("_lo"), by_distance("_hi"))["n"].alias("level")).where("level is not null")

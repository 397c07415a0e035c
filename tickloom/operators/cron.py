"""Next fire times of five-field cron schedules, in column expressions.

Each field is a bit mask. The search carries from minutes to hours to days to months: the next
minute of the cutoff's day by masks of what lies behind it, else the first minute of the next day
that fits. Days of a month are one mask, too: weekdays are their seven bits, turned by the weekday
of the month's first day and repeated five times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and greatest value of minute, hour, day of the month, month and day of the week.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "day_of_week": (0, 7)}
#: Days that are looked at from the cutoff's day on.
HORIZON = 366 * 8


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def _one() -> Column:
    return F.lit(1).cast("long")


def mask(field: Column, least: int, most: int) -> Column:
    """Bits of a field's values (``*``, values, ranges, steps and lists of them); null where it is invalid."""

    def part(p: Column) -> Column:
        p = F.trim(p)
        base, step = F.substring_index(p, "/", 1), F.when(p.contains("/"), F.regexp_extract(p, r"^[^/]*/(\d+)$", 1).try_cast("int")).otherwise(1)
        lo = F.when(base == "*", least).otherwise(F.regexp_extract(base, r"^(\d+)(-\d+)?$", 1).try_cast("int"))
        hi = F.when(base == "*", most).when(base.contains("-"), F.regexp_extract(base, r"-(\d+)$", 1).try_cast("int")).otherwise(lo)
        fits = (step >= 1) & (lo >= least) & (hi <= most) & (lo <= hi)
        # of a field's few values, those that the part names
        bits = lambda v: F.when((v >= lo) & (v <= hi) & ((v - lo) % step == 0), _shift(_one(), v)).otherwise(F.lit(0).cast("long"))
        every = F.sequence(F.lit(least), F.lit(most))
        return F.when(fits, F.aggregate(every, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(bits(v))))

    return F.aggregate(F.transform(F.split(field, ","), part), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def lowest(bits: Column) -> Column:
    """Place of the lowest bit; null without one."""
    own = bits.bitwiseAND(-bits)
    return F.when(bits != 0, F.bit_count(own - 1))


def _from(bits: Column, place: Column) -> Column:
    """The bits at ``place`` and above it."""
    return bits.bitwiseAND(F.bitwise_not(_shift(_one(), place) - 1))


def next_fires(df: DataFrame, minute: Column, hour: Column, day: Column, month: Column, day_of_week: Column, now: Column, previous: Column | None = None, timezone: str | None = None, name: str = "next_fire") -> DataFrame:
    """``df`` with the first fire time behind ``now`` and the previous one; null for an invalid field or where ``HORIZON`` days hold none.

    Times are those of ``timezone`` where it is given. Where both day fields are restricted either suffices.
    """
    cutoff = F.greatest(now, previous) if previous is not None else now
    local = F.from_utc_timestamp(cutoff, timezone) if timezone else cutoff
    masks = {f"_{k}": mask(c, *FIELDS[k]) for k, c in zip(FIELDS, (minute, hour, day, month, day_of_week), strict=True)}
    # every step is a column, so that none is written out again in the next one
    step = df.withColumns(masks | {"_local": local, "_any_day": F.trim(day) == "*", "_any_weekday": F.trim(day_of_week) == "*"})
    m, h, d, mon, w = (F.col(k) for k in masks)
    week = w.bitwiseOR(F.call_function("shiftright", w, F.lit(7))).bitwiseAND(F.lit(127))  # 7 is 0: Sunday
    step = step.withColumns({"_week": week.bitwiseOR(_shift(week, F.lit(7))), "_today": F.to_date("_local"), "_first": F.trunc("_local", "month").cast("date")})
    today, first = F.col("_today"), F.col("_first")

    def fitting(start: Column) -> Column:
        """Mask of a month's days that fit; bit 1 is its first day."""
        turned = F.call_function("shiftright", F.col("_week"), (F.dayofweek(start) - 1).cast("int")).bitwiseAND(F.lit(127))
        weekdays = _shift(turned * F.lit(sum(1 << 7 * k for k in range(5))).cast("long"), F.lit(1))
        days = F.when(F.col("_any_day"), weekdays).when(F.col("_any_weekday"), d).otherwise(d.bitwiseOR(weekdays))
        held = _shift(_one(), F.dayofmonth(F.last_day(start)) + 1) - 2
        return F.when(mon.bitwiseAND(_shift(_one(), F.month(start))) != 0, days.bitwiseAND(held)).otherwise(F.lit(0).cast("long"))

    months = F.transform(F.sequence(F.lit(0), F.lit(HORIZON // 30)), lambda k: F.add_months(first, k))
    step = step.withColumn("_months", F.transform(months, lambda s: F.struct(s.alias("start"), fitting(s).alias("days"))))
    now_h, now_m = F.hour("_local"), F.minute("_local")
    this = F.get("_months", F.lit(0))["days"]
    # the cutoff's day: a later minute of its hour, or the first one of a later hour; else the next day that fits
    step = step.withColumns({
        "_later": lowest(_from(m, now_m + 1)), "_hours": lowest(_from(h, now_h + 1)), "_same": h.bitwiseAND(_shift(_one(), now_h)) != 0, "_fits": this.bitwiseAND(_shift(_one(), F.dayofmonth(today))) != 0,
        "_rest": F.concat(F.array(F.struct(first.alias("start"), _from(this, F.dayofmonth(today) + 1).alias("days"))), F.slice("_months", 2, HORIZON // 30)),
        "_start": lowest(h) * 60 + lowest(m),
    })
    step = step.withColumns({
        "_at_today": F.when(F.col("_fits"), F.when(F.col("_same") & F.col("_later").isNotNull(), now_h * 60 + F.col("_later")).otherwise(F.col("_hours") * 60 + lowest(m))),
        "_next": F.get(F.filter("_rest", lambda x: x["days"] != 0), F.lit(0)),
    })
    next_day = F.date_add(F.col("_next")["start"], lowest(F.col("_next")["days"]) - 1)
    seconds = lambda at: F.unix_timestamp(at.cast("timestamp"))
    found = F.timestamp_seconds(F.when(F.col("_at_today").isNotNull(), seconds(today) + F.col("_at_today") * 60).when(F.datediff(next_day, today) < HORIZON, seconds(next_day) + F.col("_start") * 60))
    return step.select(*df.columns, (F.to_utc_timestamp(found, timezone) if timezone else found).alias(name))

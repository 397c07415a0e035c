"""Levels of task graphs, fire times of schedules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import cron
from tickloom.operators import schedule as G


def test_levels_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(104)] + [(0, 104), (50, 90), (200, 3)]
    got = {r.node: r.level for r in G.levels(spark, spark.createDataFrame(edges, "before long, after long")).collect()}
    assert got == {**{i: i for i in range(105)}, 200: 0}


def test_a_cycle_is_told(spark):
    with pytest.raises(ValueError, match="cycle"):
        G.levels(spark, spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "before long, after long"))


def test_next_fires_by_looking_at_every_minute(spark):
    """Random fields against a plain search; invalid fields have no next fire."""
    rng = random.Random(5)
    pick = lambda lo, hi: rng.choice(["*", "*", str(rng.randint(lo, hi)), f"{lo}-{rng.randint(lo, hi)}", f"*/{rng.randint(1, hi)}", f"{rng.randint(lo, hi)},{rng.randint(lo, hi)}"])
    rows = []
    for i in range(150):
        now = datetime(2023, 1, 1) + timedelta(minutes=rng.randrange(900_000), seconds=rng.randrange(60))
        rows.append((i, pick(0, 59), pick(0, 23), pick(1, 28), pick(1, 12), pick(0, 7), now, rng.choice([None, now + timedelta(hours=rng.randrange(-50, 900))])))
    bad = ["60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "*/0 * * * *", "5-2 * * * *", "a * * * *", "1,,2 * * * *", "*/x * * * *"]
    rows += [(1000 + i, *b.split(" "), datetime(2024, 1, 1), None) for i, b in enumerate(bad)] + [(2000, "0", "0", "30", "2", "*", datetime(2024, 1, 1), None), (2001, "0", "0", "29", "2", "*", datetime(2025, 1, 1, 0, 1), None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string, d string, e string, now timestamp, previous timestamp")
    got = {r.i: r.next_fire for r in cron.next_fires(df, *map(F.col, "abcde"), F.col("now"), F.col("previous")).collect()}

    def values(field, lo, hi):
        out = set()
        for p in field.split(","):
            base, _, step = p.partition("/")
            first, last = (lo, hi) if base == "*" else (int(base.split("-")[0]), int(base.split("-")[-1]))
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    for i, a, b, c, d, e, now, previous in rows[:150]:
        m, h, dom, mon, dow = values(a, 0, 59), values(b, 0, 23), values(c, 1, 31), values(d, 1, 12), {x % 7 for x in values(e, 0, 7)}
        cutoff, want = max(now, previous or now), None
        for k in range(366 * 8):
            day = cutoff.date() + timedelta(days=k)
            by_day, by_week = day.day in dom, (day.weekday() + 1) % 7 in dow
            fits = by_week if c == "*" and e != "*" else by_day if e == "*" else by_day or by_week
            if day.month in mon and (fits or c == e == "*"):
                want = min((t for x in h for y in m if (t := datetime(day.year, day.month, day.day, x, y)) > cutoff), default=None)
                if want:
                    break
        assert got[i] == want, (a, b, c, d, e, cutoff)
    assert all(got[1000 + i] is None for i in range(len(bad))) and got[2000] is None and got[2001] == datetime(2028, 2, 29)
    at = cron.next_fires(spark.sql("select timestamp '2024-07-01 00:00:00' as now"), *map(F.lit, ("30", "9", "*", "*", "1-5")), F.col("now"), timezone="Asia/Shanghai").first()
    assert at.next_fire == datetime(2024, 7, 1, 1, 30)

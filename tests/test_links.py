"""Links by shared themes and band joins against plain loops, and what their plans shuffle."""

import random

from pyspark.sql import functions as F

from tickloom.operators import discovery as D
from tickloom.operators import levels as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_by_lists_and_themes(spark, monkeypatch):
    """Doubles, nulls and several shared themes give each pair once, and no aggregate holds the pairs."""
    monkeypatch.setattr(D, "SHARE", 7)
    rng = random.Random(5)
    some = lambda n, k: rng.choice([None, [rng.choice([None, *range(n)]) for _ in range(rng.randint(0, k))]])
    stocks = [(i // 2 if i < 10 else i, some(4, 3), some(60, 2)) for i in range(60)]
    events = [(i, some(5, 3), some(70, 2)) for i in range(50)]
    hit = lambda a, b: any(x is not None and x in (b or []) for x in a or [])
    want = {(s[0], e[0]) for s in stocks for e in events if hit(s[1], e[1]) or hit([e[0]], s[2]) or hit([s[0]], e[2])}
    s = spark.createDataFrame(stocks, "stock_id long, theme_ids array<int>, event_ids array<long>")
    e = spark.createDataFrame(events, "event_id long, theme_ids array<int>, stock_ids array<long>")
    links = D.linked_events(s, e)
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert plan(links).startswith("Union")


def test_bands_meet_within_equal_keys(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 1, 2]), rng.uniform(-9, 40)) for i in range(80)]
    a, b = (spark.createDataFrame(rows, f"{c} int, s{c} int, p{c} double") for c in "ab")
    near = Q.near(a, b, "pa", "pb", F.lit(2.0), 2.0, ("sa", "sb"))
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] is not None and x[1] == y[1] and abs(x[2] - y[2]) <= 2}
    got = [(r.a, r.b) for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert Q.near(a, b, "pa", "pb", F.lit(2.0), 2.0).count() == sum(abs(x[2] - y[2]) <= 2 for x in rows for y in rows)


def test_few_bytes_of_much_work_are_dealt(spark, sf):
    from tickloom.plans import action_queries as A

    assert A.cron_next_fire(spark, sf).rdd.getNumPartitions() >= 64


def test_python_gets_what_lies_between_braces(spark):
    """Before, whole texts went to Python."""
    from tickloom.functions import objects as J

    df = spark.createDataFrame([("x" * 50 + '} {"a": {"b": 1}} }' + "y" * 50,), ("{ open",), ("shut }",), (None,), ("",)], "t string")
    out = df.select(J.first_object("t").alias("o"))
    assert [r.o for r in out.collect()] == ['{"a": {"b": 1}}', None, None, None, None] and "reverse(t" in plan(out)

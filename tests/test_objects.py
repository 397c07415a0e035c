"""JSON objects in texts and probabilities in them."""

from pyspark.sql import functions as F

from tickloom.functions import objects as J


def test_first_object(spark):
    want = [
        (None, None), ("", None), ("} {", None), ('a {x} {"b": {"c": "}"}} {"d": 1}', '{"b": {"c": "}"}}'), ('{"a": [1, {"b": 2}', '{"b": 2}'), ('["{}"]', "{}"),
        ('{"a":' * 100_000, None), ('{"a":' * 100_000 + "{}", "{}"), ("{" * 300_000, None), ("x" * 1_000_000 + "{}", "{}"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "i int, t string")
    got = {r.i: r.o for r in df.select("i", J.first_object("t").alias("o")).collect()}
    assert [got[i] for i in range(len(want))] == [o for _, o in want]


def test_probabilities(spark):
    cases = [
        ('{"up": 0.6, "down": 0.4}', {"up": 60.0, "down": 40.0}), ('{"up": 0.6, "down": 0.6}', {"up": 0.6, "down": 0.6}), ('{"up": 60, "flat": "35 %", "x": true, "y": null, "z": {}, "w": "1d"}', {"up": 60.0, "flat": 35.0}),
        ('[{"name": "a", "prob": "high"}, {"title": " ", "case": "b", "p": 5}, {"chance": 7}, 8, "x", {"name": true, "p": 9}, {"name": "n", "probability": "?", "p": 3}]', {"a": 80.0, "b": 5.0, "情景 3": 7.0, "情景 4": 8.0, "情景 6": 9.0}),
        ('[{"name": "a", "p": 5}, {"name": "b", "p": 6}, {"name": "a", "p": 7.126}]', {"a": 7.13, "b": 6.0}), ("5", {}), ('"x"', {}), ("[]", {}), ("{}", {}), (None, {}), ("null", {}), ('{"a": 0}', {"a": 0.0}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", J.probabilities(F.try_parse_json("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [p for _, p in cases]

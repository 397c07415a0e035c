"""Events of clusters against a plain reading of the joined texts, and leads of named symbols."""

import random
import re
from datetime import datetime, timedelta

from tickloom.operators import clustered as C

ITEM = "cluster string, id long, title string, content string, source string, url string, publish_time timestamp, event_time timestamp"
AT = datetime(2024, 1, 1)


def test_terms_of_all_items_count_once(spark):
    """More terms than one word has bits, over random texts."""
    rng = random.Random(3)
    terms = [f"q{k}z" for k in range(150)]
    rules = C.Rules({"POLICY": terms[:60], "RISK": terms[60:130]}, {"last": terms[130:]}, good=terms[60:65], bad=terms[125:128], capital=terms[128:132])
    rows = [(f"c{i % 9}", i, " ".join(rng.sample(terms, 2)), " ".join(t.upper() for t in rng.sample(terms, rng.randint(0, 4))), "s", str(i % 4), AT + timedelta(hours=i), None) for i in range(60)]
    got = {r.cluster: r for r in C.cluster_events(spark.createDataFrame(rows, ITEM), rules).collect()}
    for c in {r[0] for r in rows}:
        text = "\n".join(f"{r[2]}\n{r[3]}" for r in rows if r[0] == c).lower()
        n = {k: sum(w in text for w in words) for k, words in rules.kinds.items()}
        best = max(n, key=lambda k: (n[k] > 0) * (n[k] * 10 + C.EVENT_TYPES[k][0]))
        r = got[c]
        assert (r.event_type, r.hits) == (best, n[best])
        assert r.themes == (["last"] if any(w in text for w in terms[130:]) else [])
        good, bad = (sum(w in text for w in x) for x in (rules.good, rules.bad))
        assert r.direction == ("NEUTRAL" if not good + bad else "MIXED" if good and bad else "POSITIVE" if good else "NEGATIVE")
        assert r.capital == sum(w in text for w in rules.capital) * 18


def test_ties_nulls_and_codes(spark):
    rows = [
        ("a", 2, "later", "same sign", "s", "u", AT, None), ("a", 1, "first", "same sign", "s", "u", AT, AT - timedelta(days=1)),
        ("b", 1, None, None, None, None, AT, None), ("c", 1, "", "x 600001, 300002 1600003 600001 000004", "s", None, AT, None), ("c", 2, "300002 800005", "", "s", "v", AT, None), ("d", 1, "汉字", "y" * 400, "s", "u", AT, None),
    ]
    got = {r.cluster: r for r in C.cluster_events(spark.createDataFrame(rows, ITEM), C.Rules({"RISK": ["nothing"]})).collect()}
    assert got["a"].title == "first" and got["a"].event_time == AT - timedelta(days=1) and got["a"].sources == 1
    assert (got["b"].title, got["b"].summary, got["b"].event_type, got["b"].codes, got["b"].direction, got["b"].sources) == ("", "", "OTHER", [], "NEUTRAL", 1)
    assert got["c"].codes == re.findall(r"\d+", "600001 300002 000004 800005") and got["c"].title.startswith("x 600001")
    assert got["d"].cjk and not got["c"].cjk and got["d"].summary == "y" * 360 + "..."
    assert C.cluster_events(spark.createDataFrame([], ITEM), C.Rules({})).collect() == []


def test_numbers_of_documents_are_no_shares(spark, tmp_path):
    """A document's own six digits were codes of its cluster's event, which they aren't in the SQL."""
    from tickloom.plans import news_queries as Q

    spark.createDataFrame([(0, "call 600999 now", "s"), (1, "id 000004 here", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    r = Q.cluster_events(spark, str(tmp_path)).first()
    assert (r.codes, r.capital, r.n_items) == ("600000", 4.0, 2)


def test_leads(spark):
    """A symbol named twice counts twice; themes without heat and null symbols don't; a negative event is told."""
    e = spark.createDataFrame([(["1", "1", None], ["t", "t", "x"], "positive", 100.0, 100.0), (["1", "2"], ["x"], "NEGATIVE", 50.0, 100.0), (["3"], [], None, 0.0, 0.0), ([], ["t"], "MIXED", 9.0, 9.0)], "symbols array<string>, theme_ids array<string>, direction string, importance double, magnitude double")
    t = spark.createDataFrame([("t", "Tea", 80.0), ("u", "", 10.0)], "theme_id string, name string, heat double")
    got = {r.symbol: r for r in C.symbol_leads(e, t).collect()}
    assert set(got) == {"1", "3"}
    r = got["1"]
    assert (r.n_events, round(r.event_score, 9), r.theme_heat, r.labels, r.review) == (3, round((90 + 90 + 25) / 3, 9), 80.0, ["Tea", "x"], True)
    assert abs(r.score - ((205 / 3) * 0.6 + 65 * 0.4)) < 1e-9
    assert (got["3"].score, got["3"].theme_heat, got["3"].labels, got["3"].review) == (50.0, 50.0, [], False)

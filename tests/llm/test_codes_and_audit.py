"""Vector codes against full comparison, the filter audit against a plain loop; their defined cases."""

import glob
import hashlib
import os
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tickloom.llm import filter_audit as A
from tickloom.llm import vector_codes as V
from tickloom.llm.queries import WITH_SQL, oracle_sql, queries


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    r = con.execute(oracle_sql()[name])
    names = [x[0] for x in r.description]
    want = sorted(tuple(x[names.index(c)] for c in columns) for x in r.fetchall())
    assert sorted(names) == columns and sorted(tuple(r[c] for c in columns) for r in df.collect()) == want and want


def plain_codes(vectors, parts, entries, rounds):
    """Every part with every entry."""
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors], dtype=object).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = [[[sum((x[i, p] - e) ** 2) for e in books[p]] for p in range(parts)] for i in range(len(x))]
        code = np.array([[min(range(len(q)), key=q.__getitem__) for q in row] for row in d])
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [x[i, p] for i in range(len(x)) if code[i, p] == e]
                    if own:
                        books[p, e] = [int(sum(c)) // len(own) for c in zip(*own, strict=True)]
    return books, code, [int(sum(d[i][p][code[i, p]] for p in range(parts))) for i in range(len(x))]


def test_codes_are_those_of_a_full_comparison(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        scale = rng.choice([0.01, 1.0, 300.0])
        rows.append((100 - i, [rng.choice([0.0, rng.gauss(0, scale)]) for _ in range(12)], rng.choice([None, 1, 2])))
    nan, inf = float("nan"), float("inf")
    dropped = [(-1, None, 1), (-2, [1.0] * 11 + [None], 1), (-3, [nan] + [0.0] * 11, 2), (-4, [inf] * 12, None), (-5, [-inf] * 12, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows + dropped], "vec_id long, embedding array<float>, label int, id string")
    made = {r.vec_id: r for r in V.compress(df, parts=4, entries=8).collect()}
    order = sorted(rows)
    books, code, error = plain_codes([r[1] for r in order], 4, 8, 2)
    assert set(made) == {r[0] for r in rows}
    for r, c, e in zip(order, code, error, strict=True):
        assert (made[r[0]].code, made[r[0]].error) == ("".join(f"{x:02x}" for x in c), e)
        assert made[r[0]].label_error == sum(f for q, f in zip(order, error, strict=True) if q[2] == r[2])
        assert made[r[0]].codebooks_sha256 == hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()


def test_bounds_hold_and_spare_most_entries():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-80, 80, (64, 4)), rng.integers(-100, 100, (500, 4))
    cells = V.Cells(entries)
    true = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    may = cells.candidates(x)
    best, d = cells.nearest(x)
    assert (best == true.argmin(axis=1)).all() and (d == true.min(axis=1)).all()
    assert may[np.arange(500), best].all() and may.mean() < 0.25


def test_codes_of_few_repeated_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    for rows in ([], [(1, None, "a")]):
        made = V.compress(spark.createDataFrame(rows, schema))
        assert made.count() == 0 and made.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    two = [(None, [0.5] * 16, "a"), (1, [0.25] * 16, None), (1, [0.25] * 16, None)]
    made = sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in V.compress(spark.createDataFrame(two, schema)).collect())
    assert made == [(0, "02" * 16, 0, 0), (1, "00" * 16, 0, 0), (1, "00" * 16, 0, 0)]
    assert [(r.code, r.error) for r in V.compress(spark.createDataFrame([(7, [], "a")], schema)).collect()] == [("00" * 16, 0)]
    with pytest.raises(Exception, match="one length"):
        V.compress(spark.createDataFrame([(1, [0.0] * 16, ""), (2, [0.0] * 32, "")], schema)).collect()


def plain_audit(docs, labels):
    out, masks, first = {}, [], {}
    for i, text, part in docs:
        t, w = text or "", [x for x in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        if i is not None:
            first[t] = min(first.get(t, i), i)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t)]
        masks.append((part or "", {x for x, b in zip("ABCD", bad, strict=True) if b}, i, t))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, q in labels if q == 1 and i is not None}
    for order in permutations("ABCDE"):
        for part, fails, i, t in masks:
            fails = fails | ({"E"} if i is not None and first[t] < i else set())
            gone = False
            for k, x in enumerate(order, 1):
                row = out.setdefault((part, "".join(order), k), [0] * 7)
                row[0] += not gone and x not in fails
                row[1] += not gone and x in fails
                row[2] += gone and x in fails
                row[3] += fails == {x}
                row[4] += not gone and x in fails and i in good
                row[5] += not gone and x in fails and i in toxic
                gone = gone or x in fails
    for (part, order, k), row in out.items():
        row[6] = sum(r[1] for (p, o, j), r in out.items() if p == part and o[j - 1] == order[k - 1])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_is_a_plain_loop(spark):
    rng = random.Random(8)
    docs = []
    for i in range(90):
        n = rng.choice([0, 3, 199, 200, 260, 400])
        words = [rng.choice(["Ab", "c", "dé"]) if rng.random() < 0.3 else f"w{rng.randrange(rng.choice([50, 500]))}" for _ in range(n)]
        docs.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(words) + rng.choice(["", "", "#", "|"]), rng.choice(["a", "b", None, ""])))
    docs += [(100 + i, docs[i % 7][1], "a") for i in range(30)] + [docs[3], docs[3], (None, docs[0][1], "b"), (300, None, None), (301, None, "c"), (302, "", "c"), (303, "AAAA " * 300_00, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(140)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, source string, mask int, digest string")
    made = A.interactions(A.failure_masks(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in made} == plain_audit(docs, labels)
    assert len(made) == 600 * len({d[2] or "" for d in docs})
    assert A.interactions(A.failure_masks(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0

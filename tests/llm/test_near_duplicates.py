"""Line de-duplication and the Jaccard join against brute force; their defined cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import jaccard as J
from tickloom.llm import lines as L
from tickloom.llm import linking as K
from tickloom.llm import minhash as M


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1))
        before = now
    return before[-1]


def changed(s, n, signs, rng):
    b = list(s)
    for _ in range(n):
        p, r = rng.randrange(len(b) + 1), rng.random()
        if r < 0.35:
            b.insert(p, rng.choice(signs))
        elif p < len(b):
            b[p : p + 1] = [] if r < 0.7 else [rng.choice(signs)]
    return "".join(b)


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 30)))
        pairs.append((a, changed(a, rng.randint(0, 4), "abé", rng)))
    df = spark.createDataFrame(pairs, "a string, b string").select(L.within(F.col("a"), F.col("b"), 2).alias("w"), (F.levenshtein("a", "b") <= 2).alias("d"))
    assert df.where("w != d").count() == 0


def kept_lines(rows):
    at = sorted(((d, i), line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if line.strip())
    first: dict = {}
    for place, line in at:
        first.setdefault(line, place)
    near, seen = set(), []
    for line, _ in sorted(first.items(), key=lambda x: x[1]):
        if len(line) >= L.LEAST:
            if any(edits(line, o, 2) <= 2 for o in seen):
                near.add(line)
            seen.append(line)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if not x.strip() or (x not in near and first[x] == (d, i))) for d, t in rows}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_line_dedup_is_brute_force(spark, monkeypatch, hot):
    """Also where no line is so frequent that it goes to all executors (``hot`` = 1)."""
    monkeypatch.setattr(L, "HOT", hot)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([18, 20, 21, 25, 40]))) for _ in range(30)]
    rows = [(i, "\n".join(changed(rng.choice(base), rng.randint(0, 3), "abcdefgh", rng) for _ in range(rng.randint(0, 4)))) for i in range(150)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "x\nx\n \nx"), (404, "y" * 1500), (405, "y" * 1501)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r.text or "" for r in L.dedup_lines(df).collect()}
    assert got == kept_lines(rows)


def test_lines_by_a_moved_segment_and_of_many_signs(spark):
    # the middle segment of the first line stands one place before it as well; the second line shares no other one
    moved = [(1, "bcdefga" + "aaaaaaa" + "hijklmn"), (2, "bcXdefga" + "aaaaaaa" + "hijkZmn")]
    assert edits(moved[0][1], moved[1][1], 2) == 2
    long = [(3, "e" * 40_000 + "once more"), (4, "e" * 40_000 + "once Xmore"), (5, "e" * 40_003 + "once more")]
    for rows, want in ((moved, {1: moved[0][1], 2: ""}), (long, {3: long[0][1], 4: "", 5: long[2][1]})):
        assert {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_lines_of_empty_and_repeated_rows(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "one line that is long enough"), (1, "one line that is long enough"), (None, "first of all, this long line"), (2, "first of all, this long line")]
    made = L.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in made.collect()) == [(0, rows[2][1]), (1, rows[0][1]), (1, rows[0][1])]


def classes(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[b, a] += 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    words, rows, i = [f"w{k}" for k in range(300)], [], 0
    for size in [*range(1, 45), 60, 90, 120, 200, 400]:
        for _ in range(2):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(4):
                t = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    t[rng.randrange(len(t))] = rng.choice(words)
                rows.append((i, " ".join(t)))
                i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "a"), (i + 4, "A"), (i + 5, "a a a a a a a a a"), (i + 6, "ab " * 30_000)]
    rng.shuffle(rows)
    return rows


def test_jaccard_is_brute_force(spark, sf):
    rows = near_copies(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")).collect()}
    assert got == classes(rows)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.op7_ngram_jaccard(spark, sf).collect()} == classes(docs)


def test_prefixes_hold_every_link(spark, sf):
    """Sets that fill too few segments are paired by prefixes: taken for all sets, these give every link."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, rows, heads = J.nodes(docs, "doc_id", "text", 75)
    short = heads.where("n > 1").select("node", "n")
    kind = K.Kind(texts, heads, K.PARITY_WORDS, 75, K.parities_allow(75))
    edges = K.verified(K.sketched(J._by_prefix(texts, heads, short, 75), kind), kind)
    got = {frozenset((r.a, r.b)) for r in edges.collect()}
    ids = {r.node: r["head"] for r in heads.collect()}
    text = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    sets = {n: {tuple(text[i][k : k + 5]) for k in range(max(1, len(text[i]) - 4))} for n, i in ids.items()}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= 75 * len(sets[a] | sets[b])}
    assert got == want and want


def test_jaccard_of_nothing(spark):
    assert J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 3, 25, 26, 33, 90, 113, 152, 500, 5000])
def test_weights_suffice(n):
    """Segments that a set fills are more than what linked sets may differ by."""
    import numpy as np

    tokens = np.sort(J.mix(np.arange(n, dtype=np.uint64)))
    for band, _, spare in J.signatures(tokens):
        assert spare >= 0, band


@pytest.mark.parametrize("paired", [0, 8])
def test_minhash_is_brute_force(spark, sf, paired, monkeypatch):
    """Also where groups meet single members before they are paired."""
    monkeypatch.setattr(K, "PAIRED", paired)
    rows = near_copies(6)
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, node int, kept boolean")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.minhash_classes(docs).collect()}
    assert got == classes(rows, 85)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made = M.op13_minhash(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made} == classes(docs, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in made) and {r.kept for r in made} == {True, False}


def test_minhash_defined_cases(spark):
    assert M.minhash_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (None, text), (3, text), (1, None), (2, ""), (4, text.upper()), (None, "alone")]
    made = sorted(tuple(r) for r in M.minhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).fillna(-1).collect())
    assert made == [(-1, 1, -1, True), (-1, 56, 3, False), (1, 0, 1, True), (2, 0, 2, True), (3, 56, 3, True), (3, 56, 3, True), (4, 56, 3, False)]


def test_packed_minima_estimate_the_similarity(spark):
    """Words packed by numpy, counted and corrected by Spark, against true similarities; and against plain counts."""
    import numpy as np

    rng = np.random.default_rng(4)
    sets, truth = [], []
    for share in (0, 20, 50, 75, 85, 95, 100) * 8:
        both, a, b = (J.mix(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (share * 4, (100 - share) * 2, (100 - share) * 2))
        sets.append((np.concatenate([both, a]), np.concatenate([both, b])))
        truth.append(share / 100)
    left, right = (M.minima([p[i] for p in sets]) for i in (0, 1))
    words = [(i, *map(int, p), *map(int, q)) for i, (p, q) in enumerate(zip(M.packed(left), M.packed(right), strict=True))]
    columns = ["i", *[f"p{w}" for w in M._WORDS], *[f"q{w}" for w in M._WORDS]]
    found = spark.createDataFrame(words, ", ".join(f"{c} long" for c in columns)).select("i", M.equal_values("p", "q").alias("n"), M.similarity("p", "q").alias("s")).collect()
    low = lambda x: J.mix(x.astype(np.uint64), 31) & np.uint64(2**M.LOW - 1)
    for r in found:
        assert r.n == int((low(left[r.i]) == low(right[r.i])).sum())
        assert abs(r.s - truth[r.i]) < 0.2 and (truth[r.i] < 1 or r.s == 1)
    errors = np.array([r.s - truth[r.i] for r in found])
    assert abs(errors.mean()) < 0.02 and errors.std() < 0.06
    # the least of a large set is that of its shingles, however they are blocked
    big = J.mix(np.arange(100_000, dtype=np.uint64))
    assert (M.minima([big[:7], big, big[:3]])[1] == M.minima([big[::-1].copy()])[0]).all()

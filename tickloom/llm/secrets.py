"""Operator 3: secret scan by sliding-window entropy.

Three fixed rules give the base spans (assignments, access keys, hex runs). The
entropy method adds spans: runs of base64-like characters are candidate strings;
a window slides over each, and its Shannon entropy comes from counts that change
by one character in and one out per step. A window is hot where its entropy
reaches the threshold of its character class (the narrowest of: hex, letters and
digits, any) and it holds a letter and a digit; hot windows that touch make one
span. Candidates that hold a string of the allow-list are suppressed; base spans
never are.

DataFrame functions only, row by row: no shuffle, no Python, and whole texts.

Defined results: null text is empty and has no spans; offsets are code points,
end exclusive; rows repeated stay; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import let

#: The base rules as (kind, pattern, group, least length of the group).
#: Runs of one class are maximal, so a least length inside the pattern finds the same runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character, by class, of a window of 20 (at most 4.32).
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "any": 3.8}
ALLOW = ("example", "placeholder", "changeme", "xxxxxxxx", "0123456789", "abcdefghij", "lorem", "dummy", "test-", "sample")
SPAN = "struct<kind:string,rank:int,start:int,end:int>"


def found(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start,end,n>> of a pattern's matches, leftmost and not overlapping; n is the group's length."""
    pieces, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(F.transform(pieces, lambda p: F.length(p)).alias("gap"), F.transform(whole, lambda p: F.length(p)).alias("all"), F.transform(part, lambda p: F.length(p)).alias("n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,n:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        return F.struct((a + x["all"]).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + x["all"]).alias("end"), x["n"].alias("n")))).alias("out"))

    # the piece behind the last match has no match of its own
    return F.aggregate(F.filter(sizes, lambda x: x["all"].isNotNull()), start, step, lambda acc: acc["out"])


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(found(text, pattern, group), lambda m: m["n"] >= least)
    made = F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(f"array<{SPAN}>"))


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def hot_runs(candidate: Column, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> Column:
    """array<struct<start,end>> of hot windows of one candidate string, joined where they touch.

    The state is a count per character and per class and the sum of n log2 n; each
    step changes the counts of one character in and one out. Entropy of the window
    is log2(window) - sum / window.
    """
    limit = thresholds or THRESHOLDS
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    is_digit = lambda c: (c >= 52) & (c < 62)
    is_hex = lambda c: ((c >= 26) & (c < 32)) | is_digit(c)
    one = lambda b: F.when(b, 1).otherwise(0)

    def slide(code: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("digits"), F.lit(0).alias("hexes"), F.lit(0).alias("signs"),
            F.array().cast("array<struct<start:int,end:int>>").alias("out"),
        )

        def step(acc: Column, come: Column) -> Column:
            full = acc["i"] >= window
            gone = F.when(full, F.get(code, acc["i"] - window)).otherwise(-1)
            n_in, n_out = F.get(acc["n"], come), F.when(full, F.get(acc["n"], gone)).otherwise(0)
            s = F.when(come == gone, acc["s"]).otherwise(acc["s"] + _weight(n_in + 1) - _weight(n_in) + _weight(n_out - 1) - _weight(n_out))
            counts = F.when(come == gone, acc["n"]).otherwise(F.transform(acc["n"], lambda v, k: v + one(k == come) - one(k == gone)))
            digits = acc["digits"] + one(is_digit(come)) - one(full & is_digit(gone))
            hexes = acc["hexes"] + one(is_hex(come)) - one(full & is_hex(gone))
            signs = acc["signs"] + one(come >= 62) - one(full & (gone >= 62))
            least = F.when(hexes == window, limit["hex"]).when(signs == 0, limit["alnum"]).otherwise(limit["any"])
            end, start = acc["i"] + 1, acc["i"] + 1 - window
            hot = (end >= window) & (digits > 0) & (digits + signs < window) & (F.log2(F.lit(float(window))) - s / window >= least)
            last = F.element_at(F.when(F.size(acc["out"]) > 0, acc["out"]), -1)
            touch = F.coalesce(last["end"] >= start, F.lit(False))
            own = F.array(F.struct(F.when(touch, last["start"]).otherwise(start).alias("start"), end.alias("end")))
            before = F.when(touch, F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(acc["out"])
            return F.struct(counts.alias("n"), s.alias("s"), end.alias("i"), digits.alias("digits"), hexes.alias("hexes"), signs.alias("signs"), F.when(hot, F.concat(before, own)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(code, zero, step, lambda acc: acc["out"])

    return let(codes, slide)


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    rule = ("(?i)(" + "|".join(allow) + ")") if allow else None

    def of(m: Column) -> Column:
        candidate = F.substring(text, m["start"] + 1, m["end"] - m["start"])
        wanted = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
        if rule:
            wanted &= ~candidate.rlike(rule)
        runs = F.when(wanted, hot_runs(candidate)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(runs, lambda r: F.struct(F.lit("entropy").alias("kind"), F.lit(len(RULES)).alias("rank"), (m["start"] + r["start"]).alias("start"), (m["start"] + r["end"]).alias("end")))

    # a candidate without a digit has no hot window, so texts without one are left at once
    # (a run of its signs is looked at from its first sign alone, so a long one costs its length)
    some = text.rlike(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z+/_=-]*+[0-9]")
    return F.when(some, F.flatten(F.transform(found(text, CANDIDATE, 0), of))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _by_start(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))


def _as_span(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of struct<kind,rank,start,end> by start, then kind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = lambda a: F.transform(F.array_sort(F.transform(a, _by_start)), _as_span)
    base = F.concat(*[_spans(body, kind, k, *rule) for k, (kind, *rule) in enumerate(RULES)])
    return docs.withColumn("base", order(base)).withColumn("spans", order(F.concat("base", entropy_spans(body))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *[count(kind) for kind, *_ in RULES], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))

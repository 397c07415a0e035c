"""Operator 8: document fingerprints by one-permutation MinHash.

A text's five-word shingles are hashed once; the top bits of a hash name its bin
and each bin keeps its least hash. Empty bins are filled by optimal densification:
each takes the value of a non-empty bin drawn by randomness that is keyed on the
bin alone, so all texts draw alike. The low-order bits of the bins are stored,
packed in hex. The share p of equal bins of two fingerprints gives the likeness
(p - 2^-bits) / (1 - 2^-bits), which takes out chance matches of few bits.

DataFrame functions only. Fingerprints are made row by row. The text that follows
in ascending id order is found by dealing rows out in ranges of the id (one
shuffle of the texts); the first row of each range also goes to the range before
it, and the first of all to the last.

Defined results: null text is empty; a text without words has no shingles and an
all-empty fingerprint, which is 1 like another such one and 0 like any other; one
to four words are one shingle; equal texts have equal fingerprints; rows repeated
with one id stay, ordered by text, null ids first; one row alone follows itself;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import id_bounds, let, parts, range_of

SHINGLE, BINS, BITS = 5, 256, 8
#: Fixed value: the white space that parts words.
WORD = r"[^\x20\x09-\x0D]+"
TRIES = 6


def _shift(bins: int) -> int:
    return 63 - (bins.bit_length() - 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """array<long>, each from 0 to 2^63 - 1, one per place of a shingle."""

    def of(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, F.lit(size))), 1))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.shiftrightunsigned(F.xxhash64(words), 1))).otherwise(many)

    return let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), of)


def _draws(bins: int) -> list[int]:
    """For each bin its first ``TRIES`` draws of a bin, by a multiplicative hash of bin and draw."""
    out = []
    for i in range(bins):
        for t in range(TRIES):
            x = (i * 0x9E3779B97F4A7C15 + (t + 1) * 0xC2B2AE3D27D4EB4F) % 2**64
            x ^= x >> 29
            x = x * 0xBF58476D1CE4E5B9 % 2**64
            out.append((x ^ x >> 32) % bins)
    return out


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> Column:
    """array<int> of ``bins`` values of ``bits`` bits; null where there is no shingle."""
    shift = _shift(bins)
    bin_of = lambda h: F.shiftright(h, shift)
    top = (1 << shift) - 1
    # the greatest value of each bin stands in for nothing: sorted in, it is a bin's first only if the bin is empty
    fillers = F.array(*[F.lit((j << shift) | top) for j in range(bins)])
    draws = F.array(*[F.lit(x) for x in _draws(bins)])

    def firsts(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(sorted_, i - 1))))

    def fill(dense: Column) -> Column:
        empty = lambda h: h.bitwiseAND(F.lit(top)) == top
        held = F.filter(dense, lambda h: ~empty(h))

        def all_bins(some: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                tries = []
                for t in range(TRIES):
                    drawn = F.get(dense, F.get(draws, i * TRIES + t))
                    tries.append(F.when(~empty(drawn), drawn))
                # few bins are held: the held bin that comes first in this bin's own random order
                rest = F.array_min(F.transform(some, lambda v: F.struct(F.xxhash64(i, bin_of(v)).alias("order"), v.alias("v"))))["v"]
                return F.coalesce(F.when(~empty(h), h), *tries, rest).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

            return F.when(F.size(some) > 0, F.transform(dense, one))

        return let(held, all_bins)

    hashes = shingle_hashes(text, size)
    return let(F.sort_array(F.concat(hashes, fillers)), lambda s: let(firsts(s), fill))


def packed(values: Column, bits: int = BITS) -> Column:
    """Hex of the bins in order, ``bits`` bits each (a multiple of 4); empty for no shingles."""
    digits = bits // 4
    table = F.array(*[F.lit(f"{i:0{digits}x}") for i in range(1 << bits)])
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.get(table, v)), ""), F.lit(""))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """0 to 1 from two fingerprints, with the bias of few bits taken out."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 0.5**bits
    both = F.greatest((equal / F.size(a) - chance) / (1 - chance), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def with_next(docs: DataFrame, key: str, order: list[str], carry: dict[str, Column]) -> DataFrame:
    """``docs`` with ``next_*`` columns of the row that follows in ascending order of ``key`` (after the last: the first).

    ``carry`` are the columns taken from the following row, made after the shuffle.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col(key), F.lit(-(2**63))).alias("_k")
    ids = docs.select(k)
    bounds = id_bounds(ids, "_k", 4 * parts(spark))
    least = ids.agg(F.min("_k")).first()[0]
    own = range_of(F.col("_k"), bounds)
    ghosts = F.when(F.col("_k").isin(bounds), own - 1) if len(bounds) < 32 else F.when(F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("_k")), own - 1)
    wrap = F.when(F.col("_k") == F.lit(least), F.lit(len(bounds)))
    places = F.array(F.struct(own.alias("run"), F.lit(0).alias("ghost")), F.struct(ghosts.alias("run"), F.lit(1).alias("ghost")), F.struct(wrap.alias("run"), F.lit(2).alias("ghost")))
    dealt = docs.select("*", k).select("*", F.explode(F.filter(places, lambda p: p["run"].isNotNull())).alias("_at"))
    dealt = dealt.select(*docs.columns, "_k", F.col("_at.run").alias("_run"), F.col("_at.ghost").alias("_ghost")).repartition("_run")
    made = dealt.withColumns(carry)
    w = Window.partitionBy("_run").orderBy("_ghost", "_k", *[F.asc_nulls_first(c) for c in order])
    followed = made.withColumns({f"next_{c}": F.lead(c).over(w) for c in [*order, *carry]})
    return followed.where("_ghost = 0").drop("_k", "_run", "_ghost")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], {"own": fingerprint(F.col("text")), "n_chars": F.length("text").cast("long")})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    rows = rows.withColumn("changed", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )

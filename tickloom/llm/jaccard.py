"""Operator 7: n-gram Jaccard self-join by universe partition and pigeonhole.

Sets are hashed five-word shingles. Two sets of like J at most differ by
H = (sizes' sum)(1 - J)/(1 + J) shingles. In each size band the universe of hashes
is parted in segments, and a set's part in a segment is signed. A segment may be
left out, matched exactly (weight 1), or matched up to one deletion (weight 2: the
part and all its one-deletion neighbours are signed). While the weights used exceed H,
two linked sets agree in a used segment. Bands are so wide that a set's larger
partners are in its own band or the next one, so each set signs for its band and
for the one below.

Allocation by cost is in two steps. By band: small sets get one segment a shingle, then come
segments with one-deletion neighbours, and large sets get exact ones, where neighbours would
cost a row a shingle. By set, after the join's counts are known: with weight to spare, the
segments that most sets share are left out, so that common passages cost nothing
and a set with too few shared segments takes no part at all.

Pairs are not expanded in a group: the members of a signature's group are first
verified against one of them, what then still lies in different components against
another one, and only what lies apart after ``STARS`` rounds meets by its rarest
shingles. Before two sets meet, the parities of their shingles' counts in 1,024 bits
must allow it: bits that differ are no more than shingles that differ. Candidates are verified exactly on the whole sets.
Equal sets are one node from the start.

Defined results: null, empty and blank texts are empty sets and linked with
nothing; fewer than five words are one shingle; rows with one id and equal sets
are one node; a null id never names a component unless all of it have none; an
empty table gives no rows; extra columns are kept by ``jaccard_classes`` but for
those named like its results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.linking import PARITY_WORDS, Kind, connected, link_groups, named, parities, parities_allow, sets_of, sketched, verified
from tickloom.llm.shared import cut, drop, likely, small_batches, without
from tickloom.llm.shingles import U, mix, pieces, set_hash, shingles

WORDS, PERCENT = 5, 75
SINGLE, DELETE = 26, 100  # sizes below: a segment a shingle; exact and one-deletion
BITS = 16


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    segments: int
    deletions: bool


@cache
def band(k: int, percent: int = PERCENT) -> Band:
    low = 1 if k == 0 else band(k - 1, percent).high + 1
    high = low * 100 // percent
    differ = 2 * high * (100 - percent) // (100 + percent)
    if high < SINGLE:
        return Band(k, low, high, 1 << 12, False)
    if high < DELETE:
        return Band(k, low, high, differ + 3, True)
    return Band(k, low, high, int(1.3 * differ + 1.8 * high**0.5) + 1, False)


def band_of(n: int, percent: int = PERCENT) -> Band:
    k = 0
    while band(k, percent).high < n:
        k += 1
    return band(k, percent)


_HIGH = U((2**64 - 1) ^ (2 ** (BITS + 6) - 1))


def _sign(tokens: np.ndarray, mixed: np.ndarray, b: Band, least: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band, and the weight that may be left out (negative: too few segments are filled)."""
    segment = (tokens >> U(32)) * U(b.segments) >> U(32)  # ascending, as the tokens are
    at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sums = np.add.reduceat(mixed, at)
    name = segment[at] & U(2**BITS - 1) | U((b.number & 63) << BITS)
    sign = lambda s, name: mix(s + name, 6) & _HIGH | name
    out, weight = sign(sums, name), len(at)
    if b.deletions:
        size = np.diff(np.concatenate([at, [len(tokens)]]))
        many = np.repeat(size > 1, size)
        out = np.concatenate([out, sign((np.repeat(sums, size) - mixed)[many], np.repeat(name, size)[many])])
        weight += int((size > 1).sum())
    spare = weight - least
    return out, spare if b.segments <= 2**BITS else min(spare, 0)


def signatures(tokens: np.ndarray, percent: int = PERCENT) -> list[tuple[Band, np.ndarray, int]]:
    """(band, signatures, spare weight) for the bands in which a set may find partners that differ from it."""
    n, found = len(tokens), []
    if not n:
        return found
    own, mixed = band_of(n, percent), mix(tokens, 7)
    differ = lambda other: (n + other) * (100 - percent) // (100 + percent)
    if differ(n * 100 // percent):
        found.append((own, *_sign(tokens, mixed, own, differ(n * 100 // percent) + 1)))
    if own.number and -(-n * percent // 100) < own.low and differ(own.low - 1):
        below = band(own.number - 1, percent)
        found.append((below, *_sign(tokens, mixed, below, differ(own.low - 1) + 1)))
    return found


def _nodes(text: str, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                rows, bits = [], np.zeros((batch.num_rows, len(PARITY_WORDS)), np.int64)
                for i, s in enumerate(shingles(batch.column(text), WORDS)):
                    if len(s):
                        bits[i] = parities(s)
                        spare = {b.number: left for b, _, left in signatures(s, percent)}
                        k = band_of(len(s), percent).number
                        rows.append((set_hash(s), len(s), spare.get(k, 0), spare.get(k - 1, 0)))
                    else:
                        rows.append((None, 0, 0, 0))
                node, n, own, below = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.int32()), pa.array(below, pa.int32()), *map(pa.array, np.ascontiguousarray(bits.T))], names=["_id", "node", "n_shingles", "spare", "spare_below", *PARITY_WORDS])

    return run


def _signed(text: str, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are signed once
        for whole in batches:
            for batch in pieces(whole, text):
                sigs, nodes = [], []
                for s in shingles(batch.column(text), WORDS):
                    if len(s) and (node := set_hash(s)) not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(node)
                        for _, made, _ in signatures(s, percent):
                            sigs.append(made)
                            nodes.append(np.full(len(made), node, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return run


def _band(sig: str = "sig"):
    return F.shiftright(sig, BITS).bitwiseAND(F.lit(63))


def nodes(docs: DataFrame, key: str, text: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, rows, heads): texts (_id, _text); rows (_id, node, n_shingles, ...) of every document; heads, a row a node."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = cut(texts.mapInArrow(_nodes("_text", percent), f"_id {dict(texts.dtypes)['_id']}, node long, n_shingles long, spare int, spare_below int, {', '.join(f'{w} long' for w in PARITY_WORDS)}"))
    heads = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("head"), F.max("n_shingles").alias("n"), F.max("spare").alias("spare"), F.max("spare_below").alias("spare_below"), *[F.max(w).alias(w) for w in PARITY_WORDS])
    return texts, rows, cut(heads)


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (_id, node, n_shingles) of every document, and the components (node, component)
    of all nodes that verified links connect."""
    texts, rows, heads = nodes(docs, key, text, percent)
    signed = texts.select("_text").mapInArrow(_signed("_text", percent), "sig long, node long")
    w = Window.partitionBy("sig")
    counted = signed.withColumns({"least": F.min("node").over(w), "most": F.max("node").over(w), "count": F.count("*").over(w)})
    hits = cut(counted.where("least != most").select("sig", "node", F.col("count").cast("int").alias("count")).distinct())

    # by set and band: segments in order of what they cost; the weight to spare leaves the first of them out
    segment = hits.groupBy("node", _band().alias("band"), F.col("sig").bitwiseAND(F.lit(2**BITS - 1)).alias("segment")).agg(F.max("count").alias("count"), F.collect_set("sig").alias("sigs"))
    costly = Window.partitionBy("node", "band").orderBy(F.desc("count"), "segment")
    starts = [band(k, percent) for k in range(64)]
    own = F.when(F.lit(False), 0)
    for b in starts:
        own = own.when(F.col("n") <= b.high, b.number)
    heavy = F.col("band").isin([b.number for b in starts if b.deletions])
    ranked = segment.join(heads.select("node", "n", "spare", "spare_below"), "node").withColumn("left_out", F.row_number().over(costly) * F.when(heavy, 2).otherwise(1) <= F.when(F.col("band") == own.bitwiseAND(F.lit(63)), F.col("spare")).otherwise(F.col("spare_below")))
    used = cut(ranked.select("node", "n", F.explode("sigs").alias("sig"), (~F.col("left_out")).alias("probe")))
    drop(hits)

    kind = Kind(texts, heads, PARITY_WORDS, percent, parities_allow(percent))
    classes = link_groups(used, kind)

    # sets whose shingles fill too few segments (hardly any): their rarest shingles by hash meet those of the others
    short = heads.where("spare < 0 or spare_below < 0").select("node", "n")
    if not short.isEmpty():
        classes = connected(classes, verified(sketched(_by_prefix(texts, heads, short, percent), kind), kind))
    return rows, classes


def _by_prefix(texts: DataFrame, heads: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of the few sets of ``short`` with any other: linked sets share one of
    their least n - ceil(n * percent / 100) + 1 shingles. Only sets of a like size, and of them only
    shingles that may be a short set's, are shuffled."""
    least = lambda n: F.expr(f"slice(tokens, 1, cast({n} - ceil({n} * {percent} / 100.0) + 1 as int))")
    head = sets_of(short.select("node"), texts, heads).join(short, "node")
    ours = cut(head.select(F.col("node").alias("a"), F.col("n").alias("an"), F.explode(least("n")).alias("t")))
    # sizes as bands: a partner is in the band of a short set or beside it
    bands = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    near = short.select(F.explode(F.array(bands - 2, bands - 1, bands, bands + 1, bands + 2)).alias("_size")).distinct()
    alike = heads.withColumn("_size", bands).join(near, "_size", "left_semi").select("node", "n", "head")
    others = sets_of(alike.select("node"), texts, heads).join(alike.select("node", "n"), "node").select(F.col("node").alias("b"), F.col("n").alias("bn"), F.explode(least("n")).alias("t"))
    some = likely(others, F.col("t"), ours, F.col("t"))
    pairs = ours.join(some, "t").where((F.col("a") != F.col("b")) & (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")))
    return pairs.select("a", "b")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links)."""
    return named(*links(docs, key, text, percent), key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are linked, over any links, with one of smaller id."""
    classes = jaccard_classes(docs, key, text, percent)
    gone = cut(classes.where(F.col("component_id") != F.col(key)).select(key).distinct())
    return without(docs, key, gone, key)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

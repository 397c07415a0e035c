"""Operator 13: near-duplicate documents by b-bit MinHash.

A document's set of shingle hashes has ``HASHES`` minima. Bands of ``ROWS`` whole minima
name the groups in which candidates meet; of each minimum ``LOW`` bits are kept, packed
in 64-bit words. Where two documents share a band, equal packed values are counted with
bit operations, and the share that equals by chance is taken out of the estimate:
J = (equal - C) / (1 - C) with C = 2^-LOW. Pairs whose estimate is ``DEVIATIONS`` standard
deviations or more below the threshold go. What is left is confirmed on full sets: first by
parities of their shingles' counts in 1,024 bits, of which linked sets can't differ in more than
in shingles, then shingle by shingle.

At the threshold of 0.85 a link shares no band with a probability of (1 - 0.85^4)^32,
5e-11, and is lost to the estimate with less than 1e-10.

As in the Jaccard join, equal sets are one node from the start, and the members of a
band's group are verified against one of them, then what lies apart against another
one, and the rest meets by its rarest shingles, so a group costs about its size.

Defined results: null, empty and blank texts are empty sets, linked with nothing and
kept; fewer than five words are one shingle; rows with one id and equal sets are one node;
a null id never names a component unless all of it have none, and is kept only
then; an empty table gives no rows; columns but the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.linking import PARITY_WORDS, Kind, link_groups, named, parities, parities_allow
from tickloom.llm.shared import cut, drop, small_batches
from tickloom.llm.shingles import U, mix, pieces, set_hash, shingles

WORDS, PERCENT = 5, 85
HASHES, ROWS, LOW = 128, 4, 4
DEVIATIONS = 7
PACKED = HASHES * LOW // 64
_WORDS = [f"m{i}" for i in range(PACKED)]
_SKETCH = [*_WORDS, *PARITY_WORDS]
#: Shingles hashed at once: they stay in a core's cache.
BLOCK = 32_768


@cache
def _multipliers() -> np.ndarray:
    return (mix(np.arange(HASHES, dtype=U), 30) >> U(32)).astype(np.uint32) | np.uint32(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """sets x HASHES: the least of each hash function over each set, none of which is empty."""
    out = np.full((HASHES, len(sets)), np.iinfo(np.uint32).max, np.uint32)
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> U(32)).astype(np.uint32) | np.uint32(1)
    owner = np.repeat(np.arange(len(sets)), sizes)
    made = np.empty(BLOCK, np.uint32)
    for lo in range(0, len(flat), BLOCK):
        x, own = flat[lo : lo + BLOCK], owner[lo : lo + BLOCK]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        first, last = own[0], own[-1] + 1
        for k, a in enumerate(_multipliers()):
            h = np.multiply(x, a, out=made[: len(x)])
            np.minimum(out[k, first:last], np.minimum.reduceat(h, at), out=out[k, first:last])
    return out.T


def packed(minimum: np.ndarray) -> np.ndarray:
    """sets x PACKED words: the lowest bits of the mixed minima, the first one in the lowest bits of the first word."""
    bits = mix(minimum.astype(U), 31) & U((1 << LOW) - 1)
    each = 64 // LOW
    return (bits.reshape(len(minimum), PACKED, each) << (np.arange(each, dtype=U) * U(LOW))).sum(axis=2, dtype=U).view(np.int64)


def bands(minimum: np.ndarray) -> np.ndarray:
    """sets x bands: a hash of the band's number and its whole minima."""
    rows = minimum.astype(U).reshape(len(minimum), HASHES // ROWS, ROWS)
    sig = np.tile(mix(np.arange(HASHES // ROWS, dtype=U), 32), (len(minimum), 1))
    for k in range(ROWS):
        sig = mix(sig + rows[:, :, k], 33 + k)
    return sig.view(np.int64)


def equal_values(p: str, q: str) -> Column:
    """How many of the packed values two rows share: words' differences folded to one bit a value, and counted."""
    ones = F.lit(int("1".rjust(LOW, "0") * (64 // LOW), 2))

    def differ(w: str) -> Column:
        x = F.col(f"{p}{w}").bitwiseXOR(F.col(f"{q}{w}"))
        folded = x
        for k in range(1, LOW):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(ones))

    return F.lit(HASHES) - sum((differ(w) for w in _WORDS), F.lit(0))


def similarity(p: str, q: str) -> Column:
    """The collision-corrected estimate of two rows' Jaccard similarity."""
    chance = 2.0**-LOW
    return F.greatest(F.lit(0.0), (equal_values(p, q) / HASHES - chance) / (1 - chance))


def _least_equal(percent: int) -> int:
    """Equal values of which a link has fewer with a probability below that of ``DEVIATIONS`` standard deviations."""
    chance = 2.0**-LOW
    p = chance + (1 - chance) * percent / 100
    return int(HASHES * p - DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5)


def _rows(text: str, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task have their bands once
        for whole in batches:
            for batch in pieces(whole, text):
                sets = shingles(batch.column(text), WORDS)
                n = np.array([len(s) for s in sets])
                node = [set_hash(s) if len(s) else None for s in sets]
                # of those that may have a link with another set, one of each
                new = []
                for i, x in enumerate(node):
                    if x is not None and 100 * n[i] >= percent * (n[i] + 1) and x not in seen:
                        new.append(i)
                        seen.add(x)
                words, sigs = np.zeros((batch.num_rows, PACKED + len(PARITY_WORDS)), np.int64), [None] * batch.num_rows
                if new:
                    least = minima([sets[i] for i in new])
                    words[new] = np.hstack([packed(least), [parities(sets[i]) for i in new]])
                    for i, s in zip(new, bands(least), strict=True):
                        sigs[i] = s
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(words.T))], names=["_id", "node", "n_shingles", "sigs", *_SKETCH])

    return run


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (_id, node, n_shingles) of every document, and the components (node, component)
    of all nodes that verified links connect."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = cut(texts.mapInArrow(_rows("_text", percent), f"_id {dict(texts.dtypes)['_id']}, node long, n_shingles long, sigs array<long>, {', '.join(f'{w} long' for w in _SKETCH)}"))
    # tasks that saw a set again left its words at zero
    signed = rows.where("sigs is not null")
    made = signed.groupBy("node").agg(*[F.any_value(w).alias(w) for w in _SKETCH])
    heads = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("head"), F.max("n_shingles").alias("n"))
    heads = cut(heads.join(made, "node"))
    member = cut(signed.select("node", F.explode("sigs").alias("sig")).distinct())
    groups = member.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most")
    used = cut(member.join(groups.select("sig"), "sig").withColumn("probe", F.lit(True)))
    drop(member)
    least, fits = _least_equal(percent), parities_allow(percent)
    kind = Kind(texts, heads, _SKETCH, percent, lambda p, q: (equal_values(p, q) >= least) & fits(p, q))
    return rows, link_groups(used, kind)


def minhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links), kept."""
    found = named(*links(docs, key, text, percent), key)
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

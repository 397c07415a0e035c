"""Operator 10: language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed character n-grams (one to
three letters, words parted by single spaces, whole text). Each language has
several centroids: a spherical k-means over a bounded sample of its labelled
texts. A text is given the language of the centroid of greatest cosine, and is
rejected where that cosine is below the centroid's floor (a share of what its own
members reach); a language fitted on fewer than ``LEAST`` texts rejects nothing.

What is counted over the corpus, the document frequency of each n-gram, covers
every labelled row. The classifier is fitted on ``SAMPLE`` texts a language at
most, chosen by a hash of the id, one task a language. The model that goes to the
executors has languages x ``CENTROIDS`` rows of ``SLOTS`` numbers, whatever the
input's size is. Prediction is row by row without a shuffle.

Defined results: null text, empty text and text without a letter are ``und`` with
score 0 and rejected; rows without lang or id are not learned from; with nothing
to learn from every row is ``und``, and texts with a letter are not rejected; ties go to the first language in ascending
order; rows repeated stay; an empty table gives no rows; input columns that are
named like the results are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.shared import small_batches

SLOTS = 1 << 14
SAMPLE = 400
CENTROIDS = 4
FLOOR = 0.25
#: A language fitted on fewer texts rejects nothing: its members' reach isn't known.
LEAST = 20
UNKNOWN = "und"
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_LETTER: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case text with every run of other signs as one space; a space at either end."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _LETTER[0][codes]
    codes = np.where(keep, codes, np.uint32(32))
    same = np.empty(len(codes), bool)
    if len(codes):
        same[0] = not keep[0]
        same[1:] = ~keep[1:] & ~keep[:-1]
        codes = codes[~same]
    return np.concatenate([[32], codes, [32] if len(codes) and codes[-1] != 32 else []]).astype(np.uint32)


def counts(text: str, slots: int = SLOTS) -> np.ndarray | None:
    """How often each slot of n-grams occurs; null without a letter."""
    c = letters(text)
    if len(c) < 2:
        return None
    shift = np.uint32(32 - (slots.bit_length() - 1))
    grams, out = c * _MULTIPLIERS[0], []
    for n in range(3):
        if n:
            if len(c) <= n:
                break
            grams = (grams[:-1] ^ grams[:-1] >> np.uint32(15)) * _MULTIPLIERS[n] + c[n:] * _MULTIPLIERS[0]
        out.append((grams * _MULTIPLIERS[2] ^ grams >> np.uint32(13)) * _MULTIPLIERS[1] >> shift)
    return np.bincount(np.concatenate(out), minlength=slots).astype(np.float32)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None
    owner: np.ndarray | None = None
    floors: np.ndarray | None = None

    def vector(self, text: str | None) -> np.ndarray | None:
        return None if text is None or (c := counts(text)) is None else _vector(c, self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:  # nothing tells the languages apart, so no text with a letter is far from any
            return names, scores, np.array([t is None or len(letters(t)) < 2 for t in texts], bool)
        for lo in range(0, len(texts), 64):
            vectors = [self.vector(t) for t in texts[lo : lo + 64]]
            at = [i for i, v in enumerate(vectors) if v is not None]
            if not at:
                continue
            near = np.stack([vectors[i] for i in at]) @ self.centroids.T
            best = near.argmax(1)
            for i, b, s in zip(at, best, near[np.arange(len(at)), best], strict=True):
                names[lo + i], scores[lo + i], rejected[lo + i] = self.languages[self.owner[b]], min(1.0, max(0.0, float(s))), s < self.floors[b]
        return names, scores, rejected


def _vector(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (c := counts(text.as_py())) is not None:
                seen += c > 0
                rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"slot": np.concatenate([[-1], at]).astype(np.int32), "n": np.concatenate([[rows], seen[at]])})


def _fit(idf: np.ndarray, centroids: int, floor: float):
    """Spherical k-means of one language's sample; starts at far-apart members, so it is the same each time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "text"], kind="stable")
        x = [_vector(c, idf) for t in pdf["text"] if (c := counts(t)) is not None]
        out = pd.DataFrame({"lang": pd.Series(dtype=str), "vector": pd.Series(dtype=object), "floor": pd.Series(dtype=float)})
        if not x:
            return out
        x = np.stack(x)
        m = x.mean(0)
        centres = [m / (np.linalg.norm(m) or 1)]
        while len(centres) < min(centroids, len(x)):
            centres.append(x[(x @ np.stack(centres).T).max(1).argmin()])
        c = np.stack(centres)
        for _ in range(8):
            own = (x @ c.T).argmax(1)
            for k in range(len(c)):
                if (own == k).any():
                    m = x[own == k].mean(0)
                    c[k] = m / (np.linalg.norm(m) or 1)
        near = x @ c.T
        reach = np.quantile(near.max(1), 0.01)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "vector": [v.astype("float32") for v in c], "floor": [float(reach * floor) if len(x) >= LEAST else -1.0] * len(c)})

    return run


def learnable(key: str = "doc_id"):
    """Rows to learn from: not those with crc32(id as text) mod 3 = 1."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS, floor: float = FLOOR) -> Model:
    """Learns from the rows of ``docs`` with text, lang and id; the caller leaves out what is held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null")
    seen = rows.select("text").mapInArrow(_document_frequency, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found = {r["slot"]: r["n"] for r in seen}
    if not found.get(-1):
        return Model()
    df = np.zeros(SLOTS)
    for slot, n in found.items():
        if slot >= 0:
            df[slot] = n
    idf = (np.log((1 + found[-1]) / (1 + df)) + 1).astype(np.float32)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # about twice the sample by a hash of the id, then the first of them
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * sample / n + 20.0 / n)))])
    order = F.shiftrightunsigned(F.xxhash64("id"), 1)
    some = rows.withColumn("order", order).where(F.col("order") / 2.0**63 <= share[F.col("lang")])
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "text"))).where(F.col("at") <= sample)
    fitted = some.select("lang", "order", "text").groupBy("lang").applyInPandas(_fit(idf, centroids, floor), "lang string, vector array<float>, floor double").collect()
    fitted.sort(key=lambda r: r["lang"])
    languages = sorted({r["lang"] for r in fitted})
    return Model(languages, idf, np.array([r["vector"] for r in fitted], np.float32), np.array([languages.index(r["lang"]) for r in fitted]), np.array([r["floor"] for r in fitted]))


RESULTS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; rows don't move."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in {r.name for r in RESULTS}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = model.predict(batch.column(text).to_pylist())
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=[*(f.name for f in kept), *(r.name for r in RESULTS)])

    return docs.mapInArrow(run, T.StructType([*kept, *RESULTS]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(learnable()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")

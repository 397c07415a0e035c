"""Operator 11: vectors compressed to part codes, nearest entries found by VA-file filtering.

Components become integers, a vector is cut in equal parts, and each part position has a
codebook. A part's nearest entry is found as in a vector-approximation file: each entry's
coordinates are quantised to cells of few bits; a query part looks up, per coordinate and
cell, the least and the greatest squared distance to the cell; their sums bound each
entry's distance from below and above, and only entries whose lower bound doesn't exceed
the least upper bound are refined with integer distances. The result is that of a full
comparison, ties to the lower index.

A round is one pass: each task adds up its parts by entry, an aggregate adds up the
tasks, and the new codebooks (entries x components numbers, whatever the table's size
is) come to the driver and go out with the next pass.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; a null id sorts behind all others when the first entries are taken, equal ids
sort by their components; null labels are one label; fewer vectors than entries give as
many entries; vectors of no components have codes of zeros; an empty table, or one
without a kept vector, gives no rows; rows that repeat are kept each; columns but the
three named are not read. Vectors of unequal lengths, lengths that can't be cut equally and components
beyond 2^19 are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELL_BITS = 4
#: Greatest magnitude of an integer component: squared distances and their sums stay exact in 64 bits.
MOST = 2**27
#: Query parts compared at once.
BLOCK = 1024


def integers(column: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept rows of an array of vectors, and their components as a matrix of integers."""
    lengths = pc.list_value_length(column)
    valid = np.asarray(pc.is_valid(lengths))
    n = np.asarray(pc.fill_null(lengths, 0)).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64())
    x = np.asarray(pc.fill_null(flat, float("nan")), dtype=np.float64)
    ends = np.cumsum(n)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    kept = np.flatnonzero(valid & (bad[ends] == bad[ends - n]))
    width = n[kept]
    if len(kept) and ((width != width[0]).any() or width[0] % parts):
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {sorted(set(width.tolist()))[:5]}")
    d = int(width[0]) if len(kept) else 0
    at = (ends - n)[kept][:, None] + np.arange(d)
    made = np.floor(SCALE * x[at])
    if made.size and np.abs(made).max() > MOST:
        raise ValueError("vector components are too large for integer distances")
    return kept, made.astype(np.int64).reshape(len(kept), d)


class Cells:
    """One part position's entries (m x w integers) with their coordinates quantised to cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        m, w = entries.shape
        self.entries, self.cell, self.low, self.high = entries, np.zeros((m, w), np.intp), [], []
        for j in range(w):
            order = np.argsort(entries[:, j], kind="stable")
            cell = np.arange(m) * min(m, 1 << bits) // m  # cells of like many entries
            self.cell[order, j] = cell
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            self.low.append(entries[order[at], j])
            self.high.append(entries[order[np.concatenate([at[1:], [m]]) - 1], j])

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """n x m: whether an entry may be nearest to a query part, by its bounds."""
        lower = np.zeros((len(x), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            under, over = low - x[:, j, None], x[:, j, None] - high
            table = np.maximum(np.maximum(under, over), 0) ** 2  # a row a query, a column a cell
            lower += table[:, self.cell[:, j]]
            table = np.maximum(np.abs(x[:, j, None] - low), np.abs(x[:, j, None] - high)) ** 2
            upper += table[:, self.cell[:, j]]
        return lower <= upper.min(axis=1)[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each query part's nearest entry, the lower one of equals, and the squared distance."""
        may = self.candidates(x)
        query, entry = np.nonzero(may)
        distance = np.full(may.shape, np.iinfo(np.int64).max)
        distance[query, entry] = ((x[query] - self.entries[entry]) ** 2).sum(axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(x)), best]


def _assigned(books: np.ndarray, batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, places, components by part, codes, distances) of blocks of kept rows."""
    cells = [Cells(b) for b in books]
    parts, _, w = books.shape
    for batch in batches:
        kept, whole = integers(batch.column(vector), parts)
        if len(kept) and whole.shape[1] != parts * w:
            raise ValueError("vectors must have one length")
        for lo in range(0, len(kept), BLOCK):
            x = whole[lo : lo + BLOCK]
            x = x.reshape(len(x), parts, w)
            found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
            yield batch, kept[lo : lo + BLOCK], x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray, vector: str):
    parts, m, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, m, w), np.int64), np.zeros((parts, m), np.int64)
        for _, _, x, code, _ in _assigned(books, batches, vector):
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=m)
        p, e = np.nonzero(count)
        cell = np.repeat(p * m + e, w)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.tile(np.arange(w), len(p))), pa.array(total[p, e].reshape(-1)), pa.array(np.repeat(count[p, e], w))], names=["cell", "at", "total", "count"])

    return run


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks: parts x entries x components of a part; no entries where no vector is kept."""
    only = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch.column("v"), parts)
            offsets = np.arange(len(kept) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], names=["id", "v"])

    first = only.mapInArrow(whole, f"id {dict(only.dtypes)['id']}, v array<long>").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    if len({len(r["v"]) for r in first}) > 1:
        raise ValueError("vectors must have one length")
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, len(first[0]["v"]) // parts).transpose(1, 0, 2).copy()
    m, w = books.shape[1:]
    for _ in range(rounds if w else 0):
        sums = only.select("v").mapInArrow(_sums(books, "v"), "cell long, at long, total long, count long")
        # parts x entries x components rows, whatever the table's size is
        for r in sums.groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect():
            books[r["cell"] // m, r["cell"] % m, r["at"]] = r["total"] // r["count"]
    return books


def encode(df: DataFrame, books: np.ndarray, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error) of the kept rows."""
    only = df.select(F.col(key).alias("id"), F.col(label).alias("l"), F.col(vector).alias("v"))
    kinds = dict(only.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch, at, _, code, distance in _assigned(books, batches, "v"):
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("l").take(at), pa.array(["".join(r) for r in digits[code].tolist()]), pa.array(distance.sum(axis=1))], names=["id", "l", "code", "error"])

    if not books.shape[1]:
        return only.where(F.lit(False)).select("id", "l", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return only.mapInArrow(run, f"id {kinds['id']}, l {kinds['l']}, code string, error long")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every kept row."""
    books = train(df, key, vector, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rows = cut(encode(df, books, key, vector, label))
    # a table of its own, so that a label with very many rows can be split in the join
    sums = cut(rows.groupBy(F.col("l").alias("l2")).agg(F.sum("error").alias("label_error")))
    joined = rows.join(sums, F.col("l").eqNullSafe(F.col("l2")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Every part with every entry, twice over for new entries and once for the codes."""
    near = lambda book: f"""
      SELECT rid, p, min(struct_pack(d := d, e := e)) AS best FROM (
        SELECT c.rid, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN {book} b ON c.p = b.p AND c.i = b.i GROUP BY c.rid, c.p, b.e) GROUP BY rid, p"""  # noqa: E731
    moved = lambda book, near: f"""
      SELECT b.p, b.e, b.i, coalesce(n.x, b.x) AS x FROM {book} b LEFT JOIN (
        SELECT p, e, i, CAST((t - ((t % k) + k) % k) / k AS BIGINT) AS x FROM (
          SELECT c.p, n.best.e AS e, c.i, CAST(sum(c.x) AS BIGINT) AS t, count(*) AS k FROM cells c JOIN {near} n ON c.rid = n.rid AND c.p = n.p GROUP BY ALL)) n
      ON b.p = n.p AND b.e = n.e AND b.i = n.i"""  # noqa: E731
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cells AS MATERIALIZED (SELECT rid, pos // (n // {PARTS}) AS p, pos % (n // {PARTS}) AS i, v[pos + 1] AS x FROM (SELECT rid, v, len(v) AS n, unnest(range(len(v))) AS pos FROM kept)),
    book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, i, x FROM cells WHERE rid <= {ENTRIES}),
    near0 AS MATERIALIZED ({near("book0")}),
    book1 AS MATERIALIZED ({moved("book0", "near0")}),
    near1 AS MATERIALIZED ({near("book1")}),
    book2 AS MATERIALIZED ({moved("book1", "near1")}),
    near2 AS MATERIALIZED ({near("book2")}),
    coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY rid)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book2) AS codebooks_sha256 FROM kept JOIN coded USING (rid)"""


SQL = _sql()

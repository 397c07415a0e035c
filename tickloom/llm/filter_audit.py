"""Operator 12: which document filters overlap, for every order they may run in.

A document's failures are a mask of five bits. Per part (source) the masks of all
documents, of those of good quality and of toxic ones are counted: three histograms of
32 bins, stacked as rows of an incidence matrix. What each order keeps, removes, finds
removed already or removes alone depends on the mask only, so these are five integer
matrices of 32 rows and 600 columns (120 orders of five filters, five steps each), and
the audit is the product. The corpus is read once; only masks and digests are shuffled.

Equal texts are told by SHA-256. The smallest id of each digest comes from an aggregate
with map-side parts, and meets the rows on (digest, id), so no group of copies is in
one task.

Defined results: a null text is empty; a null part is the empty part; a row with a null
id never fails E and has no labels; rows that repeat an id are counted each, and don't
fail E by one another; a document is good (toxic) where any of its label rows says 1;
an empty table has no parts and so no rows; columns but the four named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import cut

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@cache
def matrices() -> dict[str, np.ndarray]:
    """Integer matrices of 32 rows (masks) and 600 columns (orders, then steps); 1: the outcome holds."""
    mask = np.arange(MASKS)[:, None]
    steps = [(order, k) for order in ORDERS for k in range(len(order))]
    bit = lambda letters: sum(1 << FILTERS.index(x) for x in letters)
    own = np.array([bit(order[k]) for order, k in steps])
    before = np.array([bit(order[:k]) for order, k in steps])
    fails, gone = (mask & own) > 0, (mask & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    made = {k: v.astype(np.int64) for k, v in made.items()}
    same = (own[:, None] == own[None, :]).astype(np.int64)  # columns of one filter, over all orders and steps
    return made | {"shapley": made["removed"] @ same}


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = matrices()
    for batch in batches:
        n = batch.num_rows
        rows = np.zeros((3, n, MASKS), np.int64)  # all documents, good ones, toxic ones
        for i, cells in enumerate(batch.column("cells").to_pylist()):
            for c in cells:
                rows[:, i, c["mask"]] += c["n"] * np.array([1, c["good"], c["toxic"]])
        every, good, toxic = rows
        counts = [every @ m["kept"], every @ m["removed"], every @ m["redundant"], every @ m["unique_fails"], good @ m["removed"], toxic @ m["removed"], every @ m["shapley"]]
        width = len(ORDERS) * len(FILTERS)
        part = batch.column("part").take(pa.array(np.repeat(np.arange(n), width)))
        order = pa.array(np.tile(np.repeat(ORDERS, len(FILTERS)), n).tolist(), pa.string())
        step = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), n * len(ORDERS)))
        yield pa.RecordBatch.from_arrays([part, order, step, *[pa.array(c.reshape(-1)) for c in counts]], names=["part", "filter_order", "step", *COUNTS])


def interactions(masks: DataFrame) -> DataFrame:
    """The audit of rows (part, mask, good, toxic): 600 rows a part, by matrix products of its histograms."""
    cells = masks.groupBy("part", "mask", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic")).agg(F.count("*").alias("n"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))  # 128 at most
    return parts.mapInArrow(_product, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def _fails(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D of a text with its words."""
    n, chars = F.size(words), F.char_length(text)
    capitals = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 2 * chars, text.rlike("[#$%&*|]")]


def failure_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, mask, good, toxic), one a document; bit i of the mask: filter i of ABCDE fails."""
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    worded = whole.withColumn("w", F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), ""))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(_fails(F.col("t"), F.col("w")))), F.lit(0))
    rows = cut(worded.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    said = labels.groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("id is not null and (good or toxic)")
    joined = rows.join(first, ["digest", "id"], "left").join(said, "id", "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.select("part", (F.col("mask") + copy).alias("mask"), flag("good"), flag("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(failure_masks(docs, labels))


#: Every order and step against every kind of document, without matrices.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
said AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM worded LEFT JOIN said USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failing GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS x, substr(filter_order, 1, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
outcomes AS (SELECT part, filter_order, step, x, fails, n, n_good, n_toxic, contains(fails, x) AS own, length(translate(before, fails, '')) < length(before) AS gone FROM kinds, steps),
summed AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM summed"""

"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests on one machine) a
    temporary folder is made and set as the checkpoint folder; elsewhere it is an
    error, for executors don't share such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; the writer makes it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A map of wanted keys has this many bits, so it has 2^18 rows of 64 bits at most whatever the input is.
MAP_BITS = 24


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _flagged(df: DataFrame, key: Column, ids: DataFrame, id_: Column) -> tuple[DataFrame, str]:
    """``df`` with a column, and its name: false where ``key`` is surely none of ``ids``.

    The hashed ids go to all executors as a map of ``MAP_BITS`` bits, a table of bounded size. The more
    ids there are, the more rows may match by chance: the exact join behind it gets them too.
    """
    at, bits, flag = free(df, "_map_word"), free(df, "_map_bits"), free(df, "_map_may")
    word = lambda h: F.shiftrightunsigned(h, 64 - MAP_BITS + 6)
    bit = lambda h: F.shiftrightunsigned(h, 64 - MAP_BITS).bitwiseAND(F.lit(63)).cast("int")
    h = F.xxhash64(id_)
    marks = ids.groupBy(word(h).alias(at)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(h))).alias(bits))
    h = F.xxhash64(key)
    held = df.join(F.broadcast(marks), word(h) == F.col(at), "left")
    may = F.call_function("shiftrightunsigned", F.coalesce(bits, F.lit(0).cast("long")), bit(h)).bitwiseAND(F.lit(1)) == 1
    return held.withColumn(flag, may).drop(at, bits), flag


def likely(df: DataFrame, key: Column, ids: DataFrame, id_: Column) -> DataFrame:
    """Rows of ``df`` whose ``key`` is one of ``ids``, and few others, without a shuffle of ``df``."""
    flagged, flag = _flagged(df, key, ids, id_)
    return flagged.where(flag).drop(flag)


def look_up(df: DataFrame, key: Column, side: DataFrame, side_key: str) -> DataFrame:
    """``df`` left-joined with ``side`` (one row a key, null-safe), by one plan at every size.

    Only rows that likely have a partner are shuffled. ``side``'s columns are null where there is none.
    """
    flagged, flag = _flagged(df, key, side, F.col(side_key))
    found = flagged.where(flag).join(side.hint("merge"), key.eqNullSafe(F.col(side_key)), "left")
    return found.unionByName(flagged.where(~F.col(flag)), allowMissingColumns=True).drop(flag)


def without(df: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is none of ``ids`` (null-safe); only rows that may be are shuffled."""
    own = free(df, "_gone")
    gone = ids.select(F.col(id_).alias(own))
    flagged, flag = _flagged(df, df[key], gone, F.col(own))
    kept = flagged.where(flag).join(gone.hint("merge"), df[key].eqNullSafe(F.col(own)), "left_anti")
    return kept.unionByName(flagged.where(~F.col(flag))).drop(flag)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows at most, for bounded memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending values of ``key`` that cut the rows in runs of like size.

    The list is bounded by ``n`` whatever the input's size is.
    """
    if n < 2:
        return []
    points = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, points, max(10_000, 20 * n)).alias("q")).first()
    return sorted(set(row.q or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` at or below ``key``: its run; null keys are in run 0."""
    if not bounds:
        return F.lit(0)

    # two short searches: the coarse edge, then the run of bounds behind it
    step = max(1, int(len(bounds) ** 0.5))
    edges, coarse = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[::step]])
    at_most = lambda a: F.size(F.filter(a, lambda b: b <= key))
    fine = let(at_most(coarse), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + at_most(F.slice(edges, (c - 1) * step + 1, F.lit(step)))))
    return F.when(key.isNull(), 0).otherwise(fine)

"""Due times, catch-up, dependencies and levels of task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.shared import with_checkpoints


def due(plans: DataFrame, until: Column) -> DataFrame:
    """(plan, fire_at) of interval plans (plan, start, seconds) up to ``until``."""
    n = F.floor((F.unix_timestamp(until) - F.unix_timestamp("start")) / F.col("seconds")).cast("int")
    return plans.where(F.col("start") <= until).withColumn("_k", F.explode(F.sequence(F.lit(0), n))).select("plan", F.timestamp_seconds(F.unix_timestamp("start") + F.col("_k") * F.col("seconds")).alias("fire_at"))


def misfires(fired: DataFrame, policy: str, limit: int = 100) -> DataFrame:
    """Missed times of each plan by policy: SKIP none, FIRE_ONCE the last, CATCH_UP the first ``limit``."""
    if policy == "SKIP":
        return fired.limit(0)
    if policy == "FIRE_ONCE":
        return fired.groupBy("plan").agg(F.max("fire_at").alias("fire_at"))
    from pyspark.sql import Window

    return fired.withColumn("_n", F.row_number().over(Window.partitionBy("plan").orderBy("fire_at"))).where(F.col("_n") <= limit).drop("_n")


def levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a node without predecessors, over edges (before, after), by rounds until no node gets
    further; a cycle behind such a node is an error."""
    with_checkpoints(spark)
    edges = edges.select("before", "after").distinct().checkpoint()
    roots = edges.select(F.col("before").alias("node")).join(edges.select(F.col("after").alias("node")), "node", "left_anti").distinct()
    label, at, most = roots.withColumn("level", F.lit(0)).checkpoint(), 0, edges.select("after").distinct().count()
    while True:
        step = edges.join(label.where(F.col("level") == at), F.col("before") == F.col("node")).select(F.col("after").alias("node"), F.lit(at + 1).alias("level"))
        label = label.unionByName(step).groupBy("node").agg(F.max("level").alias("level")).checkpoint()
        at += 1
        if label.where(F.col("level") == at).isEmpty():
            return label
        if at > most:
            raise ValueError("the edges have a cycle")


def gates(tasks: DataFrame) -> DataFrame:
    """Whether each task (id, state, depends_on array) may start: READY, BLOCKED by one that failed, or WAITING."""
    need = tasks.select("id", F.explode("depends_on").alias("dep")).join(tasks.select(F.col("id").alias("dep"), F.col("state").alias("dep_state")), "dep", "left")
    a = need.groupBy("id").agg(F.max(F.when(F.coalesce("dep_state", F.lit("FAILED")).isin("FAILED", "CANCELLED"), 1).otherwise(0)).alias("bad"), F.min(F.when(F.col("dep_state") == "SUCCESS", 1).otherwise(0)).alias("done"))
    j = tasks.join(a, "id", "left")
    return j.select("id", F.when(F.coalesce("bad", F.lit(0)) == 1, "BLOCKED").when(F.coalesce("done", F.lit(1)) == 1, "READY").otherwise("WAITING").alias("gate"))


def trading_day(day: Column, holidays: Column) -> Column:
    """Monday to Friday and no holiday (an array of dates)."""
    return ~F.dayofweek(day).isin(1, 7) & ~F.array_contains(holidays, day)

"""Linear recurrences over long series in blocks.

A series is cut in blocks of ``BLOCK`` rows. Within a block the recurrence starts from nothing
and is one grouped pandas kernel; what a block leaves for the next one is a short
series of its own (one row a block), folded by a window. So no task holds a whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK = 4096


def ema(df: DataFrame, columns: dict[str, tuple[str, int]], key: str = "symbol", at: str = "bar_idx") -> DataFrame:
    """``df`` with recursive averages: name -> (column, span); e = a x + (1 - a) e, from the first x on."""
    fields = [*df.schema.fields, T.StructField("_block", T.LongType())]
    extra = [T.StructField(n, T.DoubleType()) for n in columns] + [T.StructField(f"_{n}", T.DoubleType()) for n in columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        first = pdf["_block"].iloc[0] == 0
        for name, (column, span) in columns.items():
            x, a = pdf[column].to_numpy(float), 2.0 / (span + 1.0)
            out, e = np.empty(len(x)), 0.0
            for i, v in enumerate(x):
                e = v if first and i == 0 else a * v + (1.0 - a) * e
                out[i] = e
            pdf[name] = out
            pdf[f"_{name}"] = (1.0 - a) ** np.arange(1, len(x) + 1)
        return pdf

    blocks = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    local = blocks.groupBy(key, "_block").applyInPandas(run, T.StructType([*fields, *extra]))
    ends = local.groupBy(key, "_block").agg(*[F.max_by(F.struct(F.col(n).alias("e"), F.col(f"_{n}").alias("d")), at).alias(n) for n in columns])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda n: F.aggregate(F.collect_list(n).over(before), F.lit(0.0), lambda c, x: x["e"] + x["d"] * c).alias(f"_in_{n}")
    carried = ends.select(F.col(key), F.col("_block"), *[fold(n) for n in columns])
    out = local.join(carried, [key, "_block"])
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}") * F.col(f"_in_{n}")).alias(n) for n in columns])

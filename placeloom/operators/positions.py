"""Positions in groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that are numbered in one task.
BLOCK = 1 << 16


def numbered(df: DataFrame, key: str, ordinal: str, index: str, count: str, block: int = BLOCK) -> DataFrame:
    """Adds index, from 0 by the integer column ordinal, and count of each row among those of its key; null keys are one key.

    A group is numbered in blocks of ordinals, each in a task of its own, after the counts of the blocks before it:
    a key with a third of all rows is as many tasks.
    """
    rows = df.withColumn("__block", F.floor(F.col(ordinal) / block))
    blocks = rows.groupBy(F.col(key).alias("__key"), "__block").agg(F.count("*").alias("__n"))
    every = Window.partitionBy("__key")
    before = blocks.select("__key", F.col("__block").alias("__b"), (F.sum("__n").over(every.orderBy("__block")) - F.col("__n")).alias("__before"), F.sum("__n").over(every).alias(count))
    own = F.row_number().over(Window.partitionBy(key, "__block").orderBy(ordinal)) - 1
    joined = rows.withColumn("__own", own).join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(index, F.col("__own") + F.col("__before")).drop("__block", "__own", "__key", "__b", "__before")

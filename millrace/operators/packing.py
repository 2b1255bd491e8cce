"""Packing checks into requests in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold


def next_fit(items: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """``items`` with ``batch``, the number of its request: a new one begins where the next item would pass the limit.

    A lone item above the limit is a batch of its own. Null sizes count as 0. The sum begins anew with each batch, so it is a fold.
    """
    rows = items.select(group, order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))

    def step(state: list, row: tuple) -> int:
        if state[0] < 0 or state[1] + row[0] > limit:
            state[0], state[1] = state[0] + 1, row[0]
        else:
            state[1] += row[0]
        return state[0]

    return fold(rows, [group], [order], [size], T.StructField("batch", T.IntegerType()), lambda: [-1, 0], step)


def chunks(items: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """``items`` with ``chunk``: ``most`` items each, in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return items.withColumn("chunk", F.floor((n - 1) / most).cast("int"))


def halves(items: DataFrame, group: str, order: str) -> DataFrame:
    """``items`` with ``half``: 0 for the first n div 2 of a group, 1 for the rest."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    count = items.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return items.withColumn("_r", n).join(count, group).withColumn("half", F.when(F.col("_r") <= F.floor(F.col("_n") / 2), 0).otherwise(1)).drop("_r", "_n")

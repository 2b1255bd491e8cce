"""Recurrences over ordered groups: folds that stream a sorted partition, and running aggregates in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.lineage import keep


def fold(df: DataFrame, group: list[str], order: list[str], inputs: list[str], output: T.StructField, begin: Callable[[], object], step: Callable[[object, tuple], object]) -> DataFrame:
    """``df`` with ``output``: what ``step(state, inputs of the row)`` returns for each row of a group in order; ``begin()`` makes a group's state.

    Rows are hashed by group and sorted within their partition, and a task goes through them batch by batch with one state at a
    time; so a group of any size takes no more memory than a batch.
    """
    schema = T.StructType([*df.schema.fields, output])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(names.index(c)).to_pylist() for c in group)))
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in inputs))
            out = []
            for key, row in zip(keys, rows):
                if key != last:
                    last, state = key, begin()
                out.append(step(state, row))
            kind = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[output.dataType.simpleString()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*names, output.name])

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def running(df: DataFrame, key: str, order: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """``df`` with the running sum or minimum of ``value`` by key in order, without a key's rows in one task.

    Rows are dealt to ranges of (key, order) and written; each range is summed up, the sums of a key's ranges run before them, and a window
    over a range adds what was ahead of it. A row of ``order`` must be unique within its key.
    """
    rows = keep(df.withColumn("_value", value).repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    agg = F.sum if how == "sum" else F.min
    parts = rows.groupBy(key, "_part").agg(agg("_value").alias("_sum"))
    ahead = agg("_sum").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    own = agg("_value").over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_own", own).join(parts.select(key, "_part", ahead.alias("_ahead")), [key, "_part"])
    total = F.col("_own") + F.coalesce("_ahead", F.lit(0)) if how == "sum" else F.least("_own", "_ahead")
    return both.withColumn(name, total).drop("_value", "_part", "_own", "_ahead")

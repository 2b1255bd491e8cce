"""Keyed caches, ledgers and breakers over a stream of events, in their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import running


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert over an append-only table."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def fresh(df: DataFrame, at: str, now: str, ttl_seconds: int) -> DataFrame:
    """Entries not older than the time to live; 0 keeps all."""
    return df if not ttl_seconds else df.filter(F.col(at) >= F.expr(f"timestamp '{now}' - interval {ttl_seconds} seconds"))


def ledger(df: DataFrame, key: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Entries a key's budget admits: all before the first whose running sum passes it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.round(F.sum(cost).over(w), 2)
    rows = df.withColumn("spent", spent)
    over = F.max((F.col("spent") > budget).cast("int")).over(w)
    return rows.withColumn("_over", over).filter("_over = 0").drop("_over")


def breaker(df: DataFrame, signature: list[str], order: list[str], most: int) -> DataFrame:
    """The event of each signature at which the breaker opens: its ``most``-th."""
    n = F.row_number().over(Window.partitionBy(*signature).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") == most).drop("_n")


def running_calibration(df: DataFrame, key: str, order: list[str], size: str, tokens: str) -> DataFrame:
    """The tightest bytes per token seen so far: the running minimum of 0.9 bytes/tokens held within 1 and 8; ``order`` is unique in a key."""
    one = F.greatest(F.lit(1.0), F.least(F.lit(8.0), F.col(size) / F.col(tokens) * 0.9))
    return running(df, key, order, one, "_least", "min").withColumn("bytes_per_token", F.round("_least", 6)).drop("_least")

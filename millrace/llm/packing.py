"""Problem 4: vector best-fit of requests into containers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("body_bytes", "questions", "context_tokens")


def valid_requests(estimates: DataFrame) -> DataFrame:
    """The row of each request with the greatest estimated_at, without unusable ones (body_bytes null or at most 0).

    Ties go to the later arrival, then to the larger row. Null questions count as 0; negative measures as 0. Null
    context_tokens are taken as total_tokens, which bounds them from above (0 where both are null).
    """
    measures = F.struct("model", "body_bytes", "questions", "context_tokens", "total_tokens")
    newest = F.max_by(measures, F.struct("estimated_at", "ingested_at", "body_bytes", "questions", "context_tokens", "total_tokens"))
    rows = estimates.filter("request_id IS NOT NULL").groupBy("request_id").agg(newest.alias("r")).select("request_id", "r.*").filter("body_bytes > 0")
    return rows.select("request_id", "model", "body_bytes", F.greatest(F.coalesce("questions", F.lit(0)), F.lit(0)).alias("questions"), F.greatest(F.coalesce("context_tokens", F.lit(0)), F.lit(0)).alias("context_tokens"), F.when(F.col("context_tokens").isNull(), F.greatest(F.coalesce("total_tokens", F.lit(0)), F.lit(0))).alias("bound"))


def best_fit(sizes: np.ndarray) -> np.ndarray:
    """Bin number of each row of ``sizes``, whose columns are parts of the capacity (each at most 1).

    Rows go in falling order of their largest part. Of the bins with room under every constraint the one whose
    weighted residual norm would be least takes it; the weights are the columns' mean sizes, so the scarcest capacity
    counts most. Without one, a new bin is opened.
    """
    n, d = sizes.shape
    bins = np.empty(n, np.int64)
    if not n:
        return bins
    weight = sizes.mean(axis=0)
    weight = weight / (weight.sum() or 1.0)
    order = np.lexsort((np.arange(n), -(sizes * weight).sum(axis=1), -sizes.max(axis=1)))
    least = sizes[order][::-1]
    least = np.minimum.accumulate(least, axis=0)[::-1]  # the least of each measure still to come
    left, ids, live, opened = np.empty((n, d)), np.empty(n, np.int64), 0, 0
    for k, i in enumerate(order):
        row = sizes[i]
        room = left[:live]
        fits = (room >= row - 1e-12).all(axis=1)
        if fits.any():
            at = np.flatnonzero(fits)
            some = room[at]
            rest = ((some - row) ** 2 * weight).sum(axis=1)
            b = at[int(rest.argmin())]
            left[b] -= row
        else:
            b = live
            left[b], ids[b] = 1.0 - row, opened
            live, opened = live + 1, opened + 1
        bins[i] = ids[b]
        if k + 1 < n and (left[b] < least[k + 1] - 1e-12).any():  # nothing to come fits: the bin is closed
            live -= 1
            left[b], ids[b] = left[live], ids[live]
    return bins


def pack(estimates: DataFrame, limits: DataFrame, shard_rows: int = 4096) -> DataFrame:
    """(model, container_id, request_id, part_no, n_parts, body_bytes, questions, context_tokens) of each part of a request.

    A request above a capacity is cut into the fewest equal parts that fit (a measure's remainder goes to the first
    parts); all others are one part in one container. A context bound that stands for a null is never cut for: it is
    lowered to the capacity. Requests of models without limits, or with a null or non-positive one, can't be packed and are left out.

    Each model's parts are dealt to seeded shards of about ``shard_rows``, every shard a mixture of all sizes, and each
    shard is packed on its own; so no model, however large, sits in one task, and a shard costs at most one
    badly filled container in a few hundred.
    """
    room = limits.filter("max_body_bytes > 0 AND max_questions > 0 AND max_context_tokens > 0").groupBy("model").agg(F.min(F.struct("max_body_bytes", "max_questions", "max_context_tokens")).alias("m")).select("model", "m.*")
    rows = valid_requests(estimates).join(F.broadcast(room), "model")  # one row a model
    context = F.coalesce(F.least("bound", "max_context_tokens"), "context_tokens")
    rows = rows.withColumn("context_tokens", context)
    parts = F.greatest(*(F.ceil(F.col(c) / F.col(f"max_{c}")) for c in DIMENSIONS), F.lit(1)).cast("int")
    rows = rows.withColumn("n_parts", parts).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    share = [(F.expr(f"{c} div n_parts") + F.when(F.col("part_no") < F.expr(f"{c} % n_parts"), 1).otherwise(0)).cast("bigint").alias(c) for c in DIMENSIONS]
    rows = rows.select("model", "request_id", "part_no", "n_parts", *share, *(f"max_{c}" for c in DIMENSIONS))
    counts = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).withColumn("n_shards", F.ceil(F.col("n") / shard_rows)).select("model", "n_shards")
    rows = rows.join(F.broadcast(counts), "model").withColumn("shard", F.pmod(F.xxhash64("request_id", "part_no"), F.col("n_shards")).cast("int")).drop("n_shards")
    keep = ["request_id", "part_no", "n_parts", *DIMENSIONS]
    schema = "model STRING, container_id STRING, request_id BIGINT, part_no INT, n_parts INT, body_bytes BIGINT, questions BIGINT, context_tokens BIGINT"

    def shard(key, table):
        table = table.take(pa.array(np.lexsort((table["part_no"].to_numpy(), table["request_id"].to_numpy()))))
        sizes = np.column_stack([table[c].to_numpy() / table[f"max_{c}"].to_numpy() for c in DIMENSIONS])
        bins = best_fit(sizes)
        model, number = key[0].as_py(), key[1].as_py()
        names = pa.array([f"{model}/{number}/{b}" for b in bins.tolist()], pa.string())
        return pa.table({"model": pa.array([model] * len(names), pa.string()), "container_id": names, **{c: table[c] for c in keep}})

    return rows.groupBy("model", "shard").applyInArrow(shard, schema)


def packing_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per model: parts, containers, the bound no packing can go below, and the share of each capacity used."""
    used = packed.groupBy("model").agg(F.count(F.lit(1)).alias("n_parts"), F.countDistinct("container_id").alias("n_containers"), *(F.sum(c).alias(c) for c in DIMENSIONS))
    both = used.join(F.broadcast(limits), "model")
    bound = F.greatest(*(F.ceil(F.col(c) / F.col(f"max_{c}")) for c in DIMENSIONS))
    return both.select("model", "n_parts", "n_containers", bound.alias("least_containers"), *((F.col(c) / (F.col("n_containers") * F.col(f"max_{c}"))).alias(f"{c}_used") for c in DIMENSIONS))


def packing_check(estimates: DataFrame, limits: DataFrame) -> DataFrame:
    """(request_id, body_bytes, questions, n_parts, fits): of each packed request, what its parts add up to, how many they are, and
    whether all their containers keep every limit and hold one model."""
    packed = pack(estimates, limits)
    room = limits.groupBy("model").agg(F.min(F.struct("max_body_bytes", "max_questions", "max_context_tokens")).alias("m")).select("model", "m.*")
    full = packed.groupBy("container_id").agg(F.min("model").alias("model"), F.countDistinct("model").alias("n"), *(F.sum(c).alias(c) for c in DIMENSIONS)).join(F.broadcast(room), "model")  # one row a model
    ok = full.select("container_id", ((F.col("n") == 1) & (F.col("body_bytes") <= F.col("max_body_bytes")) & (F.col("questions") <= F.col("max_questions")) & (F.col("context_tokens") <= F.col("max_context_tokens"))).alias("ok"))
    parts = packed.select("request_id", "container_id", "part_no", "body_bytes", "questions").join(ok, "container_id")
    return parts.groupBy("request_id").agg(F.sum("body_bytes").alias("body_bytes"), F.sum("questions").alias("questions"), F.countDistinct("part_no").alias("n_parts"), F.min("ok").alias("fits"))

"""What becomes of requests that don't fit: halves, probes, compacted evidence and a last attempt, as rounds over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut

from .planning import BYTES_PER_TOKEN, RESERVE


def preflight(over: Column, n: Column) -> Column:
    """struct<reason, action> of a request from the limits it passes: sent, halved, or recovered where its context is too large or it is one question."""
    context, any_ = F.array_contains(over, "context"), F.size(over) > 0
    reason = F.when(context, "model_context_preflight").when(any_, "request_limit_preflight")
    action = F.when(~any_, "send").when(context | (n == 1), "recover").otherwise("halves")
    return F.struct(reason.alias("reason"), action.alias("action"))


def provider_split(asked: DataFrame, group: list[str], order: str, size: str) -> DataFrame:
    """``asked`` with ``part``: 0 for the shortest question of a rejected request, which is probed alone, 1 and 2 for the halves of the rest in order."""
    shortest = F.row_number().over(Window.partitionBy(*group).orderBy(size, order)) == 1
    rows = asked.withColumn("_probe", shortest)
    nth = F.row_number().over(Window.partitionBy(*group, "_probe").orderBy(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group, "_probe"))
    return rows.withColumn("part", F.when(F.col("_probe"), 0).when(nth <= F.floor((n + 1) / 2), 1).otherwise(2)).drop("_probe")


def blocked(requests: DataFrame, rejected: DataFrame, group: list[str], size: str) -> DataFrame:
    """(group, least, blocked): the size of the smallest question known to be rejected with the same evidence, and whether all questions of the
    request are at least as large, so that sending it is no use."""
    least = rejected.groupBy("evidence").agg(F.min(size).alias("least"))
    own = requests.groupBy(*group).agg(F.min(size).alias("_smallest"))
    return own.join(least, "evidence", "left").select(*group, "least", F.coalesce(F.col("_smallest") >= F.col("least"), F.lit(False)).alias("blocked"))


def round_budget(base_tokens: int, limit_bytes: int, number: Column, previous: Column) -> Column:
    """struct<tokens, bytes> compacted evidence may take in a round: half the tokens of the round before, at least 1,024, and seven tenths of the bytes."""
    tokens = F.greatest(F.lit(1024), F.floor(F.lit(base_tokens) / F.pow(F.lit(2), number)))
    return F.struct(tokens.cast("bigint").alias("tokens"), F.least(F.lit(limit_bytes), F.floor(previous * 7 / 10)).cast("bigint").alias("bytes"))


def recover(asked: DataFrame, fixed: int, context: int, total: int, most_bytes: int, questions: int, provider_bytes: int, max_rounds: int = 3) -> DataFrame:
    """(check_id, evidence, scope, path, outcome, rounds, state): what each check comes to.

    ``asked`` has evidence, scope, path, check_id, tokens, bytes, state and ``bare``, the bytes of the target alone; a request is an evidence and
    scope. In each step all pending requests are looked at together: those within the limits are sent, and answered unless their state is above
    ``provider_bytes``; those over another limit than context are halved; rejected ones with several questions are split into a probe and
    halves; the others go on one by one with evidence compacted to the budget of the round, after ``max_rounds`` with the bare target, and are
    omitted where that doesn't fit either. Steps are written to the checkpoint folder; requests shrink in each, so they end.
    """
    c = F.col
    start = F.concat_ws("|", "evidence", "scope")
    pending = cut(asked.select("evidence", "scope", "path", "check_id", c("tokens").cast("bigint").alias("tokens"), c("bytes").cast("bigint").alias("bytes"), c("state").cast("bigint").alias("state"), c("bare").cast("bigint").alias("bare"), start.alias("attempt"), F.lit(0).alias("round"), F.lit(False).alias("final"), F.lit(False).alias("parted")))
    done: list[DataFrame] = []
    out = ["path", "evidence", "scope", "check_id", "outcome", c("round").alias("rounds"), "state"]
    while not pending.isEmpty():
        per = pending.groupBy("attempt").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("longest"), F.sum("tokens").alias("sum"), F.sum("bytes").alias("size"))
        rows = pending.join(per, "attempt")
        base = F.ceil((c("state") + fixed) / BYTES_PER_TOKEN) + RESERVE
        deep = base + c("longest") > context
        wide = (c("n") > questions) | (base + c("sum") > total) | (c("state") + fixed + c("size") + c("n") - 1 > most_bytes)
        rejected = ~deep & ~wide & (c("state") > provider_bytes)
        action = F.when(~deep & ~wide & ~rejected, "answered").when(wide & ~deep & (c("n") > 1), "halves").when(rejected & (c("n") > 1), "split").when(c("final"), "omitted").when(c("round") >= max_rounds, "bare").otherwise("compact")
        rows = cut(rows.withColumn("action", action))
        outcome = F.when(c("action") == "omitted", "omitted").when(c("final"), "final").when(c("round") > 0, "compacted").when(c("parted"), "split").otherwise("direct")
        done.append(rows.filter("action IN ('answered', 'omitted')").withColumn("outcome", outcome).select(*out))
        go = rows.filter("action NOT IN ('answered', 'omitted')")
        parts = provider_split(go.filter("action = 'split'"), ["attempt"], "check_id", "bytes")
        nth = F.row_number().over(Window.partitionBy("attempt").orderBy("check_id"))
        halves = go.filter("action = 'halves'").withColumn("part", F.when(nth <= F.floor(c("n") / 2), 1).otherwise(2))
        alone = go.filter("action IN ('compact', 'bare')").withColumn("part", F.lit(0))
        once = c("action").isin("compact", "bare")
        bare = c("action") == "bare"
        after = alone.unionByName(halves).unionByName(parts)
        budget = round_budget(context, most_bytes, c("round") + 1, c("state"))
        small = F.greatest(F.least(budget.bytes, (budget.tokens * BYTES_PER_TOKEN).cast("bigint")), F.lit(1))
        pending = cut(after.select(
            "evidence", "scope", "path", "check_id", "tokens", "bytes", F.when(bare, F.least("state", "bare")).when(once, F.least("state", small)).otherwise(c("state")).alias("state"), "bare",
            F.concat("attempt", F.lit("|"), F.when(once, c("check_id")).otherwise(c("part").cast("string"))).alias("attempt"), (c("round") + F.when(once & ~bare, 1).otherwise(0)).alias("round"), (c("final") | bare).alias("final"), (c("parted") | ~once).alias("parted"),
        ))
    result = done[0] if done else pending.withColumn("outcome", F.lit("")).select(*out)
    for more in done[1:]:
        result = result.unionByName(more)
    return result

"""Problem 9: a mix of sources at target weights, by Sainte-Laguë apportionment of token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut

from .encoding import count_tokens
from .tokenizer import DEFAULT_VOCABULARY


def clean_source(column):
    """A source's name without case and outer blanks; null and blank become null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), F.lit(""))


def highest_quotients(seats: int, votes: dict, caps: dict) -> dict:
    """Sainte-Laguë: each of ``seats`` goes to the highest quotient votes / (2 held + 1) among those under their cap.

    The seats below a common divisor are given at once (found by bisection), the last few one by one, so the work
    doesn't grow with the number of seats. Ties go to the first name in order. Seats beyond all caps stay free.
    """
    names = sorted(k for k in votes if votes[k] > 0 and caps.get(k, 0) > 0)
    held = dict.fromkeys(votes, 0)
    seats = min(seats, sum(int(caps[k]) for k in names))

    def at(divisor: float) -> dict:
        return {k: min(int(caps[k]), int(votes[k] / divisor + 0.5)) for k in names}

    if not names or seats <= 0:
        return held
    low, high = min(votes[k] for k in names) / (2 * seats + 2 * sum(int(caps[k]) for k in names)), 2.0 * sum(votes.values()) + 1
    for _ in range(200):  # at ``low`` all caps are met, at ``high`` nothing is given
        middle = (low * high) ** 0.5
        if sum(at(middle).values()) > seats:
            low = middle
        else:
            high = middle
    held |= at(high)
    for _ in range(seats - sum(held.values())):
        best = max((k for k in names if held[k] < int(caps[k])), key=lambda k: votes[k] / (2 * held[k] + 1))
        held[best] += 1
    return held


def mix(documents: DataFrame, targets: DataFrame, seed: int = 9, block_tokens: int = 256, shard_tokens: int = 2_000_000, most_shards: int = 4096, path: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, copies) of the documents with at least one copy, and the report of shares.

    The mix has the tokens of all documents, those of sources without a target included, unless the caps forbid it. Blocks of equal
    tokens go to sources by highest quotients under cap ``max_repeats`` times the source's own tokens; what a capped
    source can't take goes to the others by their shares. Each source's blocks are then apportioned in the same way to its seeded shards
    (of about ``shard_tokens``, ``most_shards`` at most, so the driver holds a bounded table). In a shard every document is used ``quota
    div size`` times; for the remainder the shard's documents, in seeded order, are cut into blocks of equal tokens, blocks are drawn
    in a second seeded order until the quota is met, and their documents are used once more; of the last block as many as come nearest.

    Null and empty texts have no tokens and are never chosen; a source that is null or has no target takes no part; a
    target without documents gets nothing; null or negative shares and repeats count as 0; repeats of a target's row count once.
    """
    spark = documents.sparkSession
    wanted = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    sized = cut(count_tokens(documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text"), path=path))
    per_source = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).join(F.broadcast(wanted), "source", "left_semi").collect()}  # one row a target
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    goal = {r.source: (max(0.0, r.share or 0.0), max(0, r.repeats or 0)) for r in wanted.filter("source IS NOT NULL").collect()}
    block = max(1, min(block_tokens, total // 1000 or 1))
    caps = {k: per_source.get(k, 0) * r // block for k, (_, r) in goal.items()}
    quota = highest_quotients(total // block, {k: s for k, (s, _) in goal.items()}, caps)

    shards = {k: min(most_shards, max(1, -(-per_source.get(k, 0) // shard_tokens))) for k in goal}
    if not goal:
        sized, shards = sized.limit(0), {"": 1}
    n_shards = F.element_at(F.create_map(*(F.lit(x) for kv in shards.items() for x in kv)), F.col("source"))
    own = sized.filter(F.col("source").isin(list(shards)) & (F.col("tokens") > 0))
    own = own.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("shard", F.pmod("h", n_shards))
    sizes: dict[str, dict[int, int]] = {}
    for r in own.groupBy("source", "shard").agg(F.sum("tokens").alias("size")).collect():  # at most ``most_shards`` a target
        sizes.setdefault(r.source, {})[r.shard] = r["size"]
    quotas = []
    for k, of in sizes.items():
        repeats = goal[k][1]
        given = highest_quotients(quota[k], of, {shard: n * repeats // block for shard, n in of.items()})
        quotas += [(k, shard, repeats, given[shard] * block // n, given[shard] * block % n) for shard, n in of.items()]
    quotas = spark.createDataFrame(quotas, "source STRING, shard BIGINT, repeats INT, base BIGINT, extra BIGINT")
    laid = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "tokens")
    at = own.join(F.broadcast(quotas), ["source", "shard"]).withColumn("upto", F.sum("tokens").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("block", F.floor((F.col("upto") - F.col("tokens") / 2) / block))
    drawn = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block", "h", "doc_id", "tokens")
    at = at.withColumn("drawn", F.sum("tokens").over(drawn.rowsBetween(Window.unboundedPreceding, 0)))
    once_more = (F.col("drawn") - F.col("tokens") / 2 <= F.col("extra")) & (F.col("base") < F.col("repeats"))
    chosen = at.select("doc_id", "source", "tokens", (F.col("base") + F.when(once_more, 1).otherwise(0)).cast("int").alias("copies")).filter("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    report = wanted.filter("source IS NOT NULL").join(used, "source", "left")
    mixed = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())  # one row a target
    report = report.select("source", F.col("share").alias("target_share"), F.try_divide(F.coalesce("tokens", F.lit(0)), mixed).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.col("repeats").alias("max_repeats"))
    return chosen, report


def caps_check(chosen: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: whether all its chosen documents are its own and used at least once and ``max_repeats`` times at most, each in one row."""
    own = documents.select("doc_id", clean_source(F.col("source")).alias("of")).distinct()
    goal = targets.select(clean_source(F.col("source")).alias("source"), "max_repeats").groupBy("source").agg(F.max("max_repeats").alias("most"))
    per = chosen.join(own, "doc_id", "left").join(F.broadcast(goal), "source")  # one row a target
    right = F.coalesce((F.col("of") == F.col("source")) & F.col("copies").between(1, F.col("most")), F.lit(False))
    per = per.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(right).alias("ok")).groupBy("source").agg(F.min(F.col("ok") & (F.col("n") == 1)).alias("ok"))
    return goal.join(per, "source", "left").filter("source IS NOT NULL").select("source", F.coalesce("ok", F.lit(True)).alias("kept"))

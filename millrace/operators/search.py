"""The search for thresholds: candidates around a baseline policy, their metrics over development cases, and the choice with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.assessment import POLICY_FIELDS, probability
from millrace.plans.lineage import keep

from .replay import assessed, count, utility

SEARCHED = ["warning_p", "warning_c", "warning_s", "warning_levels"]


def with_policy(records: DataFrame, policies: DataFrame) -> DataFrame:
    """Records with the policy struct of their rule; ``policies`` has one row a rule."""
    return records.join(F.broadcast(policies.select("rule_id", F.struct(*POLICY_FIELDS).alias("policy"))), "rule_id")


def dimensions(records: DataFrame, policies: DataFrame, least: float = 0.0, most: float = 2.0) -> DataFrame:
    """(rule_id, dim, value, levels) of all values to try: 1 probability, 2 confidence, 3 score, 4 levels of a mass.

    Probabilities and confidences: those observed, 0, 1, and what warning and error ask for now; scores: the levels of the scale, those observed
    within it, and the declared ones; levels: every run of adjacent ones. Only warnings are searched, and values at which the
    warning would be stricter than the error are left out.
    """
    rows = with_policy(records, policies)
    p = lambda name: F.col(f"policy.{name}")
    own = policies.select("rule_id", F.struct(*POLICY_FIELDS).alias("policy"))
    number = lambda dim, value: (F.lit(dim).alias("dim"), value.alias("value"))
    fixed = lambda *names: F.explode(F.array(*map(F.lit, (0.0, 1.0)), *map(p, names)))
    by_p, by_c = p("warning_p").isNotNull(), p("warning_c").isNotNull()
    by_s = (p("type") == "score") & p("warning_s").isNotNull() & (F.size(p("warning_levels")) == 0)
    mass = (p("type") == "score") & (F.size(p("warning_levels")) > 0)
    seen = [
        rows.filter(by_p).select("rule_id", *number(1, probability("answer", "policy", "warning_levels"))),
        rows.filter(by_p & mass).select("rule_id", *number(1, probability("answer", "policy", "error_levels"))),
        own.filter(by_p).select("rule_id", *number(1, fixed("warning_p", "error_p"))),
        rows.filter(by_c & F.col("answer.type").isin("choice", "score")).select("rule_id", *number(2, F.col("answer.confidence"))),
        own.filter(by_c).select("rule_id", *number(2, fixed("warning_c", "error_c"))),
        rows.filter(by_s & F.col("answer.score").between(least, most)).select("rule_id", *number(3, F.col("answer.score"))),
        own.filter(by_s).select("rule_id", *number(3, F.explode(F.array(*(F.lit(float(x)) for x in range(int(least), int(most) + 1)), p("warning_s"), p("error_s"))))),
    ]
    values = seen[0]
    for more in seen[1:]:
        values = values.unionByName(more)
    values = values.filter("value IS NOT NULL").distinct().join(F.broadcast(own), "rule_id")
    strict = F.when(F.col("dim") == 1, p("error_p").isNull() | (F.col("value") <= p("error_p"))).when(F.col("dim") == 2, p("error_c").isNull() | (F.col("value") <= p("error_c")))
    strict = strict.otherwise(p("error_s").isNull() | F.when(p("descending"), F.col("value") >= p("error_s")).otherwise(F.col("value") <= p("error_s")))
    base = F.when(F.col("dim") == 1, p("warning_p")).when(F.col("dim") == 2, p("warning_c")).otherwise(p("warning_s"))
    numbers = values.filter(strict).select("rule_id", "dim", "value", F.lit(None).cast("array<string>").alias("levels"), F.round(F.abs(F.col("value") - base), 9).alias("far"))
    n = F.size(p("warning_levels"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.slice(p("warning_levels"), i, k))))
    levels = own.filter(mass).select("rule_id", "policy", F.explode(runs).alias("levels")).filter(F.size(F.array_except(p("error_levels"), "levels")) == 0)
    levels = levels.select("rule_id", F.lit(4).alias("dim"), F.lit(None).cast("double").alias("value"), "levels", (n - F.size("levels")).cast("double").alias("far"))
    return numbers.unionByName(levels)


def _width(limit: int, streams: Column) -> Column:
    return F.lit(1) if limit == 1 else F.greatest(F.lit(2), F.floor(F.lit(limit) / F.greatest(F.lit(1), 2 * streams)))


def candidates(records: DataFrame, policies: DataFrame, limit: int = 4096) -> DataFrame:
    """(rule_id, place, warning_p, warning_c, warning_s, warning_levels, truncated): the policies to try for each rule, the baseline first.

    Each dimension alone, nearest the baseline first, then each pair of dimensions, the streams taken in turn, each policy once, ``limit``
    in all: the search's budget, as a parameter. ``truncated`` tells whether it left anything out. A dimension keeps the values nearest
    the baseline by a limit that Spark applies before the shuffle, so a rule with a third of all cases sends no more of them than others.
    """
    dims = keep(dimensions(records, policies))
    sizes = dims.groupBy("rule_id", "dim").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_dims"), F.max("n").alias("n_max"))
    pairs_of = (F.col("n_dims") * (F.col("n_dims") - 1) / 2).cast("int")
    shape = shape.select("rule_id", "n_dims", "n_max", _width(limit, F.col("n_dims")).alias("single"), _width(limit, pairs_of).alias("double"))
    near = Window.partitionBy("rule_id", "dim").orderBy("far", "value", F.concat_ws(",", "levels"))
    ranked = keep(dims.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= limit)).join(F.broadcast(sizes), ["rule_id", "dim"]).join(F.broadcast(shape), "rule_id")  # four dimensions a rule
    base = policies.select("rule_id", *(F.col(c).alias(f"_{c}") for c in SEARCHED))

    def changed(rows: DataFrame, of: dict[int, tuple[Column, Column, Column]]) -> list[Column]:
        out = []
        for dim, name in enumerate(SEARCHED, 1):
            value = F.col(f"_{name}")
            for d, number, levels in of.values():
                value = F.when(d == dim, levels if dim == 4 else number).otherwise(value)
            out.append(value.alias(name))
        return out

    single = ranked.filter(F.col("rank") <= F.col("single")).join(F.broadcast(base), "rule_id")
    single = single.select("rule_id", F.lit(1).alias("phase"), "rank", F.col("dim").alias("stream"), *changed(single, {0: (F.col("dim"), F.col("value"), F.col("levels"))}))
    left = ranked.select("rule_id", F.col("dim").alias("d1"), F.col("value").alias("v1"), F.col("levels").alias("l1"), F.col("rank").alias("r1"))
    right = ranked.select("rule_id", F.col("dim").alias("d2"), F.col("value").alias("v2"), F.col("levels").alias("l2"), F.col("rank").alias("r2"), F.col("n").alias("n2"), "double")
    # of a pair's values, left ones in the outer turn, only those within its width can come in: at most about twice the width
    both = left.join(right, "rule_id").filter("d1 < d2 AND r2 <= double AND (r1 - 1) * n2 + r2 <= double").join(F.broadcast(base), "rule_id")
    both = both.select("rule_id", F.lit(2).alias("phase"), ((F.col("r1") - 1) * F.col("n2") + F.col("r2")).cast("int").alias("rank"), (F.col("d1") * 10 + F.col("d2")).alias("stream"), *changed(both, {0: (F.col("d1"), F.col("v1"), F.col("l1")), 1: (F.col("d2"), F.col("v2"), F.col("l2"))}))
    first = policies.join(shape.select("rule_id"), "rule_id", "left_semi").select("rule_id", F.lit(0).alias("phase"), F.lit(0).alias("rank"), F.lit(0).alias("stream"), *SEARCHED)
    every = first.unionByName(single).unionByName(both).groupBy("rule_id", *SEARCHED).agg(F.min(F.struct("phase", "rank", "stream")).alias("at"))
    place = F.row_number().over(Window.partitionBy("rule_id").orderBy("at")) - 1  # at most a few times ``limit`` rows a rule
    placed = every.withColumn("place", place).withColumn("n_all", F.count(F.lit(1)).over(Window.partitionBy("rule_id")))
    wide = sizes.alias("x").join(sizes.alias("y"), F.expr("x.rule_id = y.rule_id AND x.dim < y.dim")).groupBy("x.rule_id").agg(F.max(F.expr("x.n * y.n")).alias("n_pairs"))
    cut = shape.join(wide, "rule_id", "left").select("rule_id", ((F.col("n_max") > F.col("single")) | (F.coalesce("n_pairs", F.lit(0)) > F.col("double")) | (F.col("n_dims") > 2)).alias("cut"))
    return keep(placed.filter(F.col("place") < limit).join(F.broadcast(cut), "rule_id").select("rule_id", "place", *SEARCHED, (F.col("cut") | (F.col("n_all") >= limit)).alias("truncated")))


def metrics(records: DataFrame, policies: DataFrame, tried: DataFrame) -> DataFrame:
    """Per rule and candidate: outcomes by label, the utility of the cases, each over the size of its support group, and the recall of groups.

    Every candidate is judged by the same classification as a replay. The candidates are broadcast (``limit`` a rule), so the cases stay
    where they are and only sums by candidate, and by candidate and group, are shuffled.
    """
    sizes = records.filter("support IS NOT NULL").groupBy("rule_id", "support").agg(F.count(F.lit(1)).alias("size"))
    rows = with_policy(records, policies).join(sizes, ["rule_id", "support"], "left")
    # a case becomes thousands of rows, so few cases are worth many tasks: their number is fixed, or adaptive execution would join small parts again
    rows = rows.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id").join(F.broadcast(tried.select("rule_id", "place", *SEARCHED)), "rule_id")
    rows = rows.withColumn("policy", F.struct(*(F.col(c) if c in SEARCHED else F.col(f"policy.{c}").alias(c) for c in POLICY_FIELDS)))
    rows = assessed(rows, "place", "size")
    tentative = F.col("signal") & ~F.col("confirmed")
    by_group = rows.groupBy("rule_id", "place", "support").agg(
        F.sum(F.when(F.col("support").isNotNull(), utility(F.col("label"), F.col("confirmed"), F.col("signal")) / F.col("size"))).alias("u"),
        F.count(F.lit(1)).alias("n"), *(count(F.col("label") == x).alias(x) for x in ("Agree", "Partial", "Disagree")),
        *(count((F.col("label") == x) & c).alias(f"{x}_{name}") for x in ("Agree", "Partial", "Disagree") for name, c in (("confirmed", F.col("confirmed")), ("tentative", tentative))),
    )
    known = F.col("support").isNotNull()
    total = lambda name: F.sum(name).alias(name.lower())
    out = by_group.groupBy("rule_id", "place").agg(
        F.round(F.coalesce(F.sum("u"), F.lit(0.0)), 9).alias("objective"), total("n"), total("Agree"), total("Partial"), total("Disagree"),
        *(total(f"{x}_{k}") for x in ("Agree", "Partial", "Disagree") for k in ("confirmed", "tentative")),
        count(known & (F.col("Agree") > 0)).alias("positive_groups"), count(known & (F.col("Disagree") > 0)).alias("negative_groups"),
        count(known & (F.col("Agree_confirmed") + F.col("Agree_tentative") > 0)).alias("retained_groups"),
    )
    recall = F.round(F.try_divide("retained_groups", "positive_groups"), 9)
    return out.withColumn("recall", recall).drop("retained_groups")


def choose(scored: DataFrame, tried: DataFrame, policies: DataFrame, min_positive: int = 1, min_negative: int = 1, min_recall: float | None = None) -> DataFrame:
    """Per rule the candidate chosen, and why: ``selected``, or the reason the baseline stays.

    Eligible are candidates with any signal on agreed cases (where there are such cases) and a recall not below ``min_recall``. The greatest
    objective wins; ties go to the baseline, then to the fewest changes, then to the greatest thresholds in the order of their dimensions.
    """
    base = policies.select("rule_id", *(F.col(c).alias(f"_{c}") for c in SEARCHED))
    rows = scored.join(F.broadcast(tried), ["rule_id", "place"]).join(F.broadcast(base), "rule_id")
    changes = sum(((~F.col(c).eqNullSafe(F.col(f"_{c}"))).cast("int") for c in SEARCHED[:3]), F.lit(0))
    changes = changes + F.size(F.array_except("_warning_levels", "warning_levels")) + F.size(F.array_except("warning_levels", "_warning_levels"))
    signals = F.col("agree_confirmed") + F.col("agree_tentative") > 0
    recalled = F.lit(True) if min_recall is None else F.coalesce(F.col("recall") >= min_recall, F.lit(False))
    able = (signals | (F.col("agree") == 0)) & recalled
    order = F.struct("objective", (F.col("place") == 0).alias("is_baseline"), (-changes).alias("changes"), *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in SEARCHED[:3]), F.size("warning_levels").alias("n_levels"))
    chosen = F.struct("place", "objective", *SEARCHED)
    best = rows.groupBy("rule_id").agg(
        F.max_by(F.when(able, chosen), F.when(able, order)).alias("best"), F.max(F.when(F.col("place") == 0, F.struct(*chosen_fields(), "positive_groups", "negative_groups", "agree"))).alias("base"),
        F.max(signals).alias("any_signal"), F.max(able).alias("any_able"), F.max("truncated").alias("truncated"), F.count(F.lit(1)).alias("n_tried"),
    )
    few = (F.col("base.positive_groups") < min_positive) | (F.col("base.negative_groups") < min_negative)
    reason = F.when(few, "insufficient_labeled_support").when((F.col("base.agree") > 0) & ~F.col("any_signal"), "no_positive_signal_candidate")
    reason = reason.when(F.lit(min_recall is not None) & ~F.col("any_able"), "no_candidate_meets_review_list_recall").otherwise("selected")
    best = best.withColumn("reason", reason)
    pick = lambda name: F.when(F.col("reason") == "selected", F.col(f"best.{name}")).otherwise(F.col(f"base.{name}")).alias(name)
    return best.select("rule_id", "reason", *map(pick, ("place", "objective", *SEARCHED)), F.col("base.objective").alias("baseline_objective"), "n_tried", "truncated")


def chosen_fields() -> list[str]:
    return ["place", "objective", *SEARCHED]

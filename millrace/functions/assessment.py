"""Classification of a typed probabilistic answer against a reporting policy, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The policy of each type of answer used where a rule has none of its own.
DEFAULTS = [
    ("boolean", True, 0.4, 0.6, 0.71, None, 0.9, None, None, None, [], [], [], [], [], False),
    ("choice", True, None, None, 0.6, 0.45, 0.92, 0.7, None, None, [], [], ["lost"], ["unclear"], [], False),
    ("score", True, None, None, None, 0.6, None, 0.7, 1.0, 2.0, [], [], [], [], [], False),
]
POLICY = (
    "type STRING, expected BOOLEAN, low DOUBLE, high DOUBLE, warning_p DOUBLE, warning_c DOUBLE, error_p DOUBLE, error_c DOUBLE, warning_s DOUBLE, error_s DOUBLE, "
    "warning_levels ARRAY<STRING>, error_levels ARRAY<STRING>, defect ARRAY<STRING>, uncertain ARRAY<STRING>, inapplicable ARRAY<STRING>, descending BOOLEAN"
)
POLICY_FIELDS = [x.split()[0] for x in POLICY.split(", ")]


def policies(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Policies by type of answer: one row each, so the join with answers is a broadcast of three rows."""
    return spark.createDataFrame(rows or DEFAULTS, POLICY)


def level_mass(probabilities: Column, levels: Column) -> Column:
    """The probability that lies on some levels of a scale; levels without a probability count as 0."""
    return F.aggregate(levels, F.lit(0.0), lambda acc, level: acc + F.coalesce(F.try_element_at(probabilities, level), F.lit(0.0)))


def probability(answer: str, policy: str, levels: str) -> Column:
    """What a policy reads from an answer: p or 1 - p, the probability of the choice, or the mass on some levels."""
    a, p = (lambda f: F.col(f"{answer}.{f}")), (lambda f: F.col(f"{policy}.{f}"))
    chosen = F.try_element_at(a("probabilities"), a("choice"))
    boolean = F.when(p("expected"), a("noul")).otherwise(1 - a("noul"))
    return F.when(a("type") == "boolean", boolean).when(a("type") == "choice", chosen).otherwise(level_mass(a("probabilities"), p(levels)))


def assess(answer: str = "answer", policy: str = "policy", complete: str = "context_complete") -> Column:
    """struct<status, reason, severity, tentative> of an answer struct under a policy struct.

    A strong signal with too little confidence stays tentative at its own severity and never becomes a weaker finding. A null
    confidence is too little for a signal; without a signal only a known one can be. Null probabilities and scores give no
    signal; a null ``complete`` counts as not complete. ``descending`` turns the score gates round: at most instead of at least.
    """
    a, p = (lambda f: F.col(f"{answer}.{f}")), (lambda f: F.col(f"{policy}.{f}"))
    chosen = F.try_element_at(a("probabilities"), a("choice"))
    boolean, choice = a("type") == "boolean", a("type") == "choice"
    eligible = F.when(choice, F.array_contains(p("defect"), a("choice"))).otherwise(True)
    ambiguous = F.coalesce(boolean & (a("noul") >= p("low")) & (a("noul") < p("high")), F.lit(False))

    def signal(name: str) -> Column:
        gate = F.col(f"{policy}.{name}_s")
        by_score = F.when(F.coalesce(p("descending"), F.lit(False)), a("score") <= gate).otherwise(a("score") >= gate)
        hit = F.when(F.col(f"{policy}.{name}_p").isNotNull(), probability(answer, policy, f"{name}_levels") >= p(f"{name}_p")).otherwise(by_score)
        return F.coalesce(eligible & hit, F.lit(False))

    def unsure(name: str) -> Column:
        return F.coalesce(a("confidence") < p(f"{name}_c"), F.lit(False))

    def outcome(status, reason, severity=None, tentative=None) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        return F.struct(lit(status).alias("status"), lit(reason).alias("reason"), lit(severity).alias("severity"), lit(tentative).alias("tentative"))

    result = F.when(choice & F.coalesce(F.array_contains(p("uncertain"), a("choice")), F.lit(False)), outcome("unknown", "missing_evidence"))
    for name in ("error", "warning"):
        reason = F.when(unsure(name) | (p(f"{name}_c").isNotNull() & a("confidence").isNull()), "low_confidence").when(ambiguous, "probability_ambiguous")
        result = result.when(signal(name), F.when(reason.isNull(), outcome(name, None, name)).otherwise(outcome("unknown", reason, None, name)))
    left = F.when(ambiguous, "probability_ambiguous").when(unsure("warning"), "low_confidence")
    left = left.when(choice & (chosen < p("warning_p")), "low_choice_probability").when(choice & eligible, "weak_defect_signal")
    rest = F.when(left.isNotNull(), outcome("unknown", left)).when(~F.coalesce(F.col(complete), F.lit(False)), outcome("unknown", "reduced_context"))
    rest = rest.when(choice & F.coalesce(F.array_contains(p("inapplicable"), a("choice")), F.lit(False)), outcome("not_applicable", "rule_not_applicable"))
    return result.otherwise(rest.otherwise(outcome("ok", None)))

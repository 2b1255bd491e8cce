"""A catalogue of rules as a table: what each asks, when it applies, and its reporting policy; and the same table as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.assessment import POLICY, POLICY_FIELDS

# Reporting policies by rule, one of each kind a policy can be.
#   rule, type, expected, low, high, warning_p, warning_c, error_p, error_c, warning_s, error_s, warning_levels, error_levels, defect, uncertain, inapplicable, descending
POLICIES = [
    ("QRY01", "score", True, None, None, None, 0.6, None, 0.7, 1.0, 2.0, [], [], [], [], [], False),
    ("QRY02", "choice", True, None, None, 0.6, 0.45, 0.92, 0.7, None, None, [], [], ["lost"], ["unclear"], [], False),
    ("QRY03", "boolean", True, 0.4, 0.6, 0.71, None, 0.9, None, None, None, [], [], [], [], [], False),
    ("QRY04", "boolean", False, 0.4, 0.6, 0.71, None, 0.9, None, None, None, [], [], [], [], [], False),
    ("QRY05", "score", True, None, None, None, 0.6, None, 0.7, 2.0, 1.0, [], [], [], [], [], True),
    ("QRY06", "choice", True, None, None, 0.3, 0.45, 0.6, 0.5, None, None, [], [], ["lost"], [], ["kept"], False),
    ("QRY07", "boolean", True, None, None, 0.5, None, 0.85, None, None, None, [], [], [], [], [], False),
    ("QRY08", "boolean", True, 0.3, 0.8, 0.6, None, 0.95, None, None, None, [], [], [], [], [], False),
    ("QRY09", "score", True, None, None, 0.6, 0.3, 0.5, 0.4, None, None, ["1", "2"], ["2"], [], [], [], False),
    ("QRY10", "choice", True, None, None, 0.5, None, 0.8, None, None, None, [], [], ["lost", "unclear"], [], [], False),
    ("QRY11", "boolean", False, None, None, 0.6, None, 0.8, None, None, None, [], [], [], [], [], False),
    ("QRY12", "score", True, None, None, None, None, None, 0.7, 0.5, 1.5, [], [], [], [], [], False),
    ("QRY13", "boolean", True, 0.4, 0.6, 0.71, None, 0.9, None, None, None, [], [], [], [], [], False),
    ("QRY14", "choice", True, None, None, 0.6, 0.45, 0.92, 0.7, None, None, [], [], ["kept"], ["unclear"], ["lost"], False),
    ("QRY15", "boolean", True, 0.45, 0.5, 0.5, None, 0.9, None, None, None, [], [], [], [], [], False),
    ("QRY16", "score", True, None, None, None, 0.5, None, 0.6, 0.8, 0.4, [], [], [], [], [], True),
]
# A rule's set, whether it is on, what it looks at (scope, kinds, languages), what it needs (body, implemented members, all facts, any
# facts), its context, whether findings end a run, and when and by which families more evidence is sought.
#   rule, ruleset, enabled, scope, kinds, languages, needs_body, needs_members, requires_all, requires_any, context, blocks_exit, enrich, enrich_on, families
RULES = [
    ("mixed-duties", "design", True, "unit", ["function", "method"], [], True, False, [], [], "unit", True, True, ["low_confidence", "reduced_context"], ["callers", "callees", "definitions"]),
    ("redundant-check", "checks", True, "unit", ["function", "method"], [], True, False, ["executable_behavior"], ["validation_candidate"], "owner", True, True, ["missing_evidence", "low_confidence"], ["callers", "tests"]),
    ("hidden-fallback", "checks", True, "unit", ["function", "method"], [], True, False, ["executable_behavior"], ["fallback_candidate"], "unit", False, True, ["probability_ambiguous"], ["tests", "unknown_family", "tests"]),
    ("partial-transition", "state", True, "unit", ["function", "method"], [], True, False, [], ["state_transition_candidate", "fallback_candidate"], "owner", True, False, [], []),
    ("incohesive-owner", "design", True, "unit", ["class", "impl", "package"], [], False, True, [], [], "unit", False, True, ["applicability", "reduced_context"], ["enclosing_context"]),
    ("rust-only", "state", True, "unit", ["function", "method", "struct"], ["rust"], False, False, [], [], "file", True, True, ["weak_defect_signal", "low_choice_probability"], ["definitions"]),
    ("file-purpose", "design", True, "file", [], [], False, False, [], ["executable_behavior"], "file", True, True, ["missing_evidence"], ["enclosing_context", "callers"]),
    ("off-rule", "state", False, "unit", ["function"], [], False, False, [], [], "unit", True, False, [], []),
    ("old-rule", "legacy", True, "unit", ["function"], [], False, False, [], [], "unit", True, False, [], []),
]
RULE_FIELDS = (
    "rule STRING, ruleset STRING, enabled BOOLEAN, scope STRING, kinds ARRAY<STRING>, languages ARRAY<STRING>, needs_body BOOLEAN, needs_members BOOLEAN, requires_all ARRAY<STRING>, requires_any ARRAY<STRING>, "
    "context STRING, blocks_exit BOOLEAN, enrich BOOLEAN, enrich_on ARRAY<STRING>, families ARRAY<STRING>"
)
# Rulesets by whether they are on, and what a run selects and ignores by rule, set or ALL.
RULESETS = [("design", True), ("checks", True), ("state", True), ("legacy", False)]
SELECT, IGNORE = ["ALL"], ["partial-transition"]


def rule_policies(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Policies by rule: a row a rule of the catalogue, which people write, so it is small whatever the data."""
    return spark.createDataFrame(rows or POLICIES, "rule_id STRING, " + POLICY)


def rules(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or RULES, RULE_FIELDS)


def rulesets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULESETS, "ruleset STRING, enabled BOOLEAN")


def _literal(value, kind: str) -> str:
    if value is None:
        return f"NULL::{kind}"
    if isinstance(value, list):
        return "[" + ", ".join(f"'{x}'" for x in value) + "]::VARCHAR[]"
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value}::DOUBLE" if isinstance(value, float) else f"'{value}'"


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A table of literals as a common table expression."""
    lists = [any(isinstance(r[i], list) for r in rows) for i in range(len(columns))]
    text = [any(isinstance(r[i], str) for r in rows) for i in range(len(columns))]
    body = ", ".join("(" + ", ".join(_literal(v, "VARCHAR[]" if lists[i] else "VARCHAR" if text[i] else "DOUBLE") for i, v in enumerate(r)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) t({', '.join(columns)}))"


POLICY_SQL = values_sql("policies", ["rule_id", *POLICY_FIELDS], POLICIES)
RULE_COLUMNS = [x.split()[0] for x in RULE_FIELDS.split(", ")]
RULES_SQL = values_sql("rules", RULE_COLUMNS, RULES)
RULESETS_SQL = values_sql("rulesets", ["ruleset", "enabled"], RULESETS)


def assessed_sql(source: str, target: str) -> str:
    """The classification written out over a table ``source`` that has an answer, ``context_complete`` and all policy fields: a table ``target``."""
    mass = "coalesce(list_sum(list_transform({0}_levels, lambda x: coalesce(map_extract_value(answer.probabilities, x), 0.0))), 0.0)"
    read = "CASE type WHEN 'boolean' THEN CASE WHEN expected THEN answer.noul ELSE 1 - answer.noul END WHEN 'choice' THEN map_extract_value(answer.probabilities, answer.choice) ELSE " + mass + " END"
    hit = "(type <> 'choice' OR list_contains(defect, answer.choice)) AND CASE WHEN {0}_p IS NOT NULL THEN " + read + " >= {0}_p WHEN descending THEN answer.score <= {0}_s ELSE answer.score >= {0}_s END"
    unsure = "{0}_c IS NOT NULL AND (answer.confidence IS NULL OR answer.confidence < {0}_c)"
    level = "WHEN " + hit + " THEN CASE WHEN " + unsure + " THEN 'unknown|low_confidence||{0}' WHEN ambiguous THEN 'unknown|probability_ambiguous||{0}' ELSE '{0}||{0}|' END"
    return f"""{target} AS (SELECT *, split_part(o, '|', 1) AS status, nullif(split_part(o, '|', 2), '') AS reason, nullif(split_part(o, '|', 3), '') AS severity, nullif(split_part(o, '|', 4), '') AS tentative,
  split_part(o, '|', 3) <> '' AS confirmed, split_part(o, '|', 3) <> '' OR split_part(o, '|', 4) <> '' AS signal FROM (SELECT *, CASE
    WHEN type = 'choice' AND list_contains(uncertain, answer.choice) THEN 'unknown|missing_evidence||'
    {level.format('error')}
    {level.format('warning')}
    WHEN ambiguous THEN 'unknown|probability_ambiguous||'
    WHEN answer.confidence < warning_c THEN 'unknown|low_confidence||'
    WHEN type = 'choice' AND map_extract_value(answer.probabilities, answer.choice) < warning_p THEN 'unknown|low_choice_probability||'
    WHEN type = 'choice' AND list_contains(defect, answer.choice) THEN 'unknown|weak_defect_signal||'
    WHEN NOT coalesce(context_complete, false) THEN 'unknown|reduced_context||'
    WHEN type = 'choice' AND list_contains(inapplicable, answer.choice) THEN 'not_applicable|rule_not_applicable||'
    ELSE 'ok|||' END AS o FROM (SELECT *, coalesce(type = 'boolean' AND answer.noul >= low AND answer.noul < high, false) AS ambiguous FROM {source})))"""

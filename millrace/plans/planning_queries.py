"""Queries of planning and of results: rules, targets, checks, skips, evidence, estimates, requests and their accounting, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.assessment import assess
from millrace.operators import accounting, evidence, planning, recovery, replay, retrieval
from millrace.sources.tables import table

from .catalogue import IGNORE, POLICIES, POLICY_SQL, RULES_SQL, RULESETS_SQL, SELECT, assessed_sql, rule_policies, rules, rulesets, values_sql
from .queries import FILES, REGISTRY, UNITS

LINES = 60  # files longer than this are not given whole

LISTED = {word: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]" for word, words in (("select", SELECT), ("ignore", IGNORE))}
SELECTED = f"{RULES_SQL}, {RULESETS_SQL}, chosen AS (SELECT r.* FROM rules r JOIN rulesets s USING (ruleset) WHERE r.enabled AND s.enabled AND list_has_any([rule, ruleset, 'ALL'], {LISTED['select']}) AND NOT list_has_any([rule, ruleset, 'ALL'], {LISTED['ignore']}))"
LANGUAGE = r"CASE WHEN regexp_matches(lower({0}), '\.(py|pyi)$') THEN 'python' WHEN regexp_matches(lower({0}), '\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower({0}), '\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(lower({0}), '\.rs$') THEN 'rust' WHEN regexp_matches(lower({0}), '\.(pl|pm|t)$') THEN 'perl' END"
TARGETS = f"""{UNITS}, {FILES}, sized AS (
  SELECT path, {LANGUAGE.format('path')} AS language, strlen(content) AS size, greatest(1, len(content) - len(replace(content, chr(10), '')) + CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 0 ELSE 1 END)::INT AS n_lines FROM files WHERE content IS NOT NULL
), owners AS (SELECT DISTINCT parent_id AS unit_id FROM valid WHERE kind IN ('function', 'method') AND has_implementation AND parent_id IS NOT NULL),
facts AS (SELECT path, list_sort(list(DISTINCT f)) AS facts FROM (SELECT path, unnest(syntax_facts) AS f FROM valid) GROUP BY path),
targets AS (
  SELECT path AS target_id, path, language, size, n_lines, 'file' AS scope, NULL::VARCHAR AS kind, path AS name, NULL::VARCHAR AS parent_id, 0 AS start_byte, size AS end_byte, 1 AS start_line, n_lines AS end_line, true AS has_body, true AS implemented, false AS has_members, coalesce(facts, []::VARCHAR[]) AS facts FROM sized LEFT JOIN facts USING (path)
  UNION ALL SELECT v.unit_id, v.path, s.language, s.size, s.n_lines, 'unit', v.kind, v.qualified_name, v.parent_id, v.start_byte, v.end_byte, v.start_line, v.end_line, v.has_body, v.has_implementation, o.unit_id IS NOT NULL, coalesce(v.syntax_facts, []::VARCHAR[])
    FROM valid v JOIN sized s USING (path) LEFT JOIN owners o ON o.unit_id = v.unit_id WHERE v.start_byte >= 0 AND v.start_byte < v.end_byte AND v.end_byte <= s.size
), owned AS (SELECT t.*, p.start_byte AS owner_start, p.end_byte AS owner_end FROM targets t LEFT JOIN targets p ON p.scope = 'unit' AND p.target_id = t.parent_id)"""
MATCHES = f"""{TARGETS}, {SELECTED}, matches AS (
  SELECT t.*, r.* EXCLUDE (scope, enabled), list_filter(requires_all, lambda x: NOT list_contains(facts, x)) || CASE WHEN len(requires_any) > 0 AND NOT list_has_any(requires_any, facts) THEN requires_any ELSE []::VARCHAR[] END AS missing
  FROM owned t JOIN chosen r ON r.scope = t.scope WHERE t.language IS NOT NULL AND (len(languages) = 0 OR list_contains(languages, t.language)) AND (t.scope = 'file' OR (list_contains(kinds, t.kind) AND (NOT needs_body OR (has_body AND implemented)) AND (NOT needs_members OR has_members)))
)"""
CHECKS = f"""{MATCHES}, wanting AS (
  SELECT *, n_lines > {LINES} AS limited, printf('q%05d', row_number() OVER (PARTITION BY path ORDER BY scope <> 'file', start_byte, end_byte DESC, target_id, rule) - 1) AS check_id,
    CASE WHEN scope = 'file' OR context = 'file' THEN 'file' WHEN context = 'unit' OR kind NOT IN ('function', 'method') THEN 'unit' WHEN language <> 'rust' AND owner_start IS NOT NULL THEN 'owner' WHEN n_lines > {LINES} THEN 'unit' ELSE 'file' END AS wanted
  FROM matches WHERE len(missing) = 0
), checks AS (
  SELECT *, CASE wanted WHEN 'file' THEN 0 WHEN 'owner' THEN owner_start ELSE start_byte END AS from_byte, CASE wanted WHEN 'file' THEN size WHEN 'owner' THEN owner_end ELSE end_byte END AS to_byte, limited AND (scope = 'file' OR context = 'file') AS omitted FROM wanting
)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    units = retrieval.latest_units(table(spark, d, "units"), "path", "kind", "qualified_name", "parent_id", "start_byte", "end_byte", "start_line", "end_line", "has_body", "has_implementation", "syntax_facts")
    return planning.with_owner(planning.targets(units, table(spark, d, "source_files", "path", "content")))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return planning.matched(_targets(spark, d), planning.selected(rules(spark), rulesets(spark), SELECT, IGNORE))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return planning.checks(_matches(spark, d), LINES)


# --- the catalogue


@REGISTRY.query(f"WITH {SELECTED} SELECT rule, ruleset, scope FROM chosen")
def rule_selection(spark, d):
    return planning.selected(rules(spark), rulesets(spark), SELECT, IGNORE).select("rule", "ruleset", "scope")


WORDS = ["ALL", "design", "mixed-duties", "no-such-rule", "old-rule", "typo"]


@REGISTRY.query(f"WITH {RULES_SQL}, w AS (SELECT unnest({WORDS}) AS word) SELECT word FROM w WHERE word <> 'ALL' AND word NOT IN (SELECT rule FROM rules) AND word NOT IN (SELECT ruleset FROM rules)")
def rule_unknown_selectors(spark, d):
    return planning.unknown_selectors(rules(spark), spark.createDataFrame([(w,) for w in WORDS], "word STRING"))


@REGISTRY.query(f"WITH {RULES_SQL}, {RULESETS_SQL} SELECT r.rule, r.ruleset, r.enabled AND s.enabled AS is_on, NOT regexp_matches(r.rule, '^[a-z][a-z0-9-]*$') OR r.rule = 'ALL' OR r.rule IN (SELECT ruleset FROM rulesets) AS bad_name, len(r.kinds)::INT AS n_kinds, list_has_any(r.requires_all, r.requires_any) AS overlapping FROM rules r JOIN rulesets s USING (ruleset)")
def rule_listing(spark, d):
    sets = rulesets(spark).withColumnRenamed("enabled", "_on")
    names = [r.ruleset for r in rulesets(spark).collect()]  # a row a set of the catalogue
    bad = ~F.col("rule").rlike("^[a-z][a-z0-9-]*$") | (F.col("rule") == "ALL") | F.col("rule").isin(names)
    return rules(spark).join(F.broadcast(sets), "ruleset").select("rule", "ruleset", (F.col("enabled") & F.col("_on")).alias("is_on"), bad.alias("bad_name"), F.size("kinds").alias("n_kinds"), F.arrays_overlap("requires_all", "requires_any").alias("overlapping"))


# Policies that break their contract, each in its way, after the sound ones.
BROKEN = POLICIES + [
    ("B1", "boolean", True, 0.4, 0.6, 0.95, None, 0.9, None, None, None, [], [], [], [], [], False), ("B2", "choice", True, None, None, 0.6, 0.9, 0.9, 0.7, None, None, [], [], ["a"], ["a"], [], False),
    ("B3", "score", True, None, None, None, 0.6, None, 0.7, 2.0, 1.0, [], [], [], [], [], False), ("B4", "score", True, None, None, None, 0.6, None, 0.7, 1.0, 2.0, [], [], [], [], [], True),
    ("B5", "score", True, None, None, 0.5, None, 0.6, None, None, None, ["1"], ["2"], [], [], [], False), ("B6", "boolean", True, 0.7, 0.8, 0.5, 0.5, 0.9, None, None, None, [], [], [], [], [], False),
    ("B7", "score", True, None, None, 0.5, None, 0.6, None, 1.0, None, ["1"], ["1"], [], [], [], False), ("B8", "choice", True, None, None, None, None, None, None, None, None, [], [], [], [], [], False),
]


@REGISTRY.query("WITH " + values_sql("p", ["rule_id", "type", "expected", "low", "high", "warning_p", "warning_c", "error_p", "error_c", "warning_s", "error_s", "warning_levels", "error_levels", "defect", "uncertain", "inapplicable", "descending"], BROKEN) + """ SELECT rule_id, unnest(list_filter([
  CASE WHEN warning_p > error_p AND NOT (len(warning_levels) > 0 AND len(error_levels) > 0) THEN 'probability_order' END, CASE WHEN warning_c > error_c THEN 'confidence_order' END, CASE WHEN CASE WHEN descending THEN warning_s < error_s ELSE warning_s > error_s END THEN 'score_order' END,
  CASE WHEN type = 'score' AND (len(warning_levels) > 0) = (warning_s IS NOT NULL OR error_s IS NOT NULL) THEN 'score_mode' END, CASE WHEN NOT list_has_all(warning_levels, error_levels) THEN 'levels' END,
  CASE WHEN type = 'choice' AND (list_has_any(defect, uncertain) OR list_has_any(defect, inapplicable) OR list_has_any(uncertain, inapplicable) OR len(defect) = 0) THEN 'labels' END, CASE WHEN low IS NOT NULL AND NOT (low >= 0 AND low <= 0.5 AND high > 0.5 AND high <= 1) THEN 'range' END,
  CASE WHEN type = 'boolean' AND (warning_c IS NOT NULL OR error_c IS NOT NULL) THEN 'boolean_confidence' END, CASE WHEN type IN ('boolean', 'choice') AND warning_p IS NULL THEN 'probability_needed' END], lambda x: x IS NOT NULL)) AS error FROM p""")
def rule_validation_errors(spark, d):
    return planning.rule_errors(rule_policies(spark, BROKEN))


# --- targets and checks


@REGISTRY.query(f"WITH {TARGETS} SELECT target_id, scope, language, has_members, array_to_string(facts, ',') AS facts, row_number() OVER (PARTITION BY path ORDER BY scope <> 'file', start_byte, end_byte DESC, target_id)::INT AS place FROM targets")
def plan_targets(spark, d):
    place = F.row_number().over(Window.partitionBy("path").orderBy((F.col("scope") != "file").cast("int"), "start_byte", F.desc("end_byte"), "target_id"))
    return _targets(spark, d).select("target_id", "scope", "language", "has_members", F.array_join("facts", ",").alias("facts"), place.alias("place"))


@REGISTRY.query(f"WITH {MATCHES} SELECT rule, language, count(*)::BIGINT AS n_matched, count(*) FILTER (len(missing) = 0)::BIGINT AS n_checks FROM matches GROUP BY ALL")
def checks_by_rule(spark, d):
    return _matches(spark, d).groupBy("rule", "language").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if(F.size("missing") == 0).alias("n_checks"))


@REGISTRY.query(f"WITH {CHECKS} SELECT path, check_id, target_id, rule, wanted, from_byte::BIGINT AS from_byte, to_byte::BIGINT AS to_byte, omitted FROM checks")
def planned_checks(spark, d):
    return _checks(spark, d).select("path", "check_id", "target_id", "rule", "wanted", "from_byte", "to_byte", "omitted")


@REGISTRY.query(f"WITH {MATCHES} SELECT target_id, rule, 'applicability: declared syntax prerequisite absent (' || array_to_string(missing, ', ') || ')' AS reason FROM matches WHERE len(missing) > 0")
def applicability_skips(spark, d):
    rows = _matches(spark, d).filter(F.size("missing") > 0)
    return rows.select("target_id", "rule", F.concat(F.lit("applicability: declared syntax prerequisite absent ("), F.array_join("missing", ", "), F.lit(")")).alias("reason"))


@REGISTRY.query(f"WITH {CHECKS} SELECT path, n_lines, count(*)::BIGINT AS n_checks, count(*) FILTER (omitted)::BIGINT AS n_omitted, count(*) FILTER (wanted = 'unit' AND context = 'owner' AND kind IN ('function', 'method'))::BIGINT AS n_narrowed FROM checks WHERE limited GROUP BY ALL")
def full_file_omissions(spark, d):
    rows = _checks(spark, d).filter(F.col("n_lines") > LINES)
    narrowed = (F.col("wanted") == "unit") & (F.col("context") == "owner") & F.col("kind").isin("function", "method")
    return rows.groupBy("path", "n_lines").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("omitted").alias("n_omitted"), replay.count(narrowed).alias("n_narrowed"))


@REGISTRY.query(f"WITH {CHECKS} SELECT t.path, count(*)::BIGINT AS n_units FROM targets t WHERE t.scope = 'unit' AND t.target_id NOT IN (SELECT target_id FROM checks WHERE ruleset = 'checks') GROUP BY t.path")
def units_not_selected(spark, d):
    asked = _checks(spark, d).filter("ruleset = 'checks'").select("target_id").distinct()
    return _targets(spark, d).filter("scope = 'unit'").join(asked, "target_id", "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n_units"))


# --- evidence groups, estimates and requests

MODEL = "judge-latest"
ASKED = f"""{CHECKS}, shas AS (SELECT path, sha256(content) AS sha FROM files WHERE content IS NOT NULL), asked AS (
  SELECT c.*, sha256(concat_ws(':', c.path, from_byte, to_byte, sha)) AS evidence, to_byte - from_byte + strlen(c.path) AS state,
    '{{"instructions":{{"rubric":"' || left(sha256(rule), 16) || '","target":{{"end_line":' || end_line || coalesce(',"kind":"' || kind || '"', '') || ',"name":' || to_json(name) || ',"path":' || to_json(path) || ',"span":[' || start_byte || ',' || end_byte || '],"start_line":' || start_line || '}},"task":"Apply referenced rubric."}},"type":"boolean"}}' AS question
  FROM checks c JOIN shas USING (path) WHERE NOT omitted
), sized_q AS (SELECT *, strlen(question) + strlen(check_id) + 3 AS bytes, ceil((strlen(question) + strlen(check_id) + 3) / 3.0)::BIGINT AS tokens FROM asked)"""
FIXED = len(planning.FRAME) + len(MODEL) + 2
GROUPED = f"""{ASKED}, groups AS (
  SELECT evidence, scope, any_value(path) AS path, any_value(state) AS state, count(*) AS n, max(tokens) AS longest, sum(tokens) AS tokens, sum(bytes) AS bytes FROM sized_q GROUP BY evidence, scope
), estimated AS (
  SELECT *, ceil((state + {FIXED}) / 3.0)::BIGINT + {planning.RESERVE} + longest AS context, ceil((state + {FIXED}) / 3.0)::BIGINT + {planning.RESERVE} + tokens AS total, {FIXED} + state + bytes + n - 1 AS body FROM groups
)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    shas = table(spark, d, "source_files", "path", "content").filter("content IS NOT NULL").select("path", F.sha2("content", 256).alias("sha")).dropDuplicates(["path"])
    rows = _checks(spark, d).filter("NOT omitted").join(shas, "path")
    evidence = F.sha2(F.concat_ws(":", "path", F.col("from_byte").cast("string"), F.col("to_byte").cast("string"), "sha"), 256)
    return planning.question_sizes(rows.withColumn("evidence", evidence).withColumn("state", F.col("to_byte") - F.col("from_byte") + F.octet_length("path")))


def _estimated(spark: SparkSession, d: str) -> DataFrame:
    groups = _asked(spark, d).groupBy("evidence", "scope").agg(F.first("path").alias("path"), F.first("state").alias("state"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("longest"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    return groups.withColumn("e", planning.estimate(F.col("state"), F.lit(MODEL), F.col("longest"), F.col("tokens"), F.col("bytes"), F.col("n")))


@REGISTRY.query(f"WITH {ASKED} SELECT path, check_id, question, left(sha256(rule), 16) AS rubric FROM asked")
def bound_questions(spark, d):
    return _asked(spark, d).select("path", "check_id", "question", F.left(F.sha2("rule", 256), F.lit(16)).alias("rubric"))


@REGISTRY.query(f"WITH {ASKED} SELECT evidence, scope, any_value(path) AS path, string_agg(check_id, ',' ORDER BY check_id) AS checks, string_agg(DISTINCT left(sha256(rule), 16), ',' ORDER BY left(sha256(rule), 16)) AS registry, count(*)::INT AS n FROM asked GROUP BY ALL")
def evidence_groups(spark, d):
    rows = _asked(spark, d).groupBy("evidence", "scope").agg(F.first("path").alias("path"), F.array_sort(F.collect_list("check_id")).alias("ids"), F.array_sort(F.collect_set(F.left(F.sha2("rule", 256), F.lit(16)))).alias("refs"))
    return rows.select("evidence", "scope", "path", F.array_join("ids", ",").alias("checks"), F.array_join("refs", ",").alias("registry"), F.size("ids").alias("n"))


@REGISTRY.query(f"WITH {GROUPED} SELECT evidence, scope, n::BIGINT AS n, context::BIGINT AS context, total::BIGINT AS total, body::BIGINT AS body FROM estimated")
def token_estimates(spark, d):
    return _estimated(spark, d).select("evidence", "scope", "n", F.col("e.context").alias("context"), F.col("e.total").alias("total"), F.col("e.bytes").alias("body"))


TIGHT = {"context": 1_300, "total": 1_500, "bytes": 3_000, "questions": 3}


@REGISTRY.query(f"WITH {GROUPED} SELECT path, violations, count(*)::BIGINT AS n FROM (SELECT path, array_to_string(list_filter([CASE WHEN n > {planning.LIMITS['questions']} THEN 'questions' END, CASE WHEN context > {TIGHT['context']} THEN 'context' END, CASE WHEN total > {TIGHT['total']} THEN 'total' END, CASE WHEN body > {planning.LIMITS['bytes']} THEN 'bytes' END], lambda x: x IS NOT NULL), ',') AS violations FROM estimated) GROUP BY ALL")
def estimate_violations(spark, d):
    rows = _estimated(spark, d)
    limit = planning.published(F.lit(MODEL))
    over = planning.violations(F.col("e"), F.col("n"), F.least(limit.context, F.lit(TIGHT["context"])), F.least(limit.total, F.lit(TIGHT["total"])))
    return rows.select("path", F.array_join(over, ",").alias("violations")).groupBy("path", "violations").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("SELECT request_id, least(CASE WHEN regexp_matches(lower(trim(model)), '^judge-(latest|1\\.[45])$') THEN 32000 END, max_context_tokens)::BIGINT AS context, CASE WHEN regexp_matches(lower(trim(model)), '^judge-(latest|1\\.[45])$') THEN 64000 END AS total FROM (SELECT DISTINCT request_id, model FROM budget_estimates) JOIN pack_limits USING (model)")
def effective_limits(spark, d):
    rows = table(spark, d, "budget_estimates", "request_id", "model").distinct().join(F.broadcast(table(spark, d, "pack_limits", "model", "max_context_tokens")), "model")  # a row a model
    limit = planning.published(F.col("model"))
    return rows.select("request_id", F.least(limit.context, "max_context_tokens").alias("context"), limit.total.alias("total"))


PACKED = f"""{ASKED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY evidence || scope ORDER BY check_id) AS k, ceil((state + {FIXED}) / 3.0)::BIGINT + {planning.RESERVE} AS base FROM sized_q),
folded AS (
  SELECT evidence, scope, check_id, k, 0 AS batch, 1 AS nq, tokens AS longest, tokens AS total, bytes AS body, NOT (base + tokens <= {TIGHT['context']} AND base + tokens <= {TIGHT['total']} AND {FIXED} + state + bytes <= {TIGHT['bytes']}) AS counted FROM numbered WHERE k = 1
  UNION ALL
  SELECT evidence, scope, check_id, k, CASE WHEN fresh THEN batch + 1 ELSE batch END, CASE WHEN fresh THEN 1 ELSE nq + 1 END, CASE WHEN fresh THEN tokens ELSE greatest(longest, tokens) END, CASE WHEN fresh THEN tokens ELSE total + tokens END, CASE WHEN fresh THEN bytes ELSE body + bytes END, counted
  FROM (SELECT n.evidence, n.scope, n.check_id, n.k, n.tokens, n.bytes, f.batch, f.nq, f.longest, f.total, f.body, f.counted, CASE WHEN f.counted THEN f.nq >= {TIGHT['questions']} ELSE NOT (f.nq + 1 <= {TIGHT['questions']} AND n.base + greatest(f.longest, n.tokens) <= {TIGHT['context']} AND n.base + f.total + n.tokens <= {TIGHT['total']} AND {FIXED} + n.state + f.body + n.bytes + f.nq <= {TIGHT['bytes']}) END AS fresh
    FROM folded f JOIN numbered n ON n.evidence = f.evidence AND n.scope = f.scope AND n.k = f.k + 1)
)"""


def _packed(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d).select(F.concat("evidence", "scope").alias("gid"), "evidence", "scope", "path", "check_id", F.col("tokens").cast("bigint").alias("tokens"), F.col("bytes").cast("bigint").alias("bytes"), F.col("state").cast("bigint").alias("state"))
    return planning.pack(rows, "gid", ["check_id"], "state", FIXED, TIGHT["context"], TIGHT["total"], TIGHT["bytes"], TIGHT["questions"])


@REGISTRY.query(f"WITH RECURSIVE {PACKED} SELECT evidence, scope, check_id, batch FROM folded")
def request_packing(spark, d):
    return _packed(spark, d).select("evidence", "scope", "check_id", "batch")


@REGISTRY.query(f"WITH RECURSIVE {PACKED}, r AS (SELECT s.path, f.evidence, f.scope, f.batch, count(*) AS n, sum(s.bytes) AS bytes, sum(s.tokens) AS tokens FROM folded f JOIN sized_q s USING (evidence, scope, check_id) GROUP BY ALL), o AS (SELECT path, count(*) AS n_all, count(*) FILTER (omitted) AS n_omitted FROM checks GROUP BY path), k AS (SELECT path, count(*) AS n_skipped FROM matches WHERE len(missing) > 0 GROUP BY path) SELECT o.path, o.n_all::BIGINT AS n_checks, o.n_omitted::BIGINT AS n_omitted, coalesce(any_value(k.n_skipped), 0)::BIGINT AS n_skipped, count(r.batch)::BIGINT AS n_requests, coalesce(sum(r.tokens), 0)::BIGINT AS tokens, coalesce(sum(r.bytes), 0)::BIGINT AS bytes FROM o LEFT JOIN r USING (path) LEFT JOIN k USING (path) GROUP BY o.path, o.n_all, o.n_omitted")
def plan_report_by_file(spark, d):
    requests = _packed(spark, d).groupBy("path", "evidence", "scope", "batch").agg(F.sum("tokens").alias("t"), F.sum("bytes").alias("b")).groupBy("path").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("t").alias("tokens"), F.sum("b").alias("bytes"))
    counts = _checks(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("omitted").alias("n_omitted"))
    skips = _matches(spark, d).filter(F.size("missing") > 0).groupBy("path").agg(F.count(F.lit(1)).alias("n_skipped"))
    return counts.join(requests, "path", "left").join(skips, "path", "left").fillna(0, ["n_skipped", "n_requests", "tokens", "bytes"])


# --- judged by a judge that answers from a digest, so results are the same everywhere

PROBABILITY = "('0x' || left(sha256(target_id || ':' || rule), 4))::INT / 65536.0::DOUBLE"
JUDGED = f"""{CHECKS}, {POLICY_SQL}, prepared AS (
  SELECT c.path, c.target_id, c.scope, c.rule, c.blocks_exit, c.enrich, c.enrich_on, c.wanted, c.n_lines, left(sha256(c.rule || c.target_id), 1) IN ('0', '1', '2', '3') AS cached, c.wanted <> 'unit' OR c.start_byte = 0 AS context_complete, c.start_byte,
    {{'type': 'boolean', 'noul': {PROBABILITY}, 'choice': NULL::VARCHAR, 'score': NULL::DOUBLE, 'confidence': NULL::DOUBLE, 'probabilities': MAP {{}}::MAP(VARCHAR, DOUBLE)}} AS answer, p.*
  FROM checks c, policies p WHERE p.rule_id = 'QRY03' AND NOT c.omitted
), {assessed_sql('prepared', 'judged')}, skipped AS (SELECT path, target_id, scope, rule, n_lines FROM checks WHERE omitted), inapplicable AS (SELECT path, target_id, scope, rule FROM matches WHERE len(missing) > 0)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    policy = rule_policies(spark, [p for p in POLICIES if p[0] == "QRY03"]).select(F.struct(*[c for c in rule_policies(spark).columns if c != "rule_id"]).alias("policy"))
    rows = accounting.judge(_checks(spark, d).filter("NOT omitted")).join(F.broadcast(policy))  # one row
    return rows.withColumn("o", assess()).select("path", "target_id", "scope", "rule", "blocks_exit", "enrich", "enrich_on", "wanted", "start_byte", "cached", "context_complete", "answer", "o.*")


def _skipped(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d).filter("omitted").select("path", "target_id", "scope", "rule")


def _inapplicable(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).filter(F.size("missing") > 0).select("path", "target_id", "scope", "rule")


@REGISTRY.query(f"WITH {JUDGED} SELECT target_id, string_agg(rule || '=' || status, ',' ORDER BY rule) AS statuses, string_agg(rule || '=' || reason, ',' ORDER BY rule) FILTER (reason IS NOT NULL) AS reasons, string_agg(rule || '=' || severity, ',' ORDER BY rule) FILTER (severity IS NOT NULL) AS findings, string_agg(rule || '=' || tentative, ',' ORDER BY rule) FILTER (tentative IS NOT NULL) AS tentative, string_agg(rule, ',' ORDER BY rule) FILTER (cached) AS cached_rules, bool_and(cached) AND target_id NOT IN (SELECT target_id FROM skipped) AS cached FROM judged GROUP BY target_id")
def target_events(spark, d):
    return accounting.events(_judged(spark, d), _skipped(spark, d))


@REGISTRY.query(f"WITH {JUDGED}, e AS (SELECT path, 1 AS evaluated, 0 AS skipped, 0 AS inapplicable, status FROM judged UNION ALL SELECT path, 0, 1, 0, NULL FROM skipped UNION ALL SELECT path, 0, 0, 1, NULL FROM inapplicable) SELECT path, sum(evaluated)::BIGINT AS checks_evaluated, sum(skipped)::BIGINT AS checks_skipped, sum(inapplicable)::BIGINT AS applicability_skips, count(*) FILTER (status = 'unknown')::BIGINT AS uncertain, (sum(inapplicable) + count(*) FILTER (status = 'not_applicable'))::BIGINT AS not_applicable FROM e GROUP BY path")
def check_accounting(spark, d):
    return accounting.checks(_judged(spark, d), _skipped(spark, d), _inapplicable(spark, d))


@REGISTRY.query(f"""WITH {JUDGED}, t AS (SELECT coalesce(j.target_id, s.target_id) AS target_id, coalesce(j.path, s.path) AS path, coalesce(j.scope, s.scope) AS scope, j.target_id IS NOT NULL AS has_judgments, s.target_id IS NOT NULL AS has_skips, coalesce(j.cached, false) AND s.target_id IS NULL AS cached
  FROM (SELECT target_id, path, scope, bool_and(cached) AS cached FROM judged GROUP BY ALL) j FULL JOIN (SELECT DISTINCT target_id, path, scope FROM skipped) s ON s.target_id = j.target_id)
SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS repo, count(*) FILTER (scope = 'file' AND has_judgments)::BIGINT AS files_evaluated, count(*) FILTER (scope = 'file' AND has_skips AND NOT has_judgments)::BIGINT AS files_skipped, count(*) FILTER (scope = 'unit' AND has_judgments)::BIGINT AS units_evaluated, count(*) FILTER (scope = 'unit' AND cached)::BIGINT AS units_cached, count(*) FILTER (scope = 'unit' AND has_skips AND NOT has_judgments)::BIGINT AS units_skipped FROM t GROUP BY ALL""")
def target_accounting(spark, d):
    return accounting.targets(_judged(spark, d), _skipped(spark, d))


FOUND = "split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS repo"


@REGISTRY.query(f"WITH {JUDGED} SELECT {FOUND}, s AS severity, count(*) FILTER (severity = s)::BIGINT AS findings, count(*) FILTER (severity = s AND NOT blocks_exit)::BIGINT AS advisory, count(*) FILTER (tentative = s)::BIGINT AS tentative FROM judged, (SELECT unnest(['warning', 'error']) AS s) GROUP BY ALL")
def findings_accounting(spark, d):
    return accounting.findings(_judged(spark, d))


@REGISTRY.query(f"WITH {JUDGED}, per AS (SELECT {FOUND}, bool_or(severity = 'error' AND blocks_exit) AS e, bool_or(severity IS NOT NULL AND blocks_exit) AS w FROM judged GROUP BY ALL), gaps AS (SELECT DISTINCT {FOUND} FROM skipped), f AS (SELECT unnest(['never', 'warning', 'error']) AS fail_on) SELECT per.repo, fail_on, CASE WHEN gaps.repo IS NOT NULL THEN 2 WHEN fail_on = 'warning' AND w OR fail_on = 'error' AND e THEN 1 ELSE 0 END AS exit_code FROM per CROSS JOIN f LEFT JOIN gaps USING (repo)")
def exit_codes(spark, d):
    return accounting.exit_codes(_judged(spark, d), _skipped(spark, d))


@REGISTRY.query(f"WITH {JUDGED} SELECT target_id, 'reduced surrounding evidence for ' || string_agg(rule, ', ' ORDER BY rule) || '; target is complete' AS message FROM judged WHERE NOT context_complete GROUP BY target_id")
def reduced_context_diagnostics(spark, d):
    rows = _judged(spark, d).filter("NOT context_complete").groupBy("target_id").agg(F.array_sort(F.collect_list("rule")).alias("r"))
    return rows.select("target_id", F.concat(F.lit("reduced surrounding evidence for "), F.array_join("r", ", "), F.lit("; target is complete")).alias("message"))


@REGISTRY.query(f"WITH {JUDGED} SELECT target_id, min(rule) AS first_rule, count(*)::BIGINT AS n, 'full-file context is ' || any_value(n_lines) || ' lines; configured limit is {LINES}' AS reason, false AS shown FROM skipped GROUP BY target_id")
def skipped_diagnostics(spark, d):
    rows = _checks(spark, d).filter("omitted")
    reason = F.concat(F.lit("full-file context is "), F.col("n_lines").cast("string"), F.lit(f" lines; configured limit is {LINES}"))
    out = rows.withColumn("reason", reason).groupBy("target_id").agg(F.min("rule").alias("first_rule"), F.count(F.lit(1)).alias("n"), F.max("reason").alias("reason"), F.max(~F.startswith("reason", F.lit("full-file context is "))).alias("shown"))
    return out.select("target_id", "first_rule", "n", "reason", "shown")


@REGISTRY.query(f"WITH {JUDGED} SELECT path, count(*)::BIGINT AS n_omitted, count(DISTINCT target_id)::BIGINT AS n_targets FROM skipped GROUP BY path")
def coverage_events(spark, d):
    return _skipped(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_omitted"), F.countDistinct("target_id").alias("n_targets"))


PRIORITY = ["missing_evidence", "reduced_context", "applicability", "low_confidence", "low_choice_probability", "weak_defect_signal", "probability_ambiguous"]
RANKS = {"missing_evidence": 0, "reduced_context": 1, "applicability": 2, "low_confidence": 3, "low_choice_probability": 3, "weak_defect_signal": 3, "probability_ambiguous": 4}
TRIGGERED = f"{JUDGED}, triggered AS (SELECT *, list_filter({PRIORITY}, lambda x: (x = reason OR (x = 'reduced_context' AND NOT context_complete)) AND list_contains(enrich_on, x))[1] AS trigger FROM judged WHERE status = 'unknown' AND enrich)"
RANK_SQL = "CASE trigger " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " END"


@REGISTRY.query(f"WITH {TRIGGERED} SELECT path, target_id, rule, trigger, {RANK_SQL} AS priority, row_number() OVER (PARTITION BY path ORDER BY {RANK_SQL}, start_byte, rule, target_id)::INT AS place FROM triggered WHERE trigger IS NOT NULL QUALIFY place <= 5")
def review_queue(spark, d):
    return accounting.review_queue(_judged(spark, d), PRIORITY, RANKS, 5)


@REGISTRY.query(f"WITH {JUDGED} SELECT kind, count(*)::BIGINT AS n, count(DISTINCT target_id)::BIGINT AS n_targets FROM (SELECT 'judgment' AS kind, target_id FROM judged UNION ALL SELECT 'omission', target_id FROM skipped UNION ALL SELECT 'skip', target_id FROM inapplicable) GROUP BY kind")
def captured_finals(spark, d):
    parts = [df.select(F.lit(kind).alias("kind"), "target_id") for kind, df in (("judgment", _judged(spark, d)), ("omission", _skipped(spark, d)), ("skip", _inapplicable(spark, d)))]
    return reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("n_targets"))


@REGISTRY.query(f"WITH {JUDGED} SELECT c.path, count(*)::BIGINT AS n_aborted FROM checks c WHERE NOT omitted AND (c.target_id, c.rule) NOT IN (SELECT target_id, rule FROM judged WHERE answer.noul >= 0.25) GROUP BY c.path")
def aborted_checks(spark, d):
    done = _judged(spark, d).filter("answer.noul >= 0.25").select("target_id", "rule")
    return _checks(spark, d).filter("NOT omitted").join(done, ["target_id", "rule"], "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n_aborted"))


@REGISTRY.query(f"WITH {JUDGED} SELECT path, target_id, string_agg(CASE WHEN status IN ('warning', 'error') OR tentative IS NOT NULL THEN rule END, ',' ORDER BY rule) AS shown, count(*) FILTER (status NOT IN ('warning', 'error') AND tentative IS NULL)::BIGINT AS n_hidden FROM judged GROUP BY ALL HAVING count(*) FILTER (status IN ('warning', 'error') OR tentative IS NOT NULL) > 0")
def visible_rows(spark, d):
    seen = F.col("status").isin("warning", "error") | F.col("tentative").isNotNull()
    out = _judged(spark, d).groupBy("path", "target_id").agg(F.array_sort(F.collect_list(F.when(seen, F.col("rule")))).alias("r"), F.count_if(~seen).alias("n_hidden"))
    return out.filter(F.size("r") > 0).select("path", "target_id", F.array_join("r", ",").alias("shown"), "n_hidden")


# --- what becomes of requests that don't fit


@REGISTRY.query(f"""WITH {GROUPED}, v AS (SELECT evidence, scope, n, list_filter([CASE WHEN n > {TIGHT['questions']} THEN 'questions' END, CASE WHEN context > {TIGHT['context']} THEN 'context' END, CASE WHEN total > {TIGHT['total']} THEN 'total' END, CASE WHEN body > {TIGHT['bytes']} THEN 'bytes' END], lambda x: x IS NOT NULL) AS over FROM estimated)
SELECT evidence, scope, CASE WHEN list_contains(over, 'context') THEN 'model_context_preflight' WHEN len(over) > 0 THEN 'request_limit_preflight' END AS reason, CASE WHEN len(over) = 0 THEN 'send' WHEN list_contains(over, 'context') OR n = 1 THEN 'recover' ELSE 'halves' END AS action FROM v""")
def preflight_outcomes(spark, d):
    e, n = F.col("e"), F.col("n")
    passed = [(n > TIGHT["questions"], "questions"), (e.context > TIGHT["context"], "context"), (e.total > TIGHT["total"], "total"), (e.bytes > TIGHT["bytes"], "bytes")]
    over = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in passed)))
    return _estimated(spark, d).select("evidence", "scope", recovery.preflight(over, n).alias("p")).select("evidence", "scope", "p.*")


@REGISTRY.query(f"""WITH {ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY evidence, scope ORDER BY bytes, check_id) = 1 AS probe FROM sized_q), k AS (SELECT *, row_number() OVER (PARTITION BY evidence, scope, probe ORDER BY check_id) AS nth, count(*) OVER (PARTITION BY evidence, scope, probe) AS n FROM r)
SELECT evidence, scope, check_id, CASE WHEN probe THEN 0 WHEN nth <= (n + 1) // 2 THEN 1 ELSE 2 END AS part FROM k""")
def provider_split(spark, d):
    return recovery.provider_split(_asked(spark, d).select("evidence", "scope", "check_id", "bytes"), ["evidence", "scope"], "check_id", "bytes").select("evidence", "scope", "check_id", "part")


@REGISTRY.query(f"WITH {ASKED}, bad AS (SELECT evidence, min(bytes) AS least FROM sized_q WHERE {PROBABILITY} < 0.2 GROUP BY evidence), own AS (SELECT evidence, scope, min(bytes) AS smallest FROM sized_q GROUP BY ALL) SELECT o.evidence, o.scope, b.least::INT AS least, coalesce(o.smallest >= b.least, false) AS blocked FROM own o LEFT JOIN bad b USING (evidence)")
def known_rejections(spark, d):
    rows = _asked(spark, d).select("evidence", "scope", "rule", "target_id", "bytes", "wanted", "start_byte")
    rejected = accounting.judge(rows).filter("answer.noul < 0.2")
    return recovery.blocked(rows, rejected, ["evidence", "scope"], "bytes")


@REGISTRY.query()
def recovery_outcomes(spark, d):
    rows = _asked(spark, d).withColumn("bare", F.col("end_byte") - F.col("start_byte"))
    done = recovery.recover(rows, FIXED, TIGHT["context"], TIGHT["total"], TIGHT["bytes"], TIGHT["questions"], 1_500)
    return done.select("path", "check_id", "outcome", "rounds", "state")


# every check comes to exactly one outcome
@REGISTRY.query(f"WITH {ASKED} SELECT path, count(*)::BIGINT AS n_checks, count(*)::BIGINT AS n_outcomes, 1::BIGINT AS most FROM asked GROUP BY path")
def recovery_complete(spark, d):
    done = recovery_outcomes(spark, d).groupBy("path", "check_id").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.sum("n").alias("n_outcomes"), F.max("n").alias("most"))
    return _asked(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_checks")).join(done, "path", "left")


# --- the documents of an evidence

IMPORTS = rf"""lined AS (SELECT path, k, strlen(t) AS n, t, sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY k) - strlen(t) - 1 AS s FROM (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM files WHERE content IS NOT NULL)),
imports AS (SELECT path, s, s + n AS e FROM lined WHERE n > 0 AND regexp_matches(left(t, 1024), '{evidence.IMPORT}') QUALIFY row_number() OVER (PARTITION BY path ORDER BY k) <= 32)"""
MERGED = "{0} AS (SELECT {2}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY {2} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {2} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {1} WHERE s < e)) GROUP BY {2}, i)"
COMPOSED = f"{CHECKS}, {IMPORTS}, wanted AS (SELECT path || ':' || check_id AS key, path, from_byte AS s, to_byte AS e, start_byte, end_byte FROM checks WHERE NOT omitted), parts AS (SELECT key, s, e FROM wanted UNION ALL SELECT w.key, i.s, i.e FROM wanted w JOIN imports i USING (path)), {MERGED.format('documents', 'parts', 'key')}"


def _wanted(spark, d):
    return _checks(spark, d).filter("NOT omitted").withColumn("key", F.concat_ws(":", "path", "check_id"))


def _documents(spark, d):
    imports = evidence.import_spans(table(spark, d, "source_files", "path", "content")).distinct()
    return evidence.compose(_wanted(spark, d).select("key", "path", "from_byte", "to_byte"), imports, "key")


@REGISTRY.query(f"WITH {COMPOSED} SELECT d.key, count(*)::BIGINT AS n_documents, sum(d.e - d.s)::BIGINT AS n_bytes, bool_or(d.s <= w.s AND d.e >= w.e) AS context_complete, bool_or(d.s <= w.start_byte AND d.e >= w.end_byte) AS target_complete FROM documents d JOIN wanted w USING (key) GROUP BY d.key")
def composed_evidence(spark, d):
    wanted = _wanted(spark, d)
    return evidence.describe(wanted, _documents(spark, d), wanted, "key")


@REGISTRY.query(f"""WITH {COMPOSED}, kin AS (SELECT w.key, t.path, t.start_byte AS s, t.end_byte AS e FROM checks c JOIN wanted w ON w.key = c.path || ':' || c.check_id JOIN targets t ON t.scope = 'unit' AND t.parent_id = c.parent_id AND t.target_id <> c.target_id), docs AS (SELECT key, w.path, d.s, d.e FROM documents d JOIN wanted w USING (key)),
every AS (SELECT key || chr(10) || path AS gid, s, e FROM docs UNION ALL SELECT key || chr(10) || path, s, e FROM kin), {MERGED.format('joined', 'every', 'gid')} SELECT split_part(gid, chr(10), 1) AS key, count(*)::BIGINT AS n_documents, sum(e - s)::BIGINT AS n_bytes FROM joined GROUP BY ALL""")
def augmented_evidence(spark, d):
    wanted = _wanted(spark, d)
    kin = _targets(spark, d).filter("scope = 'unit' AND parent_id IS NOT NULL").select("parent_id", F.col("target_id").alias("kin_id"), "start_byte", "end_byte", F.col("path").alias("kin_path"))
    near = wanted.select("key", "parent_id", "target_id").join(kin, "parent_id").filter("kin_id <> target_id").select("key", F.col("kin_path").alias("path"), "start_byte", "end_byte")
    digests = table(spark, d, "source_files", "path", "content").filter("content IS NOT NULL").select("path", F.sha2("content", 256).alias("file_sha")).dropDuplicates(["path"])
    documents = _documents(spark, d).join(wanted.select("key", "path"), "key")
    return evidence.augment(documents, near, digests, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"))

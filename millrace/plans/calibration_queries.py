"""Queries of calibration by rule: replay under policies, comparability, compatibility and the search for thresholds, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import compatibility, replay, search
from millrace.sources.tables import table

from .catalogue import POLICIES, POLICY_SQL, assessed_sql, rule_policies, values_sql
from .queries import CASES, REGISTRY, SPLIT, SUPPORT, UTILITY

BASE = f"{CASES}, {POLICY_SQL}, based AS (SELECT c.case_id, c.answer, c.context_complete, c.label, c.adjudicated_severity, {SPLIT.replace('split', 'c.split')} AS split, {SUPPORT.replace('provenance', 'c.provenance')} AS support, p.* FROM cases c JOIN policies p USING (rule_id))"
RULED = f"{BASE}, {assessed_sql('based', 'replayed')}"


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(table(spark, d, "calibration_cases"), rule_policies(spark))


@REGISTRY.query(f"WITH {RULED} SELECT case_id, rule_id, status, reason, severity, tentative FROM replayed")
def assess_by_rule(spark, d):
    return _ruled(spark, d).select("case_id", "rule_id", "status", "reason", "severity", "tentative")


# Other policies for some rules, to be tried on recorded answers.
OVERRIDES = [(r[0], *r[1:5], *(0.5 if r[5] else None,), *r[6:]) for r in POLICIES if r[0] in ("QRY03", "QRY08", "QRY13")]
OVER_SQL = values_sql("overrides", ["rule_id", "warning_p"], [(r[0], r[5]) for r in OVERRIDES])


@REGISTRY.query(f"""WITH {RULED}, {OVER_SQL}, changed AS (SELECT b.* REPLACE (coalesce(o.warning_p, b.warning_p) AS warning_p) FROM based b LEFT JOIN overrides o USING (rule_id)), {assessed_sql('changed', 'again')}
SELECT rule_id, r.status AS before, a.status AS after, count(*)::BIGINT AS n FROM replayed r JOIN again a USING (case_id, rule_id) GROUP BY ALL""")
def replay_overrides(spark, d):
    other = rule_policies(spark, [o if (o := next((x for x in OVERRIDES if x[0] == r[0]), None)) else r for r in POLICIES])
    again = replay.replay(table(spark, d, "calibration_cases"), other).select("case_id", F.col("status").alias("after"))
    return _ruled(spark, d).select("case_id", "rule_id", F.col("status").alias("before")).join(again, "case_id").groupBy("rule_id", "before", "after").agg(F.count(F.lit(1)).alias("n"))


FRACTIONS = {
    "supported_warning": ("confirmed AND label = 'Agree'", "confirmed"), "confirmed_recall": ("confirmed AND label = 'Agree'", "label = 'Agree'"), "review_recall": ("signal AND label = 'Agree'", "label = 'Agree'"),
    "disagree_confirmed": ("confirmed AND label = 'Disagree'", "label = 'Disagree'"), "partial_confirmed": ("confirmed AND label = 'Partial'", "label = 'Partial'"), "partial_any": ("signal AND label = 'Partial'", "label = 'Partial'"),
}


@REGISTRY.query("WITH " + RULED + " SELECT rule_id, split, " + ", ".join(f"count(*) FILTER ({a})::BIGINT AS {k}_n, count(*) FILTER ({b})::BIGINT AS {k}_of, round(count(*) FILTER ({a}) / nullif(count(*) FILTER ({b}), 0)::DOUBLE, 6) AS {k}" for k, (a, b) in FRACTIONS.items()) + " FROM replayed GROUP BY ALL")
def label_fractions(spark, d):
    sums = [c for k, (a, b) in FRACTIONS.items() for c in (F.count_if(F.expr(a)).alias(f"{k}_n"), F.count_if(F.expr(b)).alias(f"{k}_of"))]
    out = _ruled(spark, d).groupBy("rule_id", "split").agg(*sums)
    return out.select("*", *(F.round(F.try_divide(f"{k}_n", f"{k}_of"), 6).alias(k) for k in FRACTIONS))


STATUSES = ["ok", "warning", "error", "unknown", "not_applicable"]


@REGISTRY.query("WITH " + RULED + ", grid AS (SELECT DISTINCT rule_id, unnest(['warning', 'error']) AS adjudicated FROM replayed) SELECT g.rule_id, g.adjudicated, " + ", ".join(f"count(*) FILTER (r.status = '{s}')::BIGINT AS {s}" for s in STATUSES) + " FROM grid g LEFT JOIN replayed r ON r.rule_id = g.rule_id AND r.adjudicated_severity = g.adjudicated GROUP BY ALL")
def severity_matrix(spark, d):
    rows = _ruled(spark, d)
    grid = rows.select("rule_id").distinct().select("rule_id", F.explode(F.array(F.lit("warning"), F.lit("error"))).alias("adjudicated"))
    own = rows.groupBy("rule_id", F.col("adjudicated_severity").alias("adjudicated")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return grid.join(own, ["rule_id", "adjudicated"], "left").fillna(0, STATUSES)


@REGISTRY.query("WITH " + RULED + " SELECT rule_id, split, " + ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT AS n_{s}" for s in STATUSES) + ", count(*) FILTER (tentative = 'warning')::BIGINT AS tentative_warning, count(*) FILTER (tentative = 'error')::BIGINT AS tentative_error FROM replayed GROUP BY ALL")
def status_counts_by_split(spark, d):
    return _ruled(spark, d).groupBy("rule_id", "split").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES), *(replay.count(F.col("tentative") == s).alias(f"tentative_{s}") for s in ("warning", "error")))


# --- comparability and compatibility

FIELDS = {"question": "sha2(question_wire, 256)", "evidence": "hashes.evidence", "prompt": "concat_ws('/', prompt.version, prompt.policy)", "endpoint": "endpoint", "model": "returned_model"}
FIELDS_SQL = {"question": "sha256(question_wire)", "evidence": "hashes.evidence", "prompt": "concat_ws('/', prompt.version, prompt.policy)", "endpoint": "endpoint", "model": "returned_model"}


@REGISTRY.query("WITH g AS (" + " UNION ALL ".join(f"SELECT '{key}' AS key, '{f}' AS field, count(DISTINCT {e}) AS n FROM calibration_cases GROUP BY {by}" for key, by in (("case_id", "case_id"), ("question", "sha256(question_wire)")) for f, e in FIELDS_SQL.items()) + ") SELECT key, field, count(*)::BIGINT AS n_keys, count(*) FILTER (n > 1)::BIGINT AS n_conflicts FROM g GROUP BY ALL")
def comparability_conflicts(spark, d):
    cases = table(spark, d, "calibration_cases", "case_id", "question_wire", "hashes", "prompt", "endpoint", "returned_model").withColumn("asked", F.sha2("question_wire", 256))
    parts = [compatibility.conflicts(cases, key, FIELDS).withColumn("key", F.lit(name)).select("key", "field", "n") for name, key in (("case_id", "case_id"), ("question", "asked"))]
    return reduce(DataFrame.unionByName, parts).groupBy("key", "field").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_conflicts"))


@REGISTRY.query(f"""WITH {RULED}, k AS (SELECT sha256(question_wire) AS asked, count(DISTINCT returned_model) > 1 OR count(DISTINCT concat_ws('/', prompt.version, prompt.policy)) > 1 AS bad FROM calibration_cases GROUP BY ALL)
SELECT r.rule_id, count(*)::BIGINT AS n, count(*) FILTER (NOT k.bad)::BIGINT AS n_comparable, count(*) FILTER (NOT k.bad AND r.confirmed)::BIGINT AS n_confirmed FROM replayed r JOIN cases c USING (case_id) JOIN k ON k.asked = sha256(c.question_wire) GROUP BY r.rule_id""")
def comparable_records(spark, d):
    cases = table(spark, d, "calibration_cases").withColumn("asked", F.sha2("question_wire", 256))
    bad = compatibility.conflicts(cases, "asked", {k: FIELDS[k] for k in ("model", "prompt")}).filter("n > 1").select("asked").distinct()
    asked = replay.known_cases(cases, "asked").join(bad.withColumn("bad", F.lit(True)), "asked", "left")
    rows = _ruled(spark, d).join(asked.select("case_id", F.coalesce("bad", F.lit(False)).alias("bad")), "case_id")
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bad")).alias("n_comparable"), F.count_if(~F.col("bad") & F.col("confirmed")).alias("n_confirmed"))


IDENTITY = f"{CASES}, ided AS (SELECT case_id, rule_id, {SPLIT} AS split, nullif(trim(returned_model), '') AS model, CASE WHEN prompt.version >= 1 THEN prompt.version END AS version, nullif(trim(prompt.policy), '') AS policy FROM cases)"
AUTHORITY = f"{IDENTITY}, authority AS (SELECT rule_id, arg_min(struct_pack(model := model, version := version, policy := policy), case_id || chr(10) || split) AS a FROM ided WHERE model IS NOT NULL AND version IS NOT NULL AND policy IS NOT NULL AND split = 'development' GROUP BY rule_id)"
CHECKED = AUTHORITY + ", checked AS (SELECT i.*, unnest(['returned_model', 'prompt.version', 'prompt.policy']) AS field, unnest([i.model, i.version::VARCHAR, i.policy]) AS actual, unnest([a.model, a.version::VARCHAR, a.policy]) AS expected FROM ided i LEFT JOIN authority USING (rule_id))"
STATE = "CASE WHEN bool_or(actual IS NULL) THEN 'missing_metadata' WHEN bool_or(actual <> expected) THEN 'mismatch' ELSE 'compatible' END"


@REGISTRY.query(f"WITH {CHECKED} SELECT rule_id, split, field, count(*) FILTER (actual IS NULL)::BIGINT AS n_missing, count(*) FILTER (actual <> expected)::BIGINT AS n_different FROM checked GROUP BY ALL")
def compatibility_mismatches(spark, d):
    checked = compatibility.check(table(spark, d, "calibration_cases"))
    return checked.groupBy("rule_id", "split", "field").agg(F.count_if(F.col("actual").isNull()).alias("n_missing"), replay.count(F.col("actual") != F.col("expected")).alias("n_different"))


REASON = "CASE WHEN any_value(expected) IS NULL THEN 'no_development_authority' WHEN bool_or(actual IS NULL) THEN 'requested_fit_compatibility_metadata_missing' WHEN NOT bool_or(coalesce(actual <> expected, false)) THEN 'compatible' WHEN NOT bool_or(coalesce(field <> 'returned_model' AND actual <> expected, false)) THEN 'requested_fit_model_mismatch' WHEN NOT bool_or(coalesce(field = 'returned_model' AND actual <> expected, false)) THEN 'requested_fit_prompt_mismatch' ELSE 'requested_fit_model_prompt_mismatch' END"


@REGISTRY.query(f"WITH {CHECKED} SELECT rule_id, split, {REASON} AS reason, count(DISTINCT case_id)::BIGINT AS n_cases FROM checked GROUP BY ALL")
def compatibility_reasons(spark, d):
    return compatibility.reasons(compatibility.check(table(spark, d, "calibration_cases")), "requested_fit")


@REGISTRY.query(f"WITH {CHECKED}, fit AS (SELECT case_id FROM checked GROUP BY case_id HAVING bool_and(coalesce(actual = expected, false))), {RULED.replace(CASES + ', ', '')} SELECT r.rule_id, count(*)::BIGINT AS n, count(*) FILTER (f.case_id IS NOT NULL)::BIGINT AS n_compatible, count(*) FILTER (f.case_id IS NOT NULL AND r.confirmed)::BIGINT AS n_confirmed FROM replayed r LEFT JOIN fit f USING (case_id) WHERE r.split <> 'development' GROUP BY r.rule_id")
def heldout_compatible_records(spark, d):
    fit = compatibility.check(table(spark, d, "calibration_cases")).groupBy("case_id").agg(F.min(F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))).alias("fit"))
    rows = _ruled(spark, d).filter("split <> 'development'").join(fit.filter("fit"), "case_id", "left")
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), replay.count(F.col("fit")).alias("n_compatible"), replay.count(F.col("fit") & F.col("confirmed")).alias("n_confirmed"))


# --- the search for thresholds, over development cases alone

LIMIT = 4096
STRICT = "CASE dim WHEN 1 THEN error_p IS NULL OR value <= error_p WHEN 2 THEN error_c IS NULL OR value <= error_c ELSE error_s IS NULL OR CASE WHEN descending THEN value >= error_s ELSE value <= error_s END END"
MASS = "list_sum(list_transform({0}_levels, lambda x: coalesce(map_extract_value(answer.probabilities, x), 0.0)))"
WIDTH = f"greatest(2, {LIMIT} // greatest(1, 2 * {{0}}))"
SEARCH = BASE + f""", dev AS (SELECT * FROM based WHERE split = 'development'), fixed AS (SELECT p.*, [0.0, 1.0] AS ends FROM policies p),
seen AS (
  SELECT rule_id, 1 AS dim, CASE type WHEN 'boolean' THEN CASE WHEN expected THEN answer.noul ELSE 1 - answer.noul END WHEN 'choice' THEN map_extract_value(answer.probabilities, answer.choice) ELSE coalesce({MASS.format('warning')}, 0.0) END AS value FROM dev WHERE warning_p IS NOT NULL
  UNION SELECT rule_id, 1, coalesce({MASS.format('error')}, 0.0) FROM dev WHERE warning_p IS NOT NULL AND type = 'score' AND len(warning_levels) > 0
  UNION SELECT rule_id, 1, unnest(ends || [warning_p, error_p]) FROM fixed WHERE warning_p IS NOT NULL
  UNION SELECT rule_id, 2, answer.confidence FROM dev WHERE warning_c IS NOT NULL AND type IN ('choice', 'score')
  UNION SELECT rule_id, 2, unnest(ends || [warning_c, error_c]) FROM fixed WHERE warning_c IS NOT NULL
  UNION SELECT rule_id, 3, answer.score FROM dev WHERE type = 'score' AND warning_s IS NOT NULL AND len(warning_levels) = 0 AND answer.score BETWEEN 0 AND 2
  UNION SELECT rule_id, 3, unnest(ends || [2.0, warning_s, error_s]) FROM fixed WHERE type = 'score' AND warning_s IS NOT NULL AND len(warning_levels) = 0
), dims AS (
  SELECT s.rule_id, dim, value, NULL::VARCHAR[] AS levels, round(abs(value - CASE dim WHEN 1 THEN warning_p WHEN 2 THEN warning_c ELSE warning_s END), 9) AS far FROM seen s JOIN policies USING (rule_id) WHERE value IS NOT NULL AND {STRICT}
  UNION ALL SELECT rule_id, 4, NULL, warning_levels[i:j], (len(warning_levels) - (j - i + 1))::DOUBLE FROM policies, range(1, 10) a(i), range(1, 10) b(j) WHERE type = 'score' AND i <= j AND j <= len(warning_levels) AND list_has_all(warning_levels[i:j], error_levels)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, dim ORDER BY far, value, array_to_string(levels, ',')) AS rank, count(*) OVER (PARTITION BY rule_id, dim) AS n FROM dims
), shape AS (
  SELECT rule_id, count(DISTINCT dim) AS n_dims, max(n) AS n_max, {WIDTH.format('count(DISTINCT dim)')} AS single, {WIDTH.format('(count(DISTINCT dim) * (count(DISTINCT dim) - 1) // 2)')} AS paired FROM ranked GROUP BY rule_id
), streams AS (
  SELECT rule_id, 0 AS phase, 0 AS rank, 0 AS stream, warning_p, warning_c, warning_s, warning_levels FROM policies JOIN shape USING (rule_id)
  UNION ALL SELECT r.rule_id, 1, rank, dim, CASE dim WHEN 1 THEN value ELSE warning_p END, CASE dim WHEN 2 THEN value ELSE warning_c END, CASE dim WHEN 3 THEN value ELSE warning_s END, CASE dim WHEN 4 THEN levels ELSE warning_levels END FROM ranked r JOIN shape USING (rule_id) JOIN policies USING (rule_id) WHERE rank <= single
  UNION ALL SELECT * FROM (SELECT a.rule_id, 2, (a.rank - 1) * b.n + b.rank AS rank, a.dim * 10 + b.dim, CASE WHEN a.dim = 1 THEN a.value WHEN b.dim = 1 THEN b.value ELSE warning_p END, CASE WHEN a.dim = 2 THEN a.value WHEN b.dim = 2 THEN b.value ELSE warning_c END, CASE WHEN a.dim = 3 THEN a.value WHEN b.dim = 3 THEN b.value ELSE warning_s END, CASE WHEN b.dim = 4 THEN b.levels ELSE warning_levels END
    FROM ranked a JOIN ranked b ON a.rule_id = b.rule_id AND a.dim < b.dim JOIN shape s ON s.rule_id = a.rule_id JOIN policies p ON p.rule_id = a.rule_id WHERE (a.rank - 1) * b.n + b.rank <= s.paired)
), each AS (
  SELECT rule_id, warning_p, warning_c, warning_s, warning_levels, min(struct_pack(phase := phase, rank := rank, stream := stream)) AS spot FROM streams GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY spot) - 1 AS place, count(*) OVER (PARTITION BY rule_id) AS n_all FROM each
), widest AS (
  SELECT x.rule_id, max(x.n * y.n) AS n_pairs FROM (SELECT DISTINCT rule_id, dim, n FROM ranked) x JOIN (SELECT DISTINCT rule_id, dim, n FROM ranked) y ON x.rule_id = y.rule_id AND x.dim < y.dim GROUP BY x.rule_id
), tried AS (
  SELECT p.rule_id, place, p.warning_p, p.warning_c, p.warning_s, p.warning_levels, n_max > single OR coalesce(n_pairs, 0) > paired OR n_dims > 2 OR n_all >= {LIMIT} AS truncated FROM placed p JOIN shape USING (rule_id) LEFT JOIN widest USING (rule_id) WHERE place < {LIMIT}
)"""
SCORED = SEARCH + ", sizes AS (SELECT rule_id, support, count(*) AS size FROM dev WHERE support IS NOT NULL GROUP BY ALL), crossed AS (SELECT d.* REPLACE (t.warning_p AS warning_p, t.warning_c AS warning_c, t.warning_s AS warning_s, t.warning_levels AS warning_levels), t.place, z.size FROM dev d JOIN tried t USING (rule_id) LEFT JOIN sizes z USING (rule_id, support)), " + assessed_sql("crossed", "judged") + f""", scored AS (
  SELECT rule_id, place, round(coalesce(sum({UTILITY.format(c='confirmed', s='signal')} / size) FILTER (support IS NOT NULL), 0.0), 9)::DOUBLE AS objective, count(*)::BIGINT AS n,
    {', '.join(f"count(*) FILTER (label = '{x}')::BIGINT AS {x.lower()}, count(*) FILTER (label = '{x}' AND confirmed)::BIGINT AS {x.lower()}_confirmed, count(*) FILTER (label = '{x}' AND signal AND NOT confirmed)::BIGINT AS {x.lower()}_tentative" for x in ('Agree', 'Partial', 'Disagree'))},
    count(DISTINCT support) FILTER (label = 'Agree')::BIGINT AS positive_groups, count(DISTINCT support) FILTER (label = 'Disagree')::BIGINT AS negative_groups,
    round(count(DISTINCT support) FILTER (label = 'Agree' AND signal) / nullif(count(DISTINCT support) FILTER (label = 'Agree'), 0)::DOUBLE, 9) AS recall
  FROM judged GROUP BY ALL)"""
CHOSEN = SCORED + """, compared AS (
  SELECT s.*, t.warning_p, t.warning_c, t.warning_s, t.warning_levels, t.truncated, (t.warning_p IS DISTINCT FROM p.warning_p)::INT + (t.warning_c IS DISTINCT FROM p.warning_c)::INT + (t.warning_s IS DISTINCT FROM p.warning_s)::INT + abs(len(p.warning_levels) - len(t.warning_levels)) AS changes,
    (s.agree_confirmed + s.agree_tentative > 0 OR s.agree = 0) AND coalesce(s.recall >= 0.5, false) AS able
  FROM scored s JOIN tried t USING (rule_id, place) JOIN policies p USING (rule_id)
), best AS (
  SELECT * FROM compared WHERE able QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY objective DESC, (place = 0) DESC, changes, coalesce(warning_p, -1) DESC, coalesce(warning_c, -1) DESC, coalesce(warning_s, -1) DESC, len(warning_levels) DESC) = 1
), why AS (
  SELECT b.rule_id, CASE WHEN b.positive_groups < 1 OR b.negative_groups < 1 THEN 'insufficient_labeled_support' WHEN b.agree > 0 AND NOT x.any_signal THEN 'no_positive_signal_candidate' WHEN NOT x.any_able THEN 'no_candidate_meets_review_list_recall' ELSE 'selected' END AS reason, x.n_tried, b.objective AS baseline_objective, b.truncated
  FROM compared b JOIN (SELECT rule_id, bool_or(agree_confirmed + agree_tentative > 0) AS any_signal, bool_or(able) AS any_able, count(*)::BIGINT AS n_tried FROM compared GROUP BY rule_id) x USING (rule_id) WHERE b.place = 0
), winners AS (
  SELECT w.rule_id, w.reason, c.place, c.objective, c.warning_p, c.warning_c, c.warning_s, c.warning_levels, w.baseline_objective, w.n_tried, w.truncated FROM why w LEFT JOIN best b USING (rule_id) JOIN compared c ON c.rule_id = w.rule_id AND c.place = CASE WHEN w.reason = 'selected' THEN b.place ELSE 0 END
)"""


def _development(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d).filter("split = 'development'").select("case_id", "rule_id", "split", "label", "adjudicated_severity", "answer", "context_complete", "support")


def _winners(spark: SparkSession, d: str) -> DataFrame:
    rows, policies = _development(spark, d), rule_policies(spark)
    tried = search.candidates(rows, policies, LIMIT)
    return search.choose(search.metrics(rows, policies, tried), tried, policies, min_recall=0.5)


@REGISTRY.query(f"WITH {SEARCH} SELECT rule_id, dim, count(*)::BIGINT AS n, min(value) AS least, max(value) AS most FROM dims GROUP BY ALL")
def candidate_dimensions(spark, d):
    return search.dimensions(_development(spark, d), rule_policies(spark)).groupBy("rule_id", "dim").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@REGISTRY.query(f"WITH {SEARCH} SELECT rule_id, place::INT AS place, warning_p, warning_c, warning_s, array_to_string(warning_levels, ',') AS levels, truncated FROM tried")
def threshold_candidates(spark, d):
    return search.candidates(_development(spark, d), rule_policies(spark), LIMIT).select("rule_id", "place", "warning_p", "warning_c", "warning_s", F.array_join("warning_levels", ",").alias("levels"), "truncated")


@REGISTRY.query(f"WITH {SCORED} SELECT * REPLACE (place::INT AS place) FROM scored")
def candidate_metrics(spark, d):
    rows, policies = _development(spark, d), rule_policies(spark)
    return search.metrics(rows, policies, search.candidates(rows, policies, LIMIT))


@REGISTRY.query(f"WITH {CHOSEN} SELECT rule_id, reason, place::INT AS place, objective, warning_p, warning_c, warning_s, array_to_string(warning_levels, ',') AS levels, baseline_objective, n_tried, truncated FROM winners")
def select_winner(spark, d):
    return _winners(spark, d).withColumn("levels", F.array_join("warning_levels", ",")).drop("warning_levels")


@REGISTRY.query(f"""WITH {CHOSEN}, again AS (SELECT b.* REPLACE (w.warning_p AS warning_p, w.warning_c AS warning_c, w.warning_s AS warning_s, w.warning_levels AS warning_levels) FROM based b JOIN winners w USING (rule_id) WHERE b.split <> 'development'), {assessed_sql('again', 'held')}
SELECT rule_id, split, count(*)::BIGINT AS n, count(*) FILTER (label = 'Agree')::BIGINT AS n_agree, count(*) FILTER (signal)::BIGINT AS n_signal, count(*) FILTER (signal AND label = 'Agree')::BIGINT AS n_right, count(*) FILTER (confirmed)::BIGINT AS n_confirmed FROM held GROUP BY ALL""")
def heldout_metrics(spark, d):
    best = _winners(spark, d).select("rule_id", *(F.col(c).alias(f"_{c}") for c in search.SEARCHED))
    policies = rule_policies(spark).join(best, "rule_id").select("rule_id", *(F.col(f"_{c}" if c in search.SEARCHED else c).alias(c) for c in search.POLICY_FIELDS))
    rows = replay.replay(table(spark, d, "calibration_cases"), policies).filter("split <> 'development'")
    return rows.groupBy("rule_id", "split").agg(F.count(F.lit(1)).alias("n"), replay.count(F.col("label") == "Agree").alias("n_agree"), replay.count(F.col("signal")).alias("n_signal"), replay.count(F.col("signal") & (F.col("label") == "Agree")).alias("n_right"), replay.count(F.col("confirmed")).alias("n_confirmed"))


@REGISTRY.query(f"WITH {CHOSEN} SELECT rule_id, 'warning' AS severity, field, before, after FROM (SELECT w.rule_id, unnest(['min_probability', 'min_confidence', 'score']) AS field, unnest([p.warning_p, p.warning_c, p.warning_s]) AS before, unnest([w.warning_p, w.warning_c, w.warning_s]) AS after FROM winners w JOIN policies p USING (rule_id)) WHERE before IS DISTINCT FROM after")
def changed_thresholds(spark, d):
    old = rule_policies(spark).select("rule_id", "warning_p", "warning_c", "warning_s")
    new = _winners(spark, d).select("rule_id", *(F.col(c).alias(f"n{c}") for c in ("warning_p", "warning_c", "warning_s")))
    parts = F.array(*(F.struct(F.lit(name).alias("field"), F.col(c).alias("before"), F.col(f"n{c}").alias("after")) for name, c in (("min_probability", "warning_p"), ("min_confidence", "warning_c"), ("score", "warning_s"))))
    rows = old.join(new, "rule_id").select("rule_id", F.lit("warning").alias("severity"), F.explode(parts).alias("x")).select("rule_id", "severity", "x.*")
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))

"""The queries of the engine's own operators, each with the SQL it is held against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.functions.assessment import DEFAULTS, assess, policies
from millrace.operators import discovery, packing, replay, retrieval, services
from millrace.operators.folds import running
from millrace.sources.frontend import parsed
from millrace.sources.tables import table
from millrace.streaming import answers

from .lineage import cut, keep
from .registry import Registry

REGISTRY = Registry()

CASES = "cases AS (SELECT * FROM calibration_cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ingested_at) = 1)"
UNITS = "valid AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY scanned_at DESC NULLS LAST, ingested_at DESC NULLS LAST, start_byte DESC NULLS LAST, end_byte DESC NULLS LAST) = 1)"
FILES = "files AS (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1)"
SPLIT = r"lower(regexp_replace(split, '[\s\-_]', '', 'g'))"
SUPPORT = "coalesce(" + ", ".join(f"CASE WHEN lower(trim(json_extract_string(provenance, '$.{f}'))) NOT IN ('', '-', 'none', 'n/a', 'unknown') THEN '{f}:' || lower(trim(json_extract_string(provenance, '$.{f}'))) END" for f in ("source_group", "scenario_group", "owner_group")) + ")"
# the same rules as the column expression, written out for the three default policies
ASSESSED = f"""{CASES}, a AS (
  SELECT case_id, rule_id, {SPLIT} AS split, label, adjudicated_severity, {SUPPORT} AS support, answer, target, context_complete, answer.type AS t, answer.noul AS p, answer.score AS s, answer.confidence AS c, answer.choice AS ch,
    CASE WHEN answer.type = 'choice' THEN map_extract_value(answer.probabilities, answer.choice) END AS cp
  FROM cases
), r AS (
  SELECT *, CASE
    WHEN t = 'choice' AND ch = 'unclear' THEN 'unknown|missing_evidence||'
    WHEN t = 'boolean' AND p >= 0.9 THEN CASE WHEN p >= 0.4 AND p < 0.6 THEN 'unknown|probability_ambiguous||error' ELSE 'error||error|' END
    WHEN t = 'choice' AND ch = 'lost' AND cp >= 0.92 THEN CASE WHEN c IS NULL OR c < 0.7 THEN 'unknown|low_confidence||error' ELSE 'error||error|' END
    WHEN t = 'score' AND s >= 2.0 THEN CASE WHEN c IS NULL OR c < 0.7 THEN 'unknown|low_confidence||error' ELSE 'error||error|' END
    WHEN t = 'boolean' AND p >= 0.71 THEN 'warning||warning|'
    WHEN t = 'choice' AND ch = 'lost' AND cp >= 0.6 THEN CASE WHEN c IS NULL OR c < 0.45 THEN 'unknown|low_confidence||warning' ELSE 'warning||warning|' END
    WHEN t = 'score' AND s >= 1.0 THEN CASE WHEN c IS NULL OR c < 0.6 THEN 'unknown|low_confidence||warning' ELSE 'warning||warning|' END
    WHEN t = 'boolean' AND p >= 0.4 AND p < 0.6 THEN 'unknown|probability_ambiguous||'
    WHEN t = 'choice' AND c < 0.45 THEN 'unknown|low_confidence||'
    WHEN t = 'score' AND c < 0.6 THEN 'unknown|low_confidence||'
    WHEN t = 'choice' AND cp < 0.6 THEN 'unknown|low_choice_probability||'
    WHEN t = 'choice' AND ch = 'lost' THEN 'unknown|weak_defect_signal||'
    WHEN NOT coalesce(context_complete, false) THEN 'unknown|reduced_context||'
    ELSE 'ok|||' END AS o
  FROM a
), replayed AS (
  SELECT *, split_part(o, '|', 1) AS status, nullif(split_part(o, '|', 2), '') AS reason, nullif(split_part(o, '|', 3), '') AS severity, nullif(split_part(o, '|', 4), '') AS tentative,
    split_part(o, '|', 3) <> '' AS confirmed, split_part(o, '|', 3) <> '' OR split_part(o, '|', 4) <> '' AS signal
  FROM r
)"""
UTILITY = "CASE label WHEN 'Agree' THEN CASE WHEN {c} THEN 4.0 WHEN {s} THEN 2.0 ELSE -4.0 END WHEN 'Partial' THEN CASE WHEN {c} THEN -1.0 WHEN {s} THEN 1.0 ELSE 0.0 END WHEN 'Disagree' THEN CASE WHEN {c} THEN -8.0 WHEN {s} THEN -2.0 ELSE 0.0 END END"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(table(spark, d, "calibration_cases"), policies(spark))


def _units(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return retrieval.latest_units(table(spark, d, "units"), *columns)


# --- classification and its aggregates


@REGISTRY.query(f"WITH {ASSESSED} SELECT case_id, status, reason, severity, tentative FROM replayed")
def assess_cases(spark, d):
    return _records(spark, d).select("case_id", "status", "reason", "severity", "tentative")


@REGISTRY.query(f"WITH {ASSESSED} SELECT rule_id, status, count(*)::BIGINT AS n FROM replayed GROUP BY ALL")
def scan_status_counts(spark, d):
    return _records(spark, d).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(f"WITH {CASES} SELECT case_id, CASE WHEN 1 - answer.noul >= 0.9 THEN 'error' WHEN 1 - answer.noul >= 0.71 THEN 'warning' WHEN answer.noul >= 0.4 AND answer.noul < 0.6 THEN 'unknown' WHEN NOT context_complete THEN 'unknown' ELSE 'ok' END AS status FROM cases WHERE answer.type = 'boolean'")
def assess_inverse_boolean(spark, d):
    rule = [("boolean", False, *DEFAULTS[0][2:])]
    return replay.replay(table(spark, d, "calibration_cases"), policies(spark, rule)).select("case_id", "status")


@REGISTRY.query(f"""WITH {CASES}, m AS (SELECT case_id, answer.confidence AS c, context_complete AS k, coalesce(map_extract_value(answer.probabilities, '2'), 0.0) AS hi, coalesce(map_extract_value(answer.probabilities, '1'), 0.0) + coalesce(map_extract_value(answer.probabilities, '2'), 0.0) AS lo FROM cases WHERE answer.type = 'score')
SELECT case_id, CASE WHEN hi >= 0.5 THEN CASE WHEN c >= 0.4 THEN 'error' ELSE 'unknown' END WHEN round(lo, 9) >= 0.7 THEN CASE WHEN c >= 0.3 THEN 'warning' ELSE 'unknown' END WHEN c < 0.3 THEN 'unknown' WHEN NOT k THEN 'unknown' ELSE 'ok' END AS status FROM m""")
def assess_score_mass(spark, d):
    # the gate sits a hair below 0.7, as sums of binary fractions may fall short of it
    rule = [("score", True, None, None, 0.7 - 5e-10, 0.3, 0.5, 0.4, None, None, ["1", "2"], ["2"], [], [], [], False)]
    return replay.replay(table(spark, d, "calibration_cases"), policies(spark, rule)).select("case_id", "status")


@REGISTRY.query(f"WITH {ASSESSED} SELECT rule_id, coalesce(adjudicated_severity, 'none') AS adjudicated, count(*) FILTER (status = 'ok')::BIGINT AS ok, count(*) FILTER (status = 'warning')::BIGINT AS warning, count(*) FILTER (status = 'error')::BIGINT AS error, count(*) FILTER (status = 'unknown')::BIGINT AS unknown FROM replayed GROUP BY ALL")
def severity_confusion(spark, d):
    rows = _records(spark, d).withColumn("adjudicated", F.coalesce("adjudicated_severity", F.lit("none")))
    return rows.groupBy("rule_id", "adjudicated").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "error", "unknown")))


@REGISTRY.query(f"WITH {ASSESSED} SELECT rule_id, count(*)::BIGINT AS n, count(*) FILTER (severity = adjudicated_severity)::BIGINT AS agreed, count(*) FILTER (coalesce(severity, tentative) = adjudicated_severity)::BIGINT AS agreed_tentative FROM replayed WHERE adjudicated_severity IS NOT NULL GROUP BY rule_id")
def severity_agreement(spark, d):
    rows = _records(spark, d).filter("adjudicated_severity IS NOT NULL")
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), replay.count(F.col("severity") == F.col("adjudicated_severity")).alias("agreed"), replay.count(F.coalesce("severity", "tentative") == F.col("adjudicated_severity")).alias("agreed_tentative"))


@REGISTRY.query(f"""WITH {ASSESSED}, g AS (SELECT rule_id, split, count(*)::BIGINT AS n, count(*) FILTER (confirmed)::BIGINT AS n_confirmed, count(*) FILTER (signal)::BIGINT AS n_signal, count(*) FILTER (confirmed AND label = 'Agree')::BIGINT AS agree_confirmed, count(*) FILTER (signal AND label = 'Agree')::BIGINT AS agree_signal,
  count(*) FILTER (label = 'Agree')::BIGINT AS n_agree, count(*) FILTER (confirmed AND label = 'Disagree')::BIGINT AS disagree_confirmed, count(*) FILTER (signal AND label = 'Partial')::BIGINT AS partial_signal, count(*) FILTER (status = 'unknown')::BIGINT AS n_unknown FROM replayed GROUP BY ALL)
SELECT *, round(agree_confirmed / nullif(n_confirmed, 0)::DOUBLE, 6) AS precision, round(agree_confirmed / nullif(n_agree, 0)::DOUBLE, 6) AS recall, round(agree_signal / nullif(n_agree, 0)::DOUBLE, 6) AS review_recall FROM g""")
def replay_report(spark, d):
    return replay.report(_records(spark, d))


@REGISTRY.query(f"WITH {ASSESSED}, g AS (SELECT rule_id, support, sum({UTILITY.format(c='confirmed', s='signal')}) AS u, count(*) AS n FROM replayed WHERE support IS NOT NULL GROUP BY ALL) SELECT rule_id, round(sum(u / n), 6)::DOUBLE AS objective, count(*)::BIGINT AS n_groups FROM g GROUP BY rule_id")
def weighted_utility(spark, d):
    return replay.weighted_utility(_records(spark, d))


@REGISTRY.query(f"WITH {ASSESSED}, g AS (SELECT rule_id, support, bool_or(signal) AS hit FROM replayed WHERE label = 'Agree' AND support IS NOT NULL GROUP BY ALL) SELECT rule_id, count(*)::BIGINT AS n_groups, count(*) FILTER (hit)::BIGINT AS n_hit FROM g GROUP BY rule_id")
def review_list_recall(spark, d):
    return replay.review_list_recall(_records(spark, d))


@REGISTRY.query(f"WITH {ASSESSED}, g AS (SELECT rule_id, support, avg(signal::INT) AS r FROM replayed WHERE label = 'Agree' AND support IS NOT NULL GROUP BY ALL) SELECT rule_id, round(avg(r), 6) AS within_group FROM g GROUP BY rule_id")
def within_group_recall(spark, d):
    rows = _records(spark, d).filter("label = 'Agree' AND support IS NOT NULL").groupBy("rule_id", "support").agg(F.avg(F.col("signal").cast("int")).alias("r"))
    return rows.groupBy("rule_id").agg(F.round(F.avg("r"), 6).alias("within_group"))


@REGISTRY.query(f"WITH {ASSESSED} SELECT rule_id, label, count(DISTINCT support)::BIGINT AS n_groups, count(*) FILTER (support IS NULL)::BIGINT AS n_without FROM replayed GROUP BY ALL")
def support_groups(spark, d):
    rows = _records(spark, d).groupBy("rule_id", "label", "support").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("rule_id", "label").agg(F.count("support").alias("n_groups"), F.coalesce(F.sum(F.when(F.col("support").isNull(), F.col("n"))), F.lit(0)).alias("n_without"))


@REGISTRY.query(f"WITH {ASSESSED} SELECT support, count(*)::BIGINT AS n, count(DISTINCT split)::BIGINT AS n_splits FROM replayed WHERE support IS NOT NULL GROUP BY support HAVING count(*) FILTER (split = 'development') > 0 AND count(*) FILTER (split <> 'development') > 0")
def split_leakage(spark, d):
    rows = _records(spark, d).filter("support IS NOT NULL").groupBy("support", "split").agg(F.count(F.lit(1)).alias("n"))
    out = rows.groupBy("support").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_splits"), F.max(F.col("split") == "development").alias("dev"), F.max(F.col("split") != "development").alias("other"))
    return out.filter("dev AND other").select("support", "n", "n_splits")


@REGISTRY.query(f"WITH {ASSESSED}, t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS threshold) SELECT threshold::DOUBLE AS threshold, label, count(*)::BIGINT AS n, count(*) FILTER (p >= threshold)::BIGINT AS n_signal FROM replayed, t WHERE answer.type = 'boolean' GROUP BY ALL")
def threshold_sweep(spark, d):
    rows = _records(spark, d).filter("answer.type = 'boolean'").withColumn("threshold", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.9)))))
    return rows.groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("answer.noul") >= F.col("threshold")).alias("n_signal"))


@REGISTRY.query(f"""WITH {CASES}, x AS (SELECT rule_id, case_id, least(2, greatest(0, floor(answer.score + 0.5)))::INT AS nearest, CASE WHEN map_extract_value(answer.probabilities, '0') >= map_extract_value(answer.probabilities, '1') AND map_extract_value(answer.probabilities, '0') >= map_extract_value(answer.probabilities, '2') THEN 0 WHEN map_extract_value(answer.probabilities, '1') >= map_extract_value(answer.probabilities, '2') THEN 1 ELSE 2 END AS argmax FROM cases WHERE answer.type = 'score' AND answer.score IS NOT NULL AND len(map_keys(answer.probabilities)) = 3)
SELECT rule_id, nearest, argmax, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def nearest_argmax_levels(spark, d):
    rows = replay.known_cases(table(spark, d, "calibration_cases"), "rule_id", "answer").filter("answer.type = 'score' AND answer.score IS NOT NULL AND size(answer.probabilities) = 3")
    best = F.array_max(F.transform(F.map_entries("answer.probabilities"), lambda e: F.struct(e.value.alias("p"), (-e.key.cast("int")).alias("k"))))
    nearest = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.col("answer.score") + 0.5))).cast("int")
    return rows.select("rule_id", nearest.alias("nearest"), (-best.k).alias("argmax")).groupBy("rule_id", "nearest", "argmax").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(f"WITH {ASSESSED}, f AS (SELECT target.path AS path, rule_id, min(status) AS status, max(signal::INT) AS signal FROM replayed GROUP BY ALL) SELECT path, count(*)::BIGINT AS n_rules, string_agg(rule_id || '=' || status, ',' ORDER BY rule_id) AS statuses, sum(signal)::BIGINT AS n_signal FROM f GROUP BY path")
def target_event_rollup(spark, d):
    rows = replay.replay(table(spark, d, "calibration_cases"), policies(spark))
    paths = replay.known_cases(table(spark, d, "calibration_cases"), "target").select("case_id", F.col("target.path").alias("path"))
    one = rows.join(paths, "case_id").groupBy("path", "rule_id").agg(F.min("status").alias("status"), F.max(F.col("signal").cast("int")).alias("signal"))
    return one.groupBy("path").agg(F.count(F.lit(1)).alias("n_rules"), F.array_join(F.array_sort(F.collect_list(F.concat("rule_id", F.lit("="), "status"))), ",").alias("statuses"), F.sum("signal").alias("n_signal"))


@REGISTRY.query(f"""WITH {CASES}, adj AS (SELECT DISTINCT case_id, label, adjudicated_at, adjudication_id FROM adjudications), last AS (SELECT case_id, label FROM adj QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY adjudicated_at DESC, adjudication_id DESC) = 1)
SELECT c.case_id, coalesce(l.label, c.label) AS label, l.label IS NOT NULL AND l.label <> c.label AS overridden FROM cases c LEFT JOIN last l USING (case_id)""")
def reassess_coalesce(spark, d):
    last = table(spark, d, "adjudications").groupBy("case_id").agg(F.max_by("label", F.struct("adjudicated_at", "adjudication_id")).alias("new"))
    rows = replay.known_cases(table(spark, d, "calibration_cases"), "label").join(last, "case_id", "left")
    return rows.select("case_id", F.coalesce("new", "label").alias("label"), F.coalesce(F.col("new") != F.col("label"), F.lit(False)).alias("overridden"))


@REGISTRY.query("""WITH c AS (SELECT DISTINCT case_id FROM calibration_cases), a AS (SELECT DISTINCT case_id FROM adjudications)
SELECT CASE WHEN c.case_id IS NULL THEN 'unknown_case' WHEN a.case_id IS NULL THEN 'without_label' ELSE 'labelled' END AS state, count(*)::BIGINT AS n FROM c FULL JOIN a USING (case_id) GROUP BY ALL""")
def import_label_join(spark, d):
    c = table(spark, d, "calibration_cases", "case_id").distinct().withColumn("is_case", F.lit(True))
    a = table(spark, d, "adjudications", "case_id").distinct().withColumn("is_label", F.lit(True))
    state = F.when(F.col("is_case").isNull(), "unknown_case").when(F.col("is_label").isNull(), "without_label").otherwise("labelled")
    return c.join(a, "case_id", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(f"""WITH {CASES}, x AS (SELECT rule_id, case_id, unnest(map_entries(evidence.source_documents)) AS e, hashes FROM cases)
SELECT rule_id, count(*)::BIGINT AS n_documents, count(*) FILTER (lower(map_extract_value(hashes.source_documents, e.key)) = sha256(e.value))::BIGINT AS n_matching FROM x GROUP BY rule_id""")
def identity_hashes(spark, d):
    # a case's documents are reduced to two counts where they lie, and cases made unique after
    documents = F.map_entries("evidence.source_documents")
    same = F.filter(documents, lambda x: F.coalesce(F.lower(F.try_element_at("hashes.source_documents", x.key)) == F.sha2(x.value, 256), F.lit(False)))
    rows = table(spark, d, "calibration_cases").select("case_id", "rule_id", F.size(documents).alias("n"), F.size(same).alias("m")).dropDuplicates(["case_id"]).filter("n > 0")
    return rows.groupBy("rule_id").agg(F.sum("n").alias("n_documents"), F.sum("m").alias("n_matching"))


# --- intervals, lines and ownership


@REGISTRY.query(f"""WITH {UNITS}, s AS (SELECT path, start_byte AS s, end_byte AS e FROM valid WHERE start_byte < end_byte), w AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s), g AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM w)
SELECT path, min(s) AS start_byte, max(e) AS end_byte FROM g GROUP BY path, i""")
def span_merge(spark, d):
    return spans.merge_spans(_units(spark, d, "path", "start_byte", "end_byte"), "path")


@REGISTRY.query(f"""WITH {UNITS}, {FILES}, s AS (SELECT path, start_byte AS s, end_byte AS e FROM valid WHERE start_byte < end_byte), w AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s), g AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM w),
m AS (SELECT path, min(s) AS s, max(e) AS e FROM g GROUP BY path, i), f AS (SELECT path, strlen(content) AS size FROM files WHERE content IS NOT NULL), r AS (SELECT path, s, e FROM m WHERE path IN (SELECT path FROM f) UNION ALL SELECT path, size, size FROM f)
SELECT path, coalesce(lag(e) OVER (PARTITION BY path ORDER BY s, e), 0)::BIGINT AS start_byte, s::BIGINT AS end_byte FROM r QUALIFY start_byte < end_byte""")
def span_coverage_gaps(spark, d):
    merged = spans.merge_spans(_units(spark, d, "path", "start_byte", "end_byte"), "path")
    sizes = table(spark, d, "source_files", "path", "content").filter("content IS NOT NULL").select("path", F.octet_length("content").cast("bigint").alias("size")).dropDuplicates(["path"])
    return spans.gaps(merged, sizes, "path", "size")


@REGISTRY.query(f"""WITH {UNITS}, {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM files WHERE content IS NOT NULL), b AS (SELECT path, k, sum(strlen(t) + 1) OVER (PARTITION BY path ORDER BY k) - strlen(t) - 1 AS at FROM l)
SELECT v.unit_id, count(*) FILTER (b.at <= v.start_byte)::INT AS first_line, count(*) FILTER (b.at <= greatest(v.start_byte, v.end_byte - 1))::INT AS last_line FROM valid v JOIN b USING (path) JOIN files f USING (path) WHERE v.start_byte >= 0 AND v.end_byte > v.start_byte AND v.end_byte <= strlen(f.content) GROUP BY v.unit_id""")
def line_locations(spark, d):
    files = table(spark, d, "source_files", "path", "content").dropDuplicates(["path"])
    return spans.read(_units(spark, d, "path", "start_byte", "end_byte"), files, "unit_id").select("unit_id", "first_line", "last_line")


@REGISTRY.query(f"""WITH {UNITS}, p AS (SELECT DISTINCT diag_id, path, line FROM diagnostics WHERE line IS NOT NULL) SELECT p.diag_id, p.path, p.line, u.unit_id FROM p LEFT JOIN (SELECT p.diag_id, v.unit_id FROM p JOIN valid v ON v.path = p.path AND v.start_line <= p.line AND p.line <= v.end_line QUALIFY row_number() OVER (PARTITION BY p.diag_id ORDER BY v.end_line - v.start_line, v.start_line, v.unit_id) = 1) u USING (diag_id)""")
def innermost_owner(spark, d):
    points = table(spark, d, "diagnostics", "diag_id", "path", "line").filter("line IS NOT NULL").distinct()
    return spans.innermost(points, _units(spark, d, "path", "start_line", "end_line"), "path", "line", "start_line", "end_line", ["diag_id"], "unit_id").select("diag_id", "path", "line", "unit_id")


@REGISTRY.query(f"WITH {UNITS} SELECT a.unit_id, count(*)::BIGINT AS n_inside FROM valid a JOIN valid b ON a.path = b.path AND b.start_byte >= a.start_byte AND b.end_byte <= a.end_byte AND b.unit_id <> a.unit_id WHERE a.start_byte < a.end_byte AND b.start_byte < b.end_byte GROUP BY a.unit_id")
def span_contains(spark, d):
    rows = spans.n_inside(_units(spark, d, "path", "start_byte", "end_byte"), "path")
    return rows.filter("n_inside > 0").select("unit_id", "n_inside")


@REGISTRY.query(f"WITH {UNITS}, s AS (SELECT *, max(end_byte) OVER (PARTITION BY path ORDER BY start_byte, end_byte, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM valid WHERE start_byte < end_byte) SELECT path, count(*)::BIGINT AS n_overlaps FROM s WHERE start_byte < ahead AND end_byte > ahead GROUP BY path")
def overlap_detect(spark, d):
    w = Window.partitionBy("path").orderBy("start_byte", "end_byte", "unit_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _units(spark, d, "path", "start_byte", "end_byte").filter("start_byte < end_byte").withColumn("ahead", F.max("end_byte").over(w))
    return rows.filter("start_byte < ahead AND end_byte > ahead").groupBy("path").agg(F.count(F.lit(1)).alias("n_overlaps"))


@REGISTRY.query(f"WITH {UNITS} SELECT u.unit_id, count(c.unit_id)::BIGINT AS n_members, any_value(u.member_count) AS declared FROM valid u LEFT JOIN valid c ON c.parent_id = u.unit_id WHERE u.kind IN ('class', 'impl', 'package', 'struct') GROUP BY u.unit_id")
def member_counts(spark, d):
    units = _units(spark, d, "parent_id", "kind", "member_count")
    members = units.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("unit_id")).agg(F.count(F.lit(1)).alias("n"))
    owners = units.filter("kind IN ('class', 'impl', 'package', 'struct')").select("unit_id", F.col("member_count").alias("declared"))
    return owners.join(members, "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("n_members"), "declared")


@REGISTRY.query(f"WITH RECURSIVE {UNITS}, up AS (SELECT unit_id, parent_id, 0 AS depth FROM valid UNION ALL SELECT up.unit_id, v.parent_id, up.depth + 1 FROM up JOIN valid v ON up.parent_id = v.unit_id) SELECT unit_id, max(depth)::INT AS depth FROM up GROUP BY unit_id")
def parent_chain(spark, d):
    units = keep(_units(spark, d, "parent_id").filter("parent_id IS NOT NULL"))
    every = _units(spark, d, "parent_id").select("unit_id")
    # paths of doubled length each round, until none goes on; a parent that is no unit ends a path
    known = units.join(every.select(F.col("unit_id").alias("parent_id")), "parent_id", "left_semi")
    jumps = cut(known.select("unit_id", F.col("parent_id").alias("up"), F.lit(1).alias("n")))
    while True:
        ahead = jumps.select(F.col("unit_id").alias("up"), F.col("up").alias("over"), F.col("n").alias("more"))
        longer = cut(jumps.join(ahead, "up", "left").select("unit_id", F.coalesce("over", "up").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.col("over").isNotNull().alias("moved")))
        jumps = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
    top = jumps.join(units.select(F.col("unit_id").alias("up"), F.lit(1).alias("last")), "up", "left").select("unit_id", (F.col("n") + F.coalesce("last", F.lit(0))).alias("n"))
    lost = units.join(known.select("unit_id"), "unit_id", "left_anti").select("unit_id", F.lit(1).alias("n")).limit(0)
    return every.join(top.unionByName(lost), "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("depth"))


@REGISTRY.query(f"WITH {UNITS} SELECT c.unit_id, CASE WHEN c.kind = 'function' AND p.kind IN ('class', 'impl', 'trait', 'interface') THEN 'method' ELSE c.kind END AS kind, coalesce(p.qualified_name || CASE WHEN ends_with(c.path, '.rs') OR regexp_matches(c.path, '\\.(pl|pm|t)$') THEN '::' ELSE '.' END, '') || c.name AS built, c.qualified_name FROM valid c LEFT JOIN valid p ON c.parent_id = p.unit_id")
def qualified_names(spark, d):
    units = _units(spark, d, "path", "kind", "name", "qualified_name", "parent_id")
    parents = units.select(F.col("unit_id").alias("parent_id"), F.col("qualified_name").alias("_q"), F.col("kind").alias("_k"))
    joint = F.when(F.col("path").rlike(r"\.(rs|pl|pm|t)$"), "::").otherwise(".")
    kind = F.when((F.col("kind") == "function") & F.col("_k").isin("class", "impl", "trait", "interface"), "method").otherwise(F.col("kind"))
    return units.join(parents, "parent_id", "left").select("unit_id", kind.alias("kind"), F.concat(F.coalesce(F.concat("_q", joint), F.lit("")), "name").alias("built"), "qualified_name")


@REGISTRY.query(f"""WITH {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM files WHERE content IS NOT NULL), p AS (SELECT path, k, sha256(trim(t)) AS digest FROM l WHERE regexp_matches(trim(t), '^(if|unless|elif|elsif|for|foreach|while|return|let|const|my) [^ ]'))
SELECT path, digest, k::INT AS line, lead(k) OVER w::INT AS next_line, (lead(k) OVER w - k - 1)::INT AS gap, count(*) OVER (PARTITION BY path, digest)::BIGINT AS n FROM p WINDOW w AS (PARTITION BY path, digest ORDER BY k) QUALIFY next_line IS NOT NULL""")
def repeated_statements(spark, d):
    lines = table(spark, d, "source_files", "file_id", "path", "content").filter("content IS NOT NULL").select("path", F.posexplode(F.split("content", "\n")).alias("k", "t"))
    rows = lines.filter(F.trim("t").rlike("^(if|unless|elif|elsif|for|foreach|while|return|let|const|my) [^ ]")).select("path", F.sha2(F.trim("t"), 256).alias("digest"), (F.col("k") + 1).alias("line")).dropDuplicates(["path", "line"])
    w = Window.partitionBy("path", "digest").orderBy("line")
    rows = rows.withColumn("next_line", F.lead("line").over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path", "digest")))
    return rows.filter("next_line IS NOT NULL").withColumn("gap", F.col("next_line") - F.col("line") - 1)


# --- planning: checks, facts, budgets, packing


@REGISTRY.query(f"WITH {UNITS} SELECT path, string_agg(DISTINCT f, ',' ORDER BY f) AS facts FROM (SELECT path, unnest(syntax_facts) AS f FROM valid) GROUP BY path")
def file_facts(spark, d):
    rows = _units(spark, d, "path", "syntax_facts").select("path", F.explode("syntax_facts").alias("f")).distinct()
    return rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("facts"))


REQUESTS = "requests AS (SELECT * FROM budget_estimates QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY estimated_at DESC, ingested_at DESC) = 1)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return services.latest(table(spark, d, "budget_estimates"), ["request_id"], ["estimated_at", "ingested_at"])


@REGISTRY.query(f"WITH {REQUESTS} SELECT request_id, array_to_string(list_filter([CASE WHEN body_bytes > max_body_bytes THEN 'bytes' END, CASE WHEN context_tokens > max_context_tokens THEN 'context' END, CASE WHEN questions > max_questions THEN 'questions' END], lambda x: x IS NOT NULL), ',') AS violations FROM requests JOIN pack_limits USING (model) WHERE body_bytes > max_body_bytes OR context_tokens > max_context_tokens OR questions > max_questions")
def budget_violations(spark, d):
    rows = _requests(spark, d).join(F.broadcast(table(spark, d, "pack_limits")), "model")  # one row a model
    which = F.array_compact(F.array(F.when(F.col("body_bytes") > F.col("max_body_bytes"), "bytes"), F.when(F.col("context_tokens") > F.col("max_context_tokens"), "context"), F.when(F.col("questions") > F.col("max_questions"), "questions")))
    return rows.select("request_id", F.array_join(which, ",").alias("violations")).filter("violations <> ''")


@REGISTRY.query(f"WITH RECURSIVE {REQUESTS}, o AS (SELECT path, request_id, greatest(body_bytes, 0) AS s, row_number() OVER (PARTITION BY path ORDER BY request_id) AS k FROM requests), f AS (SELECT path, request_id, s, k, 0 AS batch, s AS total FROM o WHERE k = 1 UNION ALL SELECT o.path, o.request_id, o.s, o.k, CASE WHEN f.total + o.s > 100000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.total + o.s > 100000 THEN o.s ELSE f.total + o.s END FROM f JOIN o ON o.path = f.path AND o.k = f.k + 1) SELECT path, request_id, s::BIGINT AS size, batch FROM f")
def greedy_packing(spark, d):
    rows = _requests(spark, d).select("path", "request_id", F.greatest("body_bytes", F.lit(0)).alias("size"))
    return packing.next_fit(rows, "path", "request_id", "size", 100_000)


@REGISTRY.query(f"WITH {REQUESTS} SELECT path, request_id, ((row_number() OVER (PARTITION BY path ORDER BY request_id) - 1) // 3)::INT AS chunk FROM requests")
def question_chunks(spark, d):
    return packing.chunks(_requests(spark, d).select("path", "request_id"), "path", "request_id", 3)


@REGISTRY.query(f"WITH {REQUESTS} SELECT path, request_id, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY request_id) <= count(*) OVER (PARTITION BY path) // 2 THEN 0 ELSE 1 END AS half FROM requests")
def preflight_halves(spark, d):
    return packing.halves(_requests(spark, d).select("path", "request_id"), "path", "request_id")


@REGISTRY.query(f"WITH {REQUESTS} SELECT model, scope, count(*)::BIGINT AS n, sum(questions)::BIGINT AS questions, sum(total_tokens)::BIGINT AS tokens, sum(body_bytes)::BIGINT AS bytes, count(*) FILTER (context_tokens IS NULL)::BIGINT AS n_unknown FROM requests GROUP BY ALL")
def plan_report(spark, d):
    return _requests(spark, d).groupBy("model", "scope").agg(F.count(F.lit(1)).alias("n"), F.sum("questions").alias("questions"), F.sum("total_tokens").alias("tokens"), F.sum("body_bytes").alias("bytes"), F.count_if(F.col("context_tokens").isNull()).alias("n_unknown"))


@REGISTRY.query(f"WITH {REQUESTS} SELECT request_id, model, round(min(greatest(1.0, least(8.0, body_bytes / context_tokens * 0.9))) OVER (PARTITION BY model ORDER BY estimated_at, request_id ROWS UNBOUNDED PRECEDING), 6) AS bytes_per_token FROM requests WHERE context_tokens > 0 AND body_bytes > 0")
def token_calibration_running_min(spark, d):
    rows = _requests(spark, d).filter("context_tokens > 0 AND body_bytes > 0")
    return services.running_calibration(rows, "model", ["estimated_at", "request_id"], "body_bytes", "context_tokens").select("request_id", "model", "bytes_per_token")


# --- retrieval


DEFS = rf"defs AS (SELECT unit_id, path, regexp_extract(qualified_name, '([^.:]*)$', 1) AS name FROM valid WHERE kind IN ('function', 'method'))"
LANGUAGE_SQL = r"CASE WHEN regexp_matches(lower({0}), '\.(py|pyi)$') THEN 'python' WHEN regexp_matches(lower({0}), '\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower({0}), '\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(lower({0}), '\.rs$') THEN 'rust' WHEN regexp_matches(lower({0}), '\.(pl|pm|t)$') THEN 'perl' END"
STRIP = "regexp_replace({0}, CASE WHEN regexp_matches(lower({1}), '\\.(pyi?|p[lm]|t)$') THEN '" + spans.STRIPPED["#"].replace("'", "''") + "' ELSE '" + spans.STRIPPED["//"].replace("'", "''") + "' END, ' ', 'g')"
CALLS = rf"calls AS (SELECT path, name, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all({STRIP.format('content', 'path')}, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS name FROM (SELECT path, any_value(content) AS content FROM source_files WHERE content IS NOT NULL GROUP BY path)) GROUP BY ALL)"
FOUND = f"{UNITS}, {DEFS}, {CALLS}, found AS (SELECT d.unit_id, d.path, c.path AS caller, c.n FROM defs d JOIN calls c USING (name) WHERE d.path <> c.path)"
SAME_REPO = "(split_part(path, '/', 1) || '/' || split_part(path, '/', 2) <> split_part(caller, '/', 1) || '/' || split_part(caller, '/', 2))"


@REGISTRY.query(f"WITH {UNITS}, {DEFS} SELECT name, count(*)::BIGINT AS n_units, count(DISTINCT path)::BIGINT AS n_paths FROM defs GROUP BY name")
def definition_index(spark, d):
    return retrieval.definitions(table(spark, d, "units")).groupBy("name").agg(F.count(F.lit(1)).alias("n_units"), F.countDistinct("path").alias("n_paths"))


@REGISTRY.query(f"WITH {CALLS} SELECT name, count(*)::BIGINT AS n_paths, sum(n)::BIGINT AS n_calls FROM calls GROUP BY name")
def reference_index(spark, d):
    return retrieval.references(table(spark, d, "source_files")).groupBy("name").agg(F.count(F.lit(1)).alias("n_paths"), F.sum("n").alias("n_calls"))


@REGISTRY.query(f"WITH {FOUND} SELECT unit_id, count(*)::BIGINT AS n_callers, sum(n)::BIGINT AS n_calls FROM found GROUP BY unit_id")
def caller_candidates(spark, d):
    n = retrieval.caller_counts(table(spark, d, "units"), table(spark, d, "source_files"))
    return n.select("unit_id", (F.col("near") + F.col("far")).alias("n_callers"), "n_calls").filter("n_callers > 0")


@REGISTRY.query(f"WITH {FOUND} SELECT unit_id, caller, row_number() OVER (PARTITION BY unit_id ORDER BY {SAME_REPO}::INT, n DESC, caller)::INT AS rank FROM found QUALIFY rank <= 5")
def candidate_topk(spark, d):
    return retrieval.top_candidates(retrieval.candidates(table(spark, d, "units"), table(spark, d, "source_files"), 5), 5).select("unit_id", "caller", "rank")


@REGISTRY.query(f"WITH {FOUND}, pool AS (SELECT unit_id, caller, CASE WHEN {SAME_REPO} THEN 'far' ELSE 'near' END AS family, row_number() OVER (PARTITION BY unit_id, family ORDER BY n DESC, caller) AS turn FROM found), first AS (SELECT unit_id, caller, min(struct_pack(turn := turn, family := family)) AS m FROM pool GROUP BY ALL) SELECT unit_id, caller, row_number() OVER (PARTITION BY unit_id ORDER BY m.turn, m.family)::INT AS place FROM first QUALIFY place <= 6")
def fair_union_pool(spark, d):
    found = retrieval.candidates(table(spark, d, "units"), table(spark, d, "source_files"), 6)
    return retrieval.fair_union(found, "unit_id", "family", "caller", [F.desc("n"), F.asc("caller")]).filter("place <= 6")


@REGISTRY.query(f"WITH {FILES}, r AS (SELECT path, repo, content IS NULL AS unreadable, coalesce(sum(strlen(content)) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING), 0) AS total, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM files) SELECT repo, count(*) FILTER (total <= 50000 AND k <= 20 AND NOT unreadable)::BIGINT AS n_in, count(*) FILTER (k > 20)::BIGINT AS n_over_files, count(*) FILTER (k <= 20 AND total > 50000)::BIGINT AS n_over_bytes, count(*) FILTER (unreadable AND k <= 20 AND total <= 50000)::BIGINT AS n_unreadable, count(*) FILTER (k > 20 OR total > 50000 OR unreadable) = 0 AS complete FROM r GROUP BY repo")
def catalogue_budget_scan(spark, d):
    rows = table(spark, d, "source_files", "path", "repo", "content").select("repo", "path", F.octet_length("content").cast("bigint").alias("size")).dropDuplicates(["path"])
    rows = running(running(rows, "repo", ["path"], F.coalesce("size", F.lit(0)), "total"), "repo", ["path"], F.lit(1), "k")
    unreadable, late, large = F.col("size").isNull(), F.col("k") > 20, F.col("total") > 50_000
    return rows.groupBy("repo").agg(F.count_if(~late & ~large & ~unreadable).alias("n_in"), F.count_if(late).alias("n_over_files"), F.count_if(~late & large).alias("n_over_bytes"), F.count_if(~late & ~large & unreadable).alias("n_unreadable"), (F.count_if(late | large | unreadable) == 0).alias("complete"))


# --- discovery and diagnostics


@REGISTRY.query(rf"WITH {FILES} SELECT repo, CASE WHEN regexp_matches(lower(path), '\.(py|pyi)$') THEN 'python' WHEN regexp_matches(lower(path), '\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower(path), '\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(lower(path), '\.rs$') THEN 'rust' WHEN regexp_matches(lower(path), '\.(pl|pm|t)$') THEN 'perl' END AS language, count(*)::BIGINT AS n FROM files GROUP BY ALL")
def language_counts(spark, d):
    rows = table(spark, d, "source_files", "file_id", "repo", "path").dropDuplicates(["file_id"])
    return rows.groupBy("repo", discovery.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


IGNORE = ["tests/", "vendor/", "*.min.js", "!tests/**/*.rs", "/corvid/monolith/src"]


@REGISTRY.query(rf"""WITH {FILES} SELECT file_id, path FROM files WHERE NOT CASE
  WHEN regexp_matches(path, '^corvid/monolith/src(/.*)?$') THEN true WHEN regexp_matches(path, '^tests/(.*/)?[^/]*\.rs(/.*)?$') THEN false
  WHEN regexp_matches(path, '(^|/)[^/]*\.min\.js(/.*)?$') THEN true WHEN regexp_matches(path, '(^|/)vendor/') THEN true WHEN regexp_matches(path, '(^|/)tests/') THEN true ELSE false END""")
def discovery_filter(spark, d):
    rows = table(spark, d, "source_files", "file_id", "path").dropDuplicates(["file_id"])
    return rows.filter(~discovery.ignored(F.col("path"), IGNORE))


@REGISTRY.query("WITH t AS (SELECT DISTINCT CASE WHEN line IS NULL THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS path FROM diagnostics) SELECT path FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE starts_with(t.path, u.path || '/'))")
def normalize_targets(spark, d):
    rows = table(spark, d, "diagnostics", "path", "line")
    return discovery.uncovered(rows.select(F.when(F.col("line").isNull(), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")).alias("path")).distinct())


@REGISTRY.query(rf"WITH {FILES} SELECT repo, count(*)::BIGINT AS n, count(*) FILTER (list_has_any(string_split(path, '/'), ['test', 'tests', '__tests__']) OR regexp_matches(path, '(^|/)test_[^/]*$|_test\.py$|\.t$|\.(test|spec)\.[^/]*$'))::BIGINT AS n_tests FROM files GROUP BY repo")
def test_paths(spark, d):
    rows = table(spark, d, "source_files", "file_id", "repo", "path").dropDuplicates(["file_id"])
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(discovery.is_test(F.col("path"))).alias("n_tests"))


DIAGS = "diags AS (SELECT * FROM diagnostics QUALIFY row_number() OVER (PARTITION BY diag_id ORDER BY scanned_at) = 1)"


@REGISTRY.query(f"WITH {DIAGS} SELECT code, coalesce(severity, 'none') AS severity, count(*)::BIGINT AS n, bool_or(coalesce(incomplete, false)) AS incomplete, CASE WHEN bool_or(coalesce(incomplete, false)) THEN 2 WHEN bool_or(severity = 'error') THEN 1 ELSE 0 END AS exit_code FROM diags GROUP BY ALL")
def diagnostics_rollup(spark, d):
    rows = table(spark, d, "diagnostics").dropDuplicates(["diag_id"])
    incomplete = F.max(F.coalesce("incomplete", F.lit(False)))
    code = F.when(incomplete, 2).when(F.coalesce(F.max(F.col("severity") == "error"), F.lit(False)), 1).otherwise(0)
    return rows.groupBy("code", F.coalesce("severity", F.lit("none")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), incomplete.alias("incomplete"), code.alias("exit_code"))


@REGISTRY.query(f"WITH {DIAGS}, {FILES} SELECT f.file_id, count(*)::BIGINT AS n, count(*) FILTER (d.scanned_at >= f.observed_at)::BIGINT AS n_current FROM diags d JOIN files f USING (path) GROUP BY f.file_id")
def diagnostics_currency(spark, d):
    diags = table(spark, d, "diagnostics", "diag_id", "path", "scanned_at").dropDuplicates(["diag_id"])
    files = table(spark, d, "source_files", "file_id", "path", "observed_at").dropDuplicates(["file_id"])
    return diags.join(files, "path").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), replay.count(F.col("scanned_at") >= F.col("observed_at")).alias("n_current"))


@REGISTRY.query(f"WITH {UNITS}, {FILES}, u AS (SELECT path, count(*) AS n_units, count(*) FILTER (has_implementation) AS n_implemented FROM valid GROUP BY path) SELECT f.file_id, coalesce(u.n_units, 0)::BIGINT AS n_units, coalesce(u.n_implemented, 0)::BIGINT AS n_implemented FROM files f LEFT JOIN u USING (path)")
def coverage_by_file(spark, d):
    units = _units(spark, d, "path", "has_implementation").groupBy("path").agg(F.count(F.lit(1)).alias("n_units"), replay.count(F.col("has_implementation")).alias("n_implemented"))
    files = table(spark, d, "source_files", "file_id", "path").dropDuplicates(["file_id"])
    return files.join(units, "path", "left").select("file_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("n_implemented", F.lit(0)).alias("n_implemented"))


CONTROLS = [c for c in (*range(32), *range(127, 160), *range(0x202A, 0x202F), *range(0x2066, 0x206A)) if c != 10]
UNSAFE = r"[\x00-\x09\x0B-\x1F\x7F-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


@REGISTRY.query("SELECT doc_id, " + reduce(lambda text, c: f"replace({text}, chr({c}), '\\u{c:04x}')", CONTROLS, "text") + f" AS safe FROM documents WHERE regexp_matches(text, '{UNSAFE}')")
def safe_text(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").rlike(UNSAFE))
    return rows.select("doc_id", reduce(lambda text, c: F.replace(text, F.lit(chr(c)), F.lit(f"\\u{c:04x}")), CONTROLS, F.col("text")).alias("safe"))


# --- caches, ledgers and breakers over the event table


@REGISTRY.query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def cache_upsert(spark, d):
    return services.latest(table(spark, d, "events", "user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@REGISTRY.query("WITH l AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1), e AS (SELECT max(ts) - INTERVAL 259200 SECONDS AS since FROM events) SELECT user_id, event_type, ts >= since AS cached FROM l, e")
def cached_missing_split(spark, d):
    events = table(spark, d, "events", "user_id", "event_type", "ts")
    since = events.agg(F.max("ts") - F.expr("interval 259200 seconds")).scalar()
    return events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")).select("user_id", "event_type", (F.col("ts") >= since).alias("cached"))


@REGISTRY.query("WITH r AS (SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS spent, ts FROM events), o AS (SELECT *, max((spent > 200)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS over FROM r) SELECT user_id, count(*)::BIGINT AS n_admitted, max(spent) AS spent FROM o WHERE over = 0 GROUP BY user_id")
def budget_ledger_cutoff(spark, d):
    rows = services.ledger(table(spark, d, "events", "event_id", "user_id", "ts", "value").filter("value IS NOT NULL"), "user_id", ["ts", "event_id"], "value", 200)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_admitted"), F.max("spent").alias("spent"))


@REGISTRY.query("SELECT user_id, event_type, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 3")
def circuit_breaker(spark, d):
    rows = table(spark, d, "events", "user_id", "event_type", "event_id", "ts").filter("event_type = 'error'")
    return services.breaker(rows, ["user_id", "event_type"], ["ts", "event_id"], 3).select("user_id", "event_type", "event_id")


# --- sources and streams


def _parsed(spark, d, *records):
    return parsed(table(spark, d, "source_files", "path", "content"), max_bytes=1 << 20, records=records)


@REGISTRY.query()
def frontend_units(spark, d):
    return _parsed(spark, d, "unit").drop("record")


@REGISTRY.query()
def frontend_references(spark, d):
    return _parsed(spark, d, "reference").groupBy("path", F.col("parent_id").alias("unit_id"), "name").agg(F.count(F.lit(1)).alias("n"), F.min("start_byte").alias("first_byte"))


@REGISTRY.query()
def frontend_diagnostics(spark, d):
    return _parsed(spark, d, "diagnostic", "import").groupBy("language", "record", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first_line"))


@REGISTRY.query()
def frontend_agreement(spark, d):
    """How many of the table's units the frontend finds with the same kind, name and span, by language and kind."""
    own = _parsed(spark, d, "unit").select("path", "language", "kind", "name", "start_byte", "end_byte").withColumn("found", F.lit(True))
    listed = _units(spark, d, "path", "kind", "name", "start_byte", "end_byte").drop("unit_id").withColumn("language", discovery.language(F.col("path"))).withColumn("listed", F.lit(True))
    both = listed.join(own, ["path", "language", "kind", "name", "start_byte", "end_byte"], "full")
    return both.groupBy("language", "kind").agg(F.count("listed").alias("n_listed"), F.count("found").alias("n_found"), F.count_if(F.col("listed") & F.col("found")).alias("n_both"))


@REGISTRY.query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS since, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL) SELECT * FROM w WHERE since + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def stream_summary(spark, d):
    schema = table(spark, d, "events").schema
    return answers.run_once(answers.windowed_counts(answers.read_events(spark, d, schema)), f"summary_{uuid.uuid4().hex}")


# --- evidence, wire and identity


@REGISTRY.query(f"WITH {UNITS}, {FILES} SELECT v.unit_id, (v.end_byte - v.start_byte)::INT AS n_bytes, coalesce(v.body_start_byte >= v.start_byte AND v.body_end_byte <= v.end_byte, false) AS body_inside FROM valid v JOIN files f USING (path) WHERE f.content IS NOT NULL AND v.start_byte >= 0 AND v.start_byte < v.end_byte AND v.end_byte <= strlen(f.content)")
def evidence_spans(spark, d):
    files = table(spark, d, "source_files", "path", "content").filter("content IS NOT NULL").select("path", F.octet_length("content").alias("size")).dropDuplicates(["path"])
    rows = _units(spark, d, "path", "start_byte", "end_byte", "body_start_byte", "body_end_byte").join(files, "path").filter("start_byte >= 0 AND start_byte < end_byte AND end_byte <= size")
    inside = F.coalesce((F.col("body_start_byte") >= F.col("start_byte")) & (F.col("body_end_byte") <= F.col("end_byte")), F.lit(False))
    return rows.select("unit_id", (F.col("end_byte") - F.col("start_byte")).cast("int").alias("n_bytes"), inside.alias("body_inside"))


@REGISTRY.query(f"WITH {CASES} SELECT case_id, left(sha256(question_wire), 16) AS rubric, 'final-' || left(sha256(case_id || chr(10) || question_wire), 24) AS stable_id FROM cases")
def rubric_references(spark, d):
    rows = table(spark, d, "calibration_cases", "case_id", "question_wire")
    stable = F.concat(F.lit("final-"), F.left(F.sha2(F.concat_ws("\n", "case_id", "question_wire"), 256), F.lit(24)))
    return rows.select("case_id", F.left(F.sha2("question_wire", 256), F.lit(16)).alias("rubric"), stable.alias("stable_id")).dropDuplicates(["case_id"])


@REGISTRY.query(f"WITH {ASSESSED} SELECT rule_id, support, count(*)::BIGINT AS n, count(DISTINCT label)::BIGINT AS n_labels, min(case_id) AS first_case FROM replayed WHERE support IS NOT NULL GROUP BY ALL HAVING count(DISTINCT label) > 1")
def label_conflicts(spark, d):
    rows = _records(spark, d).filter("support IS NOT NULL").groupBy("rule_id", "support").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"), F.min("case_id").alias("first_case"))
    return rows.filter("n_labels > 1")


CANDIDATES = f"""{UNITS}, {CALLS}, spanned AS (SELECT * FROM valid WHERE start_byte >= 0 AND start_byte < end_byte), owners AS (SELECT path, start_byte AS s, end_byte AS e FROM spanned WHERE kind IN ('class', 'impl', 'package')),
d AS (SELECT unit_id, path AS loc, start_byte, end_byte - start_byte AS size, regexp_extract(qualified_name, '([^.:]*)$', 1) AS name, {LANGUAGE_SQL.format('path')} AS language FROM spanned WHERE kind IN ('function', 'method')),
pool AS (SELECT DISTINCT c.path, d.* EXCLUDE (name, language) FROM calls c JOIN d ON d.name = c.name AND d.language = {LANGUAGE_SQL.format('c.path')} WHERE NOT (d.loc = c.path AND EXISTS (SELECT 1 FROM owners o WHERE o.path = d.loc AND o.s <= d.start_byte AND d.start_byte + d.size <= o.e))),
placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY loc <> path, regexp_replace(loc, '/[^/]*$', '') <> regexp_replace(path, '/[^/]*$', ''), size, loc, start_byte, unit_id) AS rank, count(*) OVER (PARTITION BY path) AS n FROM pool)"""


@REGISTRY.query(f"WITH {CANDIDATES} SELECT path, unit_id, rank::INT AS rank, greatest(0, n - 8)::BIGINT AS n_omitted FROM placed WHERE rank <= 8")
def definition_candidates(spark, d):
    return retrieval.definition_candidates(table(spark, d, "units"), table(spark, d, "source_files", "path", "content"), 8)


@REGISTRY.query(f"WITH {CANDIDATES}, every AS (SELECT c.path, d.loc, d.unit_id, EXISTS (SELECT 1 FROM owners o WHERE o.path = d.loc AND o.s <= d.start_byte AND d.start_byte + d.size <= o.e) AS held FROM calls c JOIN d ON d.name = c.name AND d.loc = c.path) SELECT path, count(*)::BIGINT AS n_own, count(*) FILTER (held)::BIGINT AS n_present FROM every GROUP BY path")
def already_present_anti(spark, d):
    rows = _units(spark, d, "path", "kind", "qualified_name", "start_byte", "end_byte").filter("start_byte >= 0 AND start_byte < end_byte")
    defs = rows.filter("kind IN ('function', 'method')").select("unit_id", "path", "start_byte", "end_byte", retrieval.short_name(F.col("qualified_name")).alias("name"))
    own = retrieval.references(table(spark, d, "source_files", "path", "content")).select("path", "name").join(defs, ["path", "name"])
    owners = rows.filter("kind IN ('class', 'impl', 'package')").select("path", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    present = own.join(owners, "path").filter("s <= start_byte AND end_byte <= e").select("unit_id").distinct().withColumn("held", F.lit(True))
    return own.join(present, "unit_id", "left").groupBy("path").agg(F.count(F.lit(1)).alias("n_own"), F.count("held").alias("n_present"))


@REGISTRY.query(rf"""WITH {UNITS}, {FILES}, c AS (SELECT v.unit_id, v.path, v.start_byte, v.end_byte, regexp_extract(v.qualified_name, '([^.:]*)$', 1) AS name, list_distinct(regexp_extract_all({STRIP.format("decode(unhex(substr(hex(encode(f.content)), v.start_byte * 2 + 1, (v.end_byte - v.start_byte) * 2)))", 'v.path')}, '([A-Za-z_][A-Za-z0-9_]*)\(', 1)) AS calls
  FROM valid v JOIN files f USING (path) WHERE f.content IS NOT NULL AND v.kind IN ('function', 'method') AND v.start_byte >= 0 AND v.start_byte < v.end_byte AND v.end_byte <= strlen(f.content)),
defs AS (SELECT unit_id AS dep_id, path, regexp_extract(qualified_name, '([^.:]*)$', 1) AS name, start_byte AS s, end_byte AS e FROM valid WHERE kind IN ('function', 'method')),
one AS (SELECT DISTINCT c.unit_id, c.path, c.start_byte, c.end_byte, c.calls, d.dep_id FROM c JOIN defs d ON d.path = c.path AND list_contains(c.calls, d.name) WHERE NOT (s <= start_byte AND e >= end_byte) AND NOT (start_byte <= s AND e <= end_byte)),
two AS (SELECT DISTINCT one.unit_id, d.dep_id FROM one JOIN c ON c.unit_id = one.dep_id JOIN defs d ON d.path = one.path AND list_contains(c.calls, d.name) AND NOT list_contains(one.calls, d.name) WHERE NOT (d.s <= one.start_byte AND d.e >= one.end_byte) AND NOT (one.start_byte <= d.s AND d.e <= one.end_byte))
SELECT unit_id, dep_id, min(hop)::INT AS hop FROM (SELECT unit_id, dep_id, 1 AS hop FROM one UNION ALL SELECT unit_id, dep_id, 2 FROM two) GROUP BY ALL""")
def local_dependencies(spark, d):
    return retrieval.local_dependencies(table(spark, d, "units"), table(spark, d, "source_files", "path", "content"))


@REGISTRY.query(f"WITH {UNITS} SELECT unit_id, split_part(split_part(regexp_replace(string_split(display_name, ' for ')[-1], '^impl ', ''), '<', 1), '::', -1) AS type_hint FROM valid WHERE kind = 'impl'")
def impl_type_hints(spark, d):
    return _units(spark, d, "kind", "display_name").filter("kind = 'impl'").select("unit_id", retrieval.impl_type(F.col("display_name")).alias("type_hint"))


@REGISTRY.query(f"WITH {UNITS} SELECT v.unit_id, unnest([CASE WHEN v.kind NOT IN ('function', 'method') THEN v.unit_id ELSE coalesce(p.unit_id, v.path) END, v.path]) AS candidate, unnest(['enclosing_owner', 'containing_file']) AS relation FROM valid v LEFT JOIN valid p ON p.unit_id = v.parent_id")
def enclosing_candidates(spark, d):
    units = _units(spark, d, "path", "kind", "parent_id")
    owners = units.select(F.col("unit_id").alias("parent_id"), F.lit(True).alias("_known"))
    owner = F.when(~F.col("kind").isin("function", "method"), F.col("unit_id")).when(F.col("_known"), F.col("parent_id")).otherwise(F.col("path"))
    pair = F.array(F.struct(owner.alias("candidate"), F.lit("enclosing_owner").alias("relation")), F.struct(F.col("path").alias("candidate"), F.lit("containing_file").alias("relation")))
    return units.join(owners, "parent_id", "left").select("unit_id", F.explode(pair).alias("x")).select("unit_id", "x.*")


@REGISTRY.query(f"WITH {UNITS}, m AS (SELECT parent_id, display_name, row_number() OVER (PARTITION BY parent_id ORDER BY start_byte, end_byte DESC, unit_id) AS k FROM valid WHERE parent_id IS NOT NULL) SELECT p.unit_id, m.k::INT AS place, m.display_name AS name FROM valid p JOIN m ON m.parent_id = p.unit_id WHERE p.kind NOT IN ('function', 'method') AND m.k <= 23")
def owner_outline(spark, d):
    units = _units(spark, d, "path", "kind", "parent_id", "display_name", "start_byte", "end_byte")
    k = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.asc_nulls_last("start_byte"), F.desc_nulls_first("end_byte"), "unit_id"))
    members = units.filter("parent_id IS NOT NULL").select("parent_id", "display_name", k.alias("place")).filter("place <= 23")
    owners = units.filter("kind NOT IN ('function', 'method')").select(F.col("unit_id").alias("parent_id"))
    return members.join(owners, "parent_id", "left_semi").select(F.col("parent_id").alias("unit_id"), "place", F.col("display_name").alias("name"))


@REGISTRY.query(f"""WITH {UNITS}, {FILES}, s AS (SELECT v.unit_id, hex(encode(f.content)) AS h, v.start_byte AS s, v.end_byte AS e, greatest(v.start_byte, v.body_start_byte - 200) AS b FROM valid v JOIN files f USING (path) WHERE f.content IS NOT NULL AND v.start_byte >= 0 AND v.start_byte < v.end_byte AND v.end_byte <= strlen(f.content) AND v.body_start_byte >= v.start_byte AND v.body_start_byte <= v.end_byte),
t AS (SELECT unit_id, s, e, h, b + CASE WHEN substr(h, b * 2 + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, b * 2 + 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, b * 2 + 5, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS b FROM s), x AS (SELECT unit_id, s, b, decode(unhex(substr(h, b * 2 + 1, (e - b) * 2))) AS text FROM t WHERE b < e)
SELECT unit_id, sha256(left(text, 1200)) AS digest, b = s AND length(text) <= 1200 AS complete FROM x""")
def candidate_previews(spark, d):
    units = _units(spark, d, "path", "start_byte", "end_byte", "body_start_byte").filter("body_start_byte >= start_byte AND body_start_byte <= end_byte AND start_byte >= 0 AND start_byte < end_byte")
    files = table(spark, d, "source_files", "path", "content").dropDuplicates(["path"])
    begun = units.select("unit_id", "path", "start_byte", "end_byte", F.greatest("start_byte", F.col("body_start_byte") - 200).alias("from_byte"))
    # a slice that begins inside a character begins with replacement signs, one for each of its bytes
    rows = spans.read(begun, files, "unit_id", "from_byte", "end_byte").select("unit_id", F.when(F.col("starts_whole"), F.col("text")).otherwise(F.regexp_replace("text", "^\ufffd+", "")).alias("text"), "starts_whole")
    rows = rows.join(begun.select("unit_id", (F.col("from_byte") == F.col("start_byte")).alias("from_start")), "unit_id")
    return rows.filter("text <> ''").select("unit_id", F.sha2(F.left("text", F.lit(1200)), 256).alias("digest"), (F.col("from_start") & F.col("starts_whole") & (F.length("text") <= 1200)).alias("complete"))


@REGISTRY.query(f"WITH {FOUND} SELECT unit_id, string_agg(DISTINCT CASE WHEN {SAME_REPO} THEN 'far' ELSE 'near' END, ',' ORDER BY CASE WHEN {SAME_REPO} THEN 'far' ELSE 'near' END) AS families, count(*)::BIGINT AS n FROM found GROUP BY unit_id")
def family_membership(spark, d):
    n = retrieval.caller_counts(table(spark, d, "units"), table(spark, d, "source_files")).filter("near + far > 0")
    families = F.array_compact(F.array(F.when(F.col("far") > 0, "far"), F.when(F.col("near") > 0, "near")))
    return n.select("unit_id", F.array_join(families, ",").alias("families"), (F.col("near") + F.col("far")).alias("n"))


@REGISTRY.query(f"WITH {UNITS} SELECT parent_id, count(*)::BIGINT AS n_members, count(DISTINCT name)::BIGINT AS n_names FROM valid WHERE parent_id IS NOT NULL AND has_implementation GROUP BY parent_id")
def sibling_names(spark, d):
    rows = _units(spark, d, "parent_id", "name", "has_implementation").filter("parent_id IS NOT NULL AND has_implementation")
    return rows.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_members"), F.countDistinct("name").alias("n_names"))


@REGISTRY.query(f"WITH {ASSESSED}, s AS (SELECT count(*) AS n, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status = 'warning') AS w, count(*) FILTER (status = 'unknown') AS u FROM replayed) SELECT n::BIGINT AS n, e::BIGINT AS errors, w::BIGINT AS warnings, u::BIGINT AS unknown, CASE WHEN e > 0 THEN 1 ELSE 0 END AS exit_code FROM s")
def exit_code_summary(spark, d):
    s = F.col("status")
    return _records(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "unknown").alias("unknown"), F.when(F.count_if(s == "error") > 0, 1).otherwise(0).alias("exit_code"))

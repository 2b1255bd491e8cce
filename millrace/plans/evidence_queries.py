"""Queries over evidence, identity and capture, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.operators import evidence, replay, retrieval
from millrace.sources.tables import table

from .queries import ASSESSED, CASES, FILES, REGISTRY, REQUESTS, STRIP, SUPPORT, UNITS, _records, _requests, _units


def _files(spark, d, *columns):
    return table(spark, d, "source_files", "file_id", "path", "content", *columns).dropDuplicates(["file_id"])


@REGISTRY.query(f"WITH {FILES} SELECT file_id, lower(source_sha256) = sha256(content) AS same_digest, n_bytes = strlen(content) AS same_size FROM files WHERE content IS NOT NULL")
def source_identity(spark, d):
    rows = table(spark, d, "source_files", "file_id", "content", "source_sha256", "n_bytes").filter("content IS NOT NULL")
    return rows.select("file_id", (F.lower("source_sha256") == F.sha2("content", 256)).alias("same_digest"), (F.col("n_bytes") == F.octet_length("content")).alias("same_size")).dropDuplicates(["file_id"])


@REGISTRY.query(f"WITH {FILES} SELECT file_id, greatest(1, len(content) - len(replace(content, chr(10), '')) + CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 0 ELSE 1 END)::INT AS n_lines FROM files WHERE content IS NOT NULL")
def file_lines(spark, d):
    breaks = F.size(F.split("content", "\n")) - 1
    last = F.when((F.col("content") == "") | F.endswith("content", F.lit("\n")), 0).otherwise(1)
    return table(spark, d, "source_files", "file_id", "content").filter("content IS NOT NULL").select("file_id", F.greatest(F.lit(1), breaks + last).alias("n_lines")).dropDuplicates(["file_id"])


@REGISTRY.query(f"""WITH {UNITS}, {FILES}, s AS (SELECT v.unit_id, encode(f.content) AS b, v.start_byte AS s, v.end_byte AS e FROM valid v JOIN files f USING (path) WHERE f.content IS NOT NULL AND v.start_byte >= 0 AND v.start_byte < v.end_byte AND v.end_byte <= strlen(f.content))
SELECT unit_id, substr(hex(b), s * 2 + 1, 1) NOT IN ('8', '9', 'A', 'B') AS starts_whole, substr(hex(b), e * 2 + 1, 1) NOT IN ('8', '9', 'A', 'B') AS ends_whole, sha256(decode(unhex(substr(hex(b), s * 2 + 1, (e - s) * 2)))) AS digest FROM s""")
def evidence_slices(spark, d):
    files = _files(spark, d).select("path", "content").dropDuplicates(["path"])
    rows = spans.read(_units(spark, d, "path", "start_byte", "end_byte"), files, "unit_id")
    return rows.select("unit_id", "starts_whole", "ends_whole", F.sha2("text", 256).alias("digest"))


@REGISTRY.query(rf"WITH {FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM files WHERE content IS NOT NULL), i AS (SELECT path, k, left(text, 1024) AS text, row_number() OVER (PARTITION BY path ORDER BY k) AS n FROM l WHERE regexp_matches(left(text, 1024), '^\s*(?:import |from \S+ import |use |require |export .* from )')) SELECT path, k::INT AS line_no, text FROM i WHERE n <= 32")
def import_lines(spark, d):
    return evidence.imports(table(spark, d, "source_files", "path", "content")).dropDuplicates(["path", "line_no"])


@REGISTRY.query(rf"""WITH {UNITS}, {FILES}, m AS (SELECT unit_id, parent_id, path, name, body_start_byte AS s, body_end_byte AS e FROM valid WHERE parent_id IS NOT NULL AND body_start_byte >= 0 AND body_end_byte > body_start_byte),
b AS (SELECT m.*, decode(unhex(substr(hex(encode(f.content)), s * 2 + 1, (e - s) * 2))) AS body FROM m JOIN files f USING (path) WHERE f.content IS NOT NULL AND e <= strlen(f.content)),
c AS (SELECT parent_id, unit_id AS caller, unnest(list_distinct(regexp_extract_all({STRIP.format('body', 'path')}, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS name FROM b)
SELECT c.parent_id, c.caller, m.unit_id AS callee FROM c JOIN m USING (parent_id, name) WHERE c.caller <> m.unit_id""")
def helper_relationship(spark, d):
    units = _units(spark, d, "parent_id", "path", "name", "body_start_byte", "body_end_byte")
    return evidence.sibling_calls(units, _files(spark, d).filter("content IS NOT NULL").select("path", "content"))


@REGISTRY.query(f"WITH {UNITS}, m AS (SELECT parent_id, sum(branch_nodes) AS n FROM valid WHERE parent_id IS NOT NULL GROUP BY parent_id) SELECT u.unit_id, u.branch_nodes, coalesce(m.n, 0)::BIGINT AS in_members FROM valid u LEFT JOIN m ON m.parent_id = u.unit_id WHERE u.kind IN ('class', 'impl', 'package')")
def branch_counts(spark, d):
    units = _units(spark, d, "parent_id", "kind", "branch_nodes")
    inner = units.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("unit_id")).agg(F.sum("branch_nodes").alias("n"))
    return units.filter("kind IN ('class', 'impl', 'package')").join(inner, "unit_id", "left").select("unit_id", "branch_nodes", F.coalesce("n", F.lit(0)).alias("in_members"))


@REGISTRY.query("WITH signed AS (SELECT * FROM units WHERE signature IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY scanned_at DESC NULLS LAST, ingested_at DESC NULLS LAST, start_byte DESC NULLS LAST, end_byte DESC NULLS LAST) = 1) SELECT unit_id, CASE WHEN len(signature) > 1024 THEN left(signature, 1024) || ' [signature abbreviated]' ELSE signature END AS signature FROM signed")
def abbreviated_signatures(spark, d):
    rows = retrieval.latest_units(table(spark, d, "units").filter("signature IS NOT NULL"), "signature")
    return rows.select("unit_id", evidence.abbreviated(F.col("signature")).alias("signature"))


@REGISTRY.query(f"WITH {CASES} SELECT case_id, list_sort(list_transform(json_extract_string(evidence.state, '$.documents[*].path'), lambda x: x)) = list_sort(map_keys(evidence.source_documents)) AS same_paths FROM cases")
def evidence_documents(spark, d):
    state = F.from_json("evidence.state", "documents ARRAY<STRUCT<path: STRING>>")
    same = F.array_sort(state["documents"]["path"]) == F.array_sort(F.map_keys("evidence.source_documents"))
    return table(spark, d, "calibration_cases").select("case_id", same.alias("same_paths")).dropDuplicates(["case_id"])


@REGISTRY.query(f"""WITH {ASSESSED}, e AS (SELECT rule_id, case_id, coalesce(severity, 'none') AS by_score, CASE WHEN map_extract_value(answer.probabilities, '2') >= 0.5 THEN 'error' WHEN round(map_extract_value(answer.probabilities, '1') + map_extract_value(answer.probabilities, '2'), 9) >= 0.7 THEN 'warning' ELSE 'none' END AS by_mass FROM replayed WHERE t = 'score')
SELECT rule_id, by_score, by_mass, count(*)::BIGINT AS n FROM e GROUP BY ALL""")
def mass_vs_expected_score(spark, d):
    rows = _records(spark, d).filter("answer.type = 'score'")
    p = lambda k: F.try_element_at("answer.probabilities", F.lit(k))
    mass = F.when(p("2") >= 0.5, "error").when(F.round(p("1") + p("2"), 9) >= 0.7, "warning").otherwise("none")
    return rows.groupBy("rule_id", F.coalesce("severity", F.lit("none")).alias("by_score"), mass.alias("by_mass")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("WITH a AS (SELECT DISTINCT adjudication_id, case_id, label, adjudicator, supporting_source, adjudicated_at FROM adjudications) SELECT coalesce(case_id, supporting_source || chr(10) || adjudicator) AS key, count(*)::BIGINT AS n, count(DISTINCT label)::BIGINT AS n_labels, count(*) = 1 AS unambiguous, arg_max(label, struct_pack(a := adjudicated_at, b := adjudication_id)) AS last_label FROM a GROUP BY ALL")
def adjudication_index(spark, d):
    rows = table(spark, d, "adjudications", "adjudication_id", "case_id", "label", "adjudicator", "supporting_source", "adjudicated_at").distinct()
    key = F.coalesce("case_id", F.concat("supporting_source", F.lit("\n"), "adjudicator"))
    out = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"), F.max_by("label", F.struct("adjudicated_at", "adjudication_id")).alias("last_label"))
    return out.withColumn("unambiguous", F.col("n") == 1)


@REGISTRY.query("WITH a AS (SELECT DISTINCT adjudication_id, case_id, unnest(decisive_lines) AS line FROM adjudications) SELECT case_id, count(*)::BIGINT AS n_lines, min(line) AS first_line, max(line) AS last_line FROM a GROUP BY case_id")
def decisive_lines(spark, d):
    rows = table(spark, d, "adjudications", "adjudication_id", "case_id", "decisive_lines").select("adjudication_id", "case_id", F.explode("decisive_lines").alias("line")).distinct()
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@REGISTRY.query(f"WITH {CASES}, g AS (SELECT rule_id, {SUPPORT} AS support FROM cases) SELECT rule_id, count(*)::BIGINT AS n, count(DISTINCT support)::BIGINT AS n_groups, count(DISTINCT support) >= 2 AS leave_one_out FROM g GROUP BY rule_id")
def group_support(spark, d):
    rows = replay.known_cases(table(spark, d, "calibration_cases"), "rule_id", "provenance").withColumn("support", replay.support_group(F.col("provenance")))
    out = rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("support").alias("n_groups"))
    return out.withColumn("leave_one_out", F.col("n_groups") >= 2)


@REGISTRY.query(f"WITH {CASES} SELECT c.case_id, u.unit_id IS NOT NULL AS is_unit FROM cases c LEFT JOIN (SELECT DISTINCT unit_id FROM units) u ON c.target.id = u.unit_id")
def target_resolution(spark, d):
    rows = replay.known_cases(table(spark, d, "calibration_cases"), "target").select("case_id", F.col("target.id").alias("unit_id"))
    known = table(spark, d, "units", "unit_id").distinct().withColumn("is_unit", F.lit(True))
    return rows.join(known, "unit_id", "left").select("case_id", F.coalesce("is_unit", F.lit(False)).alias("is_unit"))


SKIP = "ranked AS (SELECT path, request_id, body_bytes AS size, row_number() OVER (PARTITION BY path ORDER BY questions DESC, request_id) AS k FROM requests WHERE body_bytes > 0)"


@REGISTRY.query(f"WITH RECURSIVE {REQUESTS}, {SKIP}, f AS (SELECT path, request_id, k, size <= 30000 AS taken, CASE WHEN size <= 30000 THEN size ELSE 0 END AS used, CASE WHEN size <= 30000 THEN 1 ELSE 0 END AS n FROM ranked WHERE k = 1 UNION ALL SELECT r.path, r.request_id, r.k, f.used + r.size <= 30000 AND f.n < 4, CASE WHEN f.used + r.size <= 30000 AND f.n < 4 THEN f.used + r.size ELSE f.used END, CASE WHEN f.used + r.size <= 30000 AND f.n < 4 THEN f.n + 1 ELSE f.n END FROM f JOIN ranked r ON r.path = f.path AND r.k = f.k + 1) SELECT path, (n - 1)::INT AS place, request_id FROM f WHERE taken")
def skip_fit_admission(spark, d):
    rows = _requests(spark, d).filter("body_bytes > 0").select("path", (-F.col("questions")).alias("o1"), F.col("request_id").alias("o2"), "request_id", "body_bytes")
    return evidence.skip_fit(rows, "path", ["o1", "o2"], "request_id", "body_bytes", 30_000, 4)


@REGISTRY.query("WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS ready, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) SELECT event_id, (max(ready - n * 600000000) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 600000000 - ready)::BIGINT AS waits FROM e")
def rate_limiter(spark, d):
    rows = table(spark, d, "events", "user_id", "event_id", "ts").withColumn("ready", F.unix_micros(F.col("ts").cast("timestamp")))
    return evidence.paced(rows, "user_id", ["ts", "event_id"], "ready", 600_000_000).select("event_id", (F.col("starts") - F.col("ready")).alias("waits"))


@REGISTRY.query("SELECT min(event_id) AS first_id, user_id, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS value, max((json_extract(props, '$.k'))::INT) AS top FROM events GROUP BY user_id, event_type")
def usage_metrics(spark, d):
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "props")
    return rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("top"))


@REGISTRY.query(f"WITH {UNITS} SELECT u.unit_id, coalesce(p.unit_id, u.path) AS owner, coalesce(p.kind, 'file') AS owner_kind FROM valid u LEFT JOIN valid p ON u.parent_id = p.unit_id WHERE u.kind IN ('function', 'method')")
def owner_resolution(spark, d):
    units = _units(spark, d, "path", "kind", "parent_id")
    owners = units.select(F.col("unit_id").alias("parent_id"), F.col("kind").alias("_k"), F.lit(True).alias("_found"))
    rows = units.filter("kind IN ('function', 'method')").join(owners, "parent_id", "left")
    return rows.select("unit_id", F.when(F.col("_found"), F.col("parent_id")).otherwise(F.col("path")).alias("owner"), F.coalesce("_k", F.lit("file")).alias("owner_kind"))

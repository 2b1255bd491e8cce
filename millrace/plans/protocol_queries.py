"""Queries of answers, keys, routing and of the measures of experiments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.assessment import assess
from millrace.operators import accounting, replay, routing
from millrace.sources import jsonl
from millrace.sources.tables import table

from .calibration_queries import RULED, _ruled
from .catalogue import POLICY_SQL, RULES_SQL, assessed_sql, rule_policies, rules
from .queries import CASES, REGISTRY, SPLIT

LABELS = "CASE answer.type WHEN 'choice' THEN ['kept', 'lost', 'unclear'] WHEN 'score' THEN ['0', '1', '2'] ELSE []::VARCHAR[] END"


def _cases(spark, d, *columns):
    return replay.known_cases(table(spark, d, "calibration_cases"), *columns)


def _reduced(spark, d, *columns):
    """Case rows as delivered: where texts or maps are read, they are reduced to digests and counts first and made unique after (``_once``)."""
    return table(spark, d, "calibration_cases").select("case_id", *columns)


def _once(rows):
    return rows.dropDuplicates(["case_id"])


def _labels(kind):
    of = lambda *x: F.array(*map(F.lit, x))
    return F.when(kind == "choice", of("kept", "lost", "unclear")).when(kind == "score", of("0", "1", "2")).otherwise(F.array().cast("array<string>"))


# --- keys, answers, responses


@REGISTRY.query(f"WITH {CASES} SELECT case_id, sha256(concat_ws(chr(10), 'judgment:' || prompt.version::VARCHAR, endpoint, coalesce(returned_model, ''), evidence.state, question_wire)) AS judgment_key, sha256(concat_ws(chr(10), 'request', endpoint, '{{\"question\":' || question_wire || ',\"state\":' || evidence.state || '}}')) AS request_key FROM cases")
def cache_keys(spark, d):
    rows = _reduced(spark, d, "prompt", "endpoint", "returned_model", "evidence", "question_wire")
    prefix = F.concat(F.lit("judgment:"), F.col("prompt.version").cast("string"))
    body = F.concat(F.lit('{"question":'), "question_wire", F.lit(',"state":'), "evidence.state", F.lit("}"))
    judgment = F.sha2(F.concat_ws("\n", prefix, "endpoint", F.coalesce("returned_model", F.lit("")), "evidence.state", "question_wire"), 256)
    return _once(rows.select("case_id", judgment.alias("judgment_key"), routing.key("request", F.col("endpoint"), body).alias("request_key")))


@REGISTRY.query(f"""WITH {CASES}, a AS (SELECT case_id, answer, {LABELS} AS labels FROM cases)
SELECT case_id, answer.type AS type, array_to_string(list_filter([CASE WHEN answer.type = 'boolean' AND NOT coalesce(answer.noul BETWEEN 0 AND 1, false) THEN 'probability' END, CASE WHEN answer.type = 'choice' AND NOT coalesce(list_contains(labels, answer.choice), false) THEN 'choice' END, CASE WHEN answer.type = 'score' AND NOT coalesce(answer.score >= 0 AND answer.score < 3, false) THEN 'score' END,
  CASE WHEN answer.type <> 'boolean' AND list_sort(map_keys(answer.probabilities)) <> labels THEN 'labels' END, CASE WHEN answer.type <> 'boolean' AND len(list_filter(map_values(answer.probabilities), lambda p: p < 0 OR p > 1)) > 0 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS errors FROM a""")
def answer_validation(spark, d):
    rows = _cases(spark, d, "answer")
    return rows.select("case_id", F.col("answer.type").alias("type"), F.array_join(routing.answer_errors("answer", _labels(F.col("answer.type"))), ",").alias("errors"))


@REGISTRY.query(f"WITH {CASES}, c AS (SELECT target.path AS path, list(DISTINCT rule_id) AS got FROM cases GROUP BY ALL), e AS (SELECT [rule_id, 'QRY01', 'QRY07'] AS asked, target.path AS path FROM cases), p AS (SELECT path, list_distinct(flatten(list(asked))) AS asked FROM e GROUP BY path) SELECT path, array_to_string(list_sort(list_filter(asked, lambda x: NOT list_contains(got, x))), ',') AS missing, array_to_string(list_sort(list_filter(got, lambda x: NOT list_contains(asked, x))), ',') AS unknown FROM c JOIN p USING (path)")
def response_ids(spark, d):
    rows = _cases(spark, d, "rule_id", "target").groupBy(F.col("target.path").alias("path")).agg(F.collect_set("rule_id").alias("got"))
    asked = F.array_distinct(F.concat("got", F.array(F.lit("QRY01"), F.lit("QRY07"))))
    return rows.select("path", F.array_join(F.array_sort(F.array_except(asked, "got")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("got", asked)), ",").alias("unknown"))


@REGISTRY.query(f"WITH {CASES}, {POLICY_SQL}, judged AS (SELECT case_id, context_complete, {{'type': answer.type, 'noul': CASE WHEN answer.type = 'boolean' THEN 0.0::DOUBLE END, 'choice': CASE WHEN answer.type = 'choice' THEN 'kept' END, 'score': CASE WHEN answer.type = 'score' THEN 0.0::DOUBLE END, 'confidence': CASE WHEN answer.type <> 'boolean' THEN 1.0::DOUBLE END, 'probabilities': CASE answer.type WHEN 'choice' THEN MAP {{'kept': 1.0::DOUBLE, 'lost': 0.0, 'unclear': 0.0}} WHEN 'score' THEN MAP {{'0': 1.0::DOUBLE, '1': 0.0, '2': 0.0}} ELSE MAP {{}}::MAP(VARCHAR, DOUBLE) END}} AS answer, p.* FROM cases c JOIN policies p USING (rule_id)), {assessed_sql('judged', 'again')} SELECT case_id, rule_id, status, reason, severity FROM again")
def offline_judge(spark, d):
    rows = _cases(spark, d, "rule_id", "answer", "context_complete")
    rows = rows.withColumn("answer", accounting.offline_answer(F.col("answer.type"), _labels(F.col("answer.type"))))
    policies = rule_policies(spark)
    own = policies.select("rule_id", F.struct(*[c for c in policies.columns if c != "rule_id"]).alias("policy"))
    return rows.join(F.broadcast(own), "rule_id").withColumn("o", assess()).select("case_id", "rule_id", "o.status", "o.reason", "o.severity")


@REGISTRY.query(f"WITH {CASES} SELECT case_id, left(sha256(question_wire), 16) AS reference, left(hashes.question, 16) AS declared, coalesce(lower(trim(hashes.question)) = sha256(question_wire), false) AS sound FROM cases")
def registry_check(spark, d):
    rows = _reduced(spark, d, "question_wire", "hashes")
    return _once(rows.select("case_id", F.left(F.sha2("question_wire", 256), F.lit(16)).alias("reference"), F.left("hashes.question", F.lit(16)).alias("declared"), F.coalesce(F.lower(F.trim("hashes.question")) == F.sha2("question_wire", 256), F.lit(False)).alias("sound")))


@REGISTRY.query(f"""WITH {CASES} SELECT case_id, array_to_string(list_filter([CASE WHEN hashes.question IS NULL THEN 'question_missing' WHEN lower(trim(hashes.question)) <> sha256(question_wire) THEN 'question' END, CASE WHEN hashes.evidence IS NULL THEN 'evidence_missing' WHEN lower(trim(hashes.evidence)) <> sha256(evidence.state) THEN 'evidence' END,
  CASE WHEN len(list_filter(map_entries(evidence.source_documents), lambda e: lower(trim(map_extract_value(hashes.source_documents, e.key))) <> sha256(e.value))) > 0 THEN 'source_documents' END, CASE WHEN list_sort(map_keys(evidence.source_documents)) <> list_sort(map_keys(hashes.source_documents)) THEN 'paths' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM cases""")
def identity_mismatches(spark, d):
    rows = _reduced(spark, d, "question_wire", "evidence", "hashes")
    clean = lambda c: F.lower(F.trim(c))
    documents = F.exists(F.map_entries("evidence.source_documents"), lambda e: F.coalesce(clean(F.try_element_at("hashes.source_documents", e.key)) != F.sha2(e.value, 256), F.lit(False)))
    paths = F.array_sort(F.map_keys("evidence.source_documents")) != F.array_sort(F.map_keys("hashes.source_documents"))
    own = lambda name, text: F.when(F.col(f"hashes.{name}").isNull(), f"{name}_missing").when(clean(F.col(f"hashes.{name}")) != F.sha2(text, 256), name)
    faults = F.array_compact(F.array(own("question", "question_wire"), own("evidence", "evidence.state"), F.when(documents, "source_documents"), F.when(paths, "paths")))
    return _once(rows.select("case_id", F.array_join(faults, ",").alias("mismatches")))


@REGISTRY.query(f"WITH {CASES}, x AS (SELECT case_id, target_complete, target.start_byte AS s, target.end_byte AS e, from_json(json_extract(evidence.state, '$.documents'), '[{{\"path\":\"VARCHAR\",\"start_byte\":\"BIGINT\",\"end_byte\":\"BIGINT\"}}]') AS docs, target.path AS path FROM cases) SELECT case_id, target_complete, coalesce(len(list_filter(docs, lambda q: q.path = path AND q.start_byte <= s AND q.end_byte >= e)) > 0, false) AS covered FROM x")
def target_material(spark, d):
    rows = _reduced(spark, d, "target", "target_complete", "evidence")
    state = F.from_json("evidence.state", "documents ARRAY<STRUCT<path: STRING, start_byte: BIGINT, end_byte: BIGINT>>")
    covers = F.exists(state["documents"], lambda q: (q.path == F.col("target.path")) & (q.start_byte <= F.col("target.start_byte")) & (q.end_byte >= F.col("target.end_byte")))
    return _once(rows.select("case_id", "target_complete", F.coalesce(covers, F.lit(False)).alias("covered")))


@REGISTRY.query(f"WITH {CASES}, x AS (SELECT case_id, evidence.source_documents AS docs, from_json(json_extract(evidence.state, '$.documents'), '[{{\"path\":\"VARCHAR\"}}]') AS listed FROM cases) SELECT case_id, len(listed)::INT AS documents, len(list_distinct(list_transform(listed, lambda q: q.path)))::INT AS files, coalesce(list_sum(list_transform(map_values(docs), lambda t: strlen(t))), 0)::BIGINT AS source_bytes, round(len(listed) / greatest(1, len(list_distinct(list_transform(listed, lambda q: q.path))))::DOUBLE, 3) AS density FROM x")
def evidence_metrics(spark, d):
    rows = _reduced(spark, d, "evidence").withColumn("listed", F.from_json("evidence.state", "documents ARRAY<STRUCT<path: STRING>>")["documents"])
    files = F.size(F.array_distinct("listed.path"))
    total = F.aggregate(F.map_values("evidence.source_documents"), F.lit(0).cast("bigint"), lambda acc, t: acc + F.octet_length(t))
    return _once(rows.select("case_id", F.size("listed").alias("documents"), files.alias("files"), F.coalesce(total, F.lit(0)).alias("source_bytes"), F.round(F.size("listed") / F.greatest(F.lit(1), files), 3).alias("density")))


@REGISTRY.query("WITH r AS (SELECT DISTINCT case_id, rule_id, hashes.evidence AS sha, strlen(question_wire) AS n FROM calibration_cases), one AS (SELECT rule_id, sha, min(n) AS n FROM r WHERE sha IS NOT NULL GROUP BY ALL UNION ALL SELECT rule_id, sha, n FROM r WHERE sha IS NULL) SELECT rule_id, count(*)::BIGINT AS n_requests, count(*) FILTER (sha IS NULL)::BIGINT AS n_without_hash, sum(n)::BIGINT AS n_bytes FROM one GROUP BY rule_id")
def usage_dedup(spark, d):
    rows = _cases(spark, d, "rule_id", "hashes", "question_wire").select("case_id", "rule_id", F.col("hashes.evidence").alias("sha"), F.octet_length("question_wire").alias("n"))
    known = rows.filter("sha IS NOT NULL").groupBy("rule_id", "sha").agg(F.min("n").alias("n"))
    every = known.unionByName(rows.filter("sha IS NULL").select("rule_id", "sha", "n"))
    return every.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("sha").isNull()).alias("n_without_hash"), F.sum("n").alias("n_bytes"))


@REGISTRY.query("SELECT event_id, CASE WHEN k % 7 = 0 THEN 'context_limit' WHEN k % 7 IN (1, 2) THEN 'rejected' WHEN k % 7 = 3 THEN 'retry' ELSE 'other' END AS kind, CASE WHEN k % 7 = 3 THEN least(30.0, pow(2, k % 5))::DOUBLE END AS wait FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE event_type = 'error')")
def rejection_kinds(spark, d):
    rows = table(spark, d, "events", "event_id", "event_type", "props").filter("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    status = F.col("k") % 7
    kind = F.when(status == 0, "context_limit").when(status.isin(1, 2), "rejected").when(status == 3, "retry").otherwise("other")
    return rows.select("event_id", kind.alias("kind"), F.when(status == 3, F.least(F.lit(30.0), F.pow(F.lit(2), F.col("k") % 5))).alias("wait"))


@REGISTRY.query("SELECT event_type, e.key AS field, count(*)::BIGINT AS n, count(DISTINCT e.value)::BIGINT AS n_values FROM (SELECT event_type, unnest(map_entries(from_json(props, '\"MAP(VARCHAR, VARCHAR)\"'))) AS e FROM events) GROUP BY ALL")
def machine_fields(spark, d):
    rows = table(spark, d, "events", "event_type", "props").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))
    return rows.groupBy("event_type", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


# --- routing


@REGISTRY.query(f"WITH {RULES_SQL}, m AS (SELECT unnest(['off', 'full', 'targeted']) AS mode) SELECT rule, mode, CASE mode WHEN 'off' THEN '' WHEN 'full' THEN 'callers,definitions,tests,enclosing_context' ELSE (SELECT coalesce(string_agg(f, ',' ORDER BY k), '') FROM (SELECT f, min(k) AS k FROM (SELECT CASE families[i] WHEN 'callees' THEN 'definitions' ELSE families[i] END AS f, i AS k FROM range(1, len(families) + 1) t(i)) WHERE f IN ('callers', 'definitions', 'tests', 'enclosing_context') GROUP BY f)) END AS families FROM rules, m")
def allowed_families(spark, d):
    rows = rules(spark).withColumn("mode", F.explode(F.array(*map(F.lit, ("off", "full", "targeted")))))
    return rows.select("rule", "mode", F.array_join(routing.allowed_families(F.col("mode"), F.col("families")), ",").alias("families"))


SCORES = "[struct_pack(name := 'callers', score := ('0x' || substr(sha256(case_id), 1, 2))::INT / 256.0::DOUBLE), struct_pack(name := 'definitions', score := ('0x' || substr(sha256(case_id), 3, 2))::INT / 256.0::DOUBLE), struct_pack(name := 'tests', score := ('0x' || substr(sha256(case_id), 5, 2))::INT / 256.0::DOUBLE)]"
ROUTED = f"{CASES}, r AS (SELECT case_id, CASE answer.choice WHEN 'lost' THEN 'local_evidence' WHEN 'kept' THEN 'sufficient' ELSE 'not_applicable' END AS choice, answer.confidence AS c, map_extract_value(answer.probabilities, answer.choice) AS p, {SCORES} AS scores FROM cases WHERE answer.type = 'choice'), routed AS (SELECT case_id, CASE WHEN c >= 0.4 AND p >= 0.3 THEN choice END AS disposition, CASE WHEN c >= 0.4 AND p >= 0.3 AND choice = 'local_evidence' THEN array_to_string(list_transform(list_sort(list_transform(list_filter(scores, lambda x: x.score >= 0.5), lambda x: struct_pack(k := -x.score, n := x.name))), lambda x: x.n), ',') ELSE '' END AS families FROM r)"


def _routed(spark, d):
    rows = _cases(spark, d, "answer").filter("answer.type = 'choice'")
    score = lambda i: F.conv(F.substring(F.sha2("case_id", 256), i, 2), 16, 10).cast("int") / 256.0
    scores = F.array(*(F.struct(F.lit(n).alias("name"), score(i).alias("score")) for n, i in (("callers", 1), ("definitions", 3), ("tests", 5))))
    choice = F.when(F.col("answer.choice") == "lost", "local_evidence").when(F.col("answer.choice") == "kept", "sufficient").otherwise("not_applicable")
    return rows.withColumn("r", routing.routing(choice, F.col("answer.confidence"), F.try_element_at("answer.probabilities", F.col("answer.choice")), scores, 0.4, 0.3, 0.5)).select("case_id", "r.disposition", "r.families")


@REGISTRY.query(f"WITH {ROUTED} SELECT * FROM routed")
def routing_decisions(spark, d):
    return _routed(spark, d).select("case_id", "disposition", F.array_join("families", ",").alias("families"))


@REGISTRY.query(f"WITH {ROUTED}, {RULED.replace(CASES + ', ', '')} SELECT case_id, CASE WHEN t.disposition = 'not_applicable' THEN 'not_applicable' ELSE r.status END AS status, CASE WHEN t.disposition = 'not_applicable' THEN 'model_routed_not_applicable' ELSE r.reason END AS reason FROM replayed r LEFT JOIN routed t USING (case_id)")
def routed_not_applicable(spark, d):
    gone = F.coalesce(F.col("disposition") == "not_applicable", F.lit(False))
    rows = _ruled(spark, d).join(_routed(spark, d), "case_id", "left")
    return rows.select("case_id", F.when(gone, "not_applicable").otherwise(F.col("status")).alias("status"), F.when(gone, "model_routed_not_applicable").otherwise(F.col("reason")).alias("reason"))


# --- measures of experiments


@REGISTRY.query(f"WITH {CASES}, p AS (SELECT target.path AS path, min(answer.noul) FILTER (answer.type = 'boolean') AS least, arg_min(answer, case_id) FILTER (answer.type = 'choice') AS k FROM cases GROUP BY ALL) SELECT path, CASE WHEN least IS NULL THEN 'no_parts' WHEN least >= 0.9 THEN 'error' WHEN least >= 0.71 THEN 'warning' ELSE 'ok' END AS together, CASE WHEN k IS NULL OR least IS NULL THEN 'no_pair' WHEN k.choice = 'unclear' THEN 'unknown' WHEN k.choice <> 'kept' THEN 'ok' WHEN least >= 0.9 AND map_extract_value(k.probabilities, 'kept') >= 0.9 AND k.confidence >= 0.7 THEN 'error' WHEN least >= 0.6 AND map_extract_value(k.probabilities, 'kept') >= 0.5 AND k.confidence >= 0.4 THEN 'warning' ELSE 'ok' END AS pair FROM p")
def composed_outcomes(spark, d):
    rows = _cases(spark, d, "target", "answer")
    of = lambda kind: F.col("answer.type") == kind
    per = rows.groupBy(F.col("target.path").alias("path")).agg(F.min(F.when(of("boolean"), F.col("answer.noul"))).alias("least"), F.min_by(F.when(of("choice"), F.col("answer")), F.when(of("choice"), F.col("case_id"))).alias("k"))
    pair = routing.compose_pair(F.col("least"), F.col("k.choice"), F.try_element_at("k.probabilities", F.lit("kept")), F.col("k.confidence"))
    return per.select("path", F.when(F.col("least").isNull(), "no_parts").otherwise(routing.compose_all(F.col("least"))).alias("together"), F.when(F.col("k").isNull() | F.col("least").isNull(), "no_pair").otherwise(pair).alias("pair"))


@REGISTRY.query(f"WITH {CASES} SELECT target.path AS path, count(*)::BIGINT AS n, count(DISTINCT rule_id)::BIGINT AS n_rules, count(DISTINCT concat_ws('/', coalesce(returned_model, ''), prompt.version, prompt.policy)) AS n_identities, count(DISTINCT concat_ws('/', coalesce(returned_model, ''), prompt.version, prompt.policy)) = 1 AND count(*) = count(DISTINCT rule_id) AS aligned FROM cases GROUP BY ALL")
def bundle_alignment(spark, d):
    rows = _cases(spark, d, "target", "rule_id", "returned_model", "prompt").withColumn("identity", F.concat_ws("/", F.coalesce("returned_model", F.lit("")), F.col("prompt.version").cast("string"), "prompt.policy"))
    out = rows.groupBy(F.col("target.path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("n_rules"), F.countDistinct("identity").alias("n_identities"))
    return out.withColumn("aligned", (F.col("n_identities") == 1) & (F.col("n") == F.col("n_rules")))


@REGISTRY.query(f"WITH {RULED}, g AS (SELECT rule_id, support, count(*) FILTER (label = 'Agree') AS a, count(*) FILTER (label = 'Agree' AND signal) AS h, count(*) FILTER (label = 'Disagree' AND signal) AS f FROM replayed GROUP BY ALL) SELECT rule_id, round(sum(h) / nullif(sum(a), 0)::DOUBLE, 6) AS case_recall, round(count(*) FILTER (support IS NOT NULL AND h > 0) / nullif(count(*) FILTER (support IS NOT NULL AND a > 0), 0)::DOUBLE, 6) AS group_recall, round(avg(h / a) FILTER (support IS NOT NULL AND a > 0), 6) AS within_group, sum(f)::BIGINT AS false_reviews, count(*) FILTER (support IS NOT NULL AND f > 0)::BIGINT AS groups_with_false FROM g GROUP BY rule_id")
def group_measures(spark, d):
    return routing.group_measures(_ruled(spark, d))


@REGISTRY.query(f"WITH {CASES}, m AS (SELECT rule_id, {SPLIT} AS split, label, coalesce(map_extract_value(answer.probabilities, '2'), 0) + coalesce(map_extract_value(answer.probabilities, '1'), 0) AS mass FROM cases WHERE answer.type = 'score') SELECT rule_id, split, round(avg(mass), 6) AS mean_mass, count(*) FILTER (mass >= 0.5)::BIGINT AS n_high, round(count(*) FILTER (mass >= 0.5 AND label = 'Agree') / nullif(count(*) FILTER (mass >= 0.5), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (mass >= 0.5 AND label = 'Agree') / nullif(count(*) FILTER (label = 'Agree'), 0)::DOUBLE, 6) AS recall FROM m GROUP BY ALL")
def mass_high_measures(spark, d):
    p = lambda k: F.coalesce(F.try_element_at("answer.probabilities", F.lit(k)), F.lit(0.0))
    rows = _cases(spark, d, "rule_id", "split", "label", "answer").filter("answer.type = 'score'").select("rule_id", replay.split_name(F.col("split")).alias("split"), "label", (p("2") + p("1")).alias("mass"))
    high, agree = F.col("mass") >= 0.5, F.col("label") == "Agree"
    out = rows.groupBy("rule_id", "split").agg(F.round(F.avg("mass"), 6).alias("mean_mass"), F.count_if(high).alias("n_high"), F.count_if(high & agree).alias("hits"), F.count_if(agree).alias("n_agree"))
    return out.select("rule_id", "split", "mean_mass", "n_high", F.round(F.try_divide("hits", "n_high"), 6).alias("precision"), F.round(F.try_divide("hits", "n_agree"), 6).alias("recall"))


@REGISTRY.query(f"WITH {CASES}, x AS (SELECT rule_id, label, CASE answer.type WHEN 'boolean' THEN CASE WHEN answer.noul >= 0.5 THEN 'Agree' ELSE 'Disagree' END WHEN 'score' THEN CASE WHEN answer.score >= 2 THEN 'Agree' WHEN answer.score >= 1 THEN 'Partial' ELSE 'Disagree' END ELSE CASE answer.choice WHEN 'lost' THEN 'Agree' WHEN 'unclear' THEN 'Partial' ELSE 'Disagree' END END AS derived FROM cases) SELECT rule_id, label, derived, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def derived_labels(spark, d):
    kind = F.col("answer.type")
    boolean = F.when(F.col("answer.noul") >= 0.5, "Agree").otherwise("Disagree")
    score = F.when(F.col("answer.score") >= 2, "Agree").when(F.col("answer.score") >= 1, "Partial").otherwise("Disagree")
    choice = F.when(F.col("answer.choice") == "lost", "Agree").when(F.col("answer.choice") == "unclear", "Partial").otherwise("Disagree")
    rows = _cases(spark, d, "rule_id", "label", "answer").select("rule_id", "label", F.when(kind == "boolean", boolean).when(kind == "score", score).otherwise(choice).alias("derived"))
    return rows.groupBy("rule_id", "label", "derived").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query(f"WITH {RULED} SELECT rule_id, coalesce(r.severity, r.tentative, 'none') AS shown, coalesce(r.adjudicated_severity, 'none') AS adjudicated, count(*)::BIGINT AS n, count(*) FILTER (c.target.start_line = 1)::BIGINT AS n_from_top FROM replayed r JOIN cases c USING (case_id, rule_id) WHERE r.signal GROUP BY ALL")
def severity_attribution(spark, d):
    where = _cases(spark, d, "target").select("case_id", F.col("target.start_line").alias("first"))
    rows = _ruled(spark, d).filter("signal").join(where, "case_id")
    return rows.groupBy("rule_id", F.coalesce("severity", "tentative", F.lit("none")).alias("shown"), F.coalesce("adjudicated_severity", F.lit("none")).alias("adjudicated")).agg(F.count(F.lit(1)).alias("n"), replay.count(F.col("first") == 1).alias("n_from_top"))


@REGISTRY.query(f"WITH {CASES}, s AS (SELECT {SPLIT} AS split, unnest(map_values(hashes.source_documents)) AS sha FROM cases) SELECT sha, count(*)::BIGINT AS n, count(DISTINCT split)::BIGINT AS n_splits FROM s WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) FILTER (split = 'development') > 0 AND count(*) FILTER (split <> 'development') > 0")
def source_leakage(spark, d):
    rows = _cases(spark, d, "split", "hashes").select(replay.split_name(F.col("split")).alias("split"), F.explode(F.map_values("hashes.source_documents")).alias("sha")).filter("sha IS NOT NULL")
    per = rows.groupBy("sha", "split").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_splits"), F.max(F.col("split") == "development").alias("dev"), F.max(F.col("split") != "development").alias("other"))
    return per.filter("dev AND other").select("sha", "n", "n_splits")


@REGISTRY.query(f"WITH {CASES}, a AS (SELECT case_id, arg_max(label, struct_pack(a := adjudicated_at, b := adjudication_id)) AS label FROM (SELECT DISTINCT case_id, label, adjudicated_at, adjudication_id FROM adjudications) GROUP BY case_id) SELECT c.case_id, c.rule_id, coalesce(a.label, c.label) AS label, CASE WHEN a.case_id IS NULL THEN 'recorded' ELSE 'adjudicated' END AS source, to_json(struct_pack(choice := c.answer.choice, noul := c.answer.noul, score := c.answer.score)) IS NOT NULL AS has_answer, 'final-' || left(sha256(concat_ws(chr(10), c.rule_id, c.target.id, c.question_wire, c.evidence.state)), 24) AS stable_id FROM cases c LEFT JOIN a USING (case_id)")
def imported_cases(spark, d):
    last = table(spark, d, "adjudications").groupBy("case_id").agg(F.max_by("label", F.struct("adjudicated_at", "adjudication_id")).alias("new")).withColumn("is_adjudicated", F.lit(True))
    stable = F.concat(F.lit("final-"), F.left(F.sha2(F.concat_ws("\n", "rule_id", "target.id", "question_wire", "evidence.state"), 256), F.lit(24)))
    rows = _once(_reduced(spark, d, "rule_id", "label", F.col("answer").isNotNull().alias("has_answer"), stable.alias("stable_id"))).join(last, "case_id", "left")
    return rows.select("case_id", "rule_id", F.coalesce("new", "label").alias("label"), F.when(F.col("is_adjudicated"), "adjudicated").otherwise("recorded").alias("source"), "has_answer", "stable_id")


@REGISTRY.query(f"WITH {RULED} SELECT rule_id, case_id, abs(round(coalesce(answer.noul, answer.score, 0), 3) - coalesce(answer.noul, answer.score, 0)) <= 0.0006 AS matches FROM replayed")
def displayed_match(spark, d):
    value = F.coalesce("answer.noul", "answer.score", F.lit(0.0))
    return _ruled(spark, d).select("rule_id", "case_id", (F.abs(F.round(value, 3) - value) <= 0.0006).alias("matches"))


@REGISTRY.query(f"WITH {CASES}, b AS (SELECT target.path AS path, rule_id, row_number() OVER (PARTITION BY target.path ORDER BY rule_id, case_id) AS k FROM cases) SELECT path, ((k - 1) // 2)::INT AS batch, count(*)::BIGINT AS n, string_agg(rule_id, ',' ORDER BY k) AS rules FROM b GROUP BY ALL")
def capture_batches(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("path").orderBy("rule_id", "case_id"))
    rows = _cases(spark, d, "target", "rule_id").select("case_id", "rule_id", F.col("target.path").alias("path")).withColumn("k", k).withColumn("batch", F.floor((F.col("k") - 1) / 2).cast("int"))
    out = rows.groupBy("path", "batch").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("k", "rule_id"))).alias("l"))
    return out.select("path", "batch", "n", F.array_join("l.rule_id", ",").alias("rules"))


@REGISTRY.query("WITH r AS (SELECT * FROM budget_estimates QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY estimated_at DESC, ingested_at DESC) = 1) SELECT model, scope, count(*)::BIGINT AS n, sum(body_bytes * 3)::BIGINT AS bytes_with_retries, sum(total_tokens + ceil(total_tokens * 0.25)::BIGINT)::BIGINT AS reserved, sum(greatest(1024, 28000 // (1 << (request_id % 4)::INT)))::BIGINT AS round_tokens, sum(least(1048576, (body_bytes * 7) // 10))::BIGINT AS round_bytes FROM r WHERE body_bytes > 0 GROUP BY ALL")
def capture_reservations(spark, d):
    from millrace.operators import services

    rows = services.latest(table(spark, d, "budget_estimates"), ["request_id"], ["estimated_at", "ingested_at"]).filter("body_bytes > 0")
    tokens = F.greatest(F.lit(1024), F.floor(F.lit(28_000) / F.pow(F.lit(2), F.col("request_id") % 4)))
    return rows.groupBy("model", "scope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("body_bytes") * 3).alias("bytes_with_retries"), F.sum(F.col("total_tokens") + F.ceil(F.col("total_tokens") * F.lit(0.25).cast("double"))).alias("reserved"), F.sum(tokens).cast("bigint").alias("round_tokens"), F.sum(F.least(F.lit(1_048_576), F.expr("body_bytes * 7 div 10"))).alias("round_bytes"))


@REGISTRY.query(f"WITH {CASES} SELECT rule_id, count(*)::BIGINT AS records, bool_and(context_complete AND target_complete) AS complete, bit_xor(('0x' || left(sha256(case_id || chr(10) || question_wire || chr(10) || coalesce(answer.choice, '')), 15))::BIGINT) AS digest FROM cases GROUP BY rule_id")
def capture_sidecar(spark, d):
    rows = _once(_reduced(spark, d, "rule_id", "context_complete", "target_complete", F.concat_ws("\n", "case_id", "question_wire", F.coalesce("answer.choice", F.lit(""))).alias("line")))
    return jsonl.sidecar(rows, F.col("line"), F.col("context_complete") & F.col("target_complete"), "rule_id")


@REGISTRY.query(f"WITH {RULED}, p AS (SELECT case_id, rule_id, CASE WHEN case_id IN (SELECT case_id FROM adjudications) THEN 'cached' WHEN answer.confidence < 0.3 THEN 'missing' ELSE 'live' END AS source, status FROM replayed) SELECT source, status, count(*)::BIGINT AS n, count(*) FILTER (source = 'live')::BIGINT AS n_stored FROM p GROUP BY ALL")
def predictions_by_source(spark, d):
    """Answers from the cache, else from the judge, which are then stored; those of neither are missing."""
    known = table(spark, d, "adjudications", "case_id").distinct().withColumn("hit", F.lit(True))
    source = F.when(F.col("hit"), "cached").when(F.col("answer.confidence") < 0.3, "missing").otherwise("live")
    rows = _ruled(spark, d).join(known, "case_id", "left").select(source.alias("source"), "status")
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "live").alias("n_stored"))

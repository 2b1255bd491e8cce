"""What a run reports: events of targets, and accounts of checks, targets, findings and exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "struct<type:string,noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>>"


def judge(checks: DataFrame) -> DataFrame:
    """Checks with an answer, whether it is cached, and whether its context is complete, all from digests: a judge that is the same everywhere."""
    p = F.conv(F.left(F.sha2(F.concat("target_id", F.lit(":"), "rule"), 256), F.lit(4)), 16, 10).cast("int") / 65536.0
    none = lambda kind: F.lit(None).cast(kind)
    answer = F.struct(F.lit("boolean").alias("type"), p.alias("noul"), none("string").alias("choice"), none("double").alias("score"), none("double").alias("confidence"), F.create_map().cast("map<string,double>").alias("probabilities"))
    cached = F.left(F.sha2(F.concat("rule", "target_id"), 256), F.lit(1)).isin("0", "1", "2", "3")
    return checks.withColumn("answer", answer).withColumn("cached", cached).withColumn("context_complete", (F.col("wanted") != "unit") | (F.col("start_byte") == 0))


def offline_answer(question_type: Column, labels: Column) -> Column:
    """The answer of a judge without a network: 0 for a boolean, the first label of a choice, the lowest level of a score, at full confidence."""
    first = F.get(labels, F.lit(0))
    sure = F.transform(labels, lambda x: F.struct(x.alias("key"), F.when(x == first, 1.0).otherwise(0.0).alias("value")))
    boolean, choice = question_type == "boolean", question_type == "choice"
    return F.struct(
        question_type.alias("type"), F.when(boolean, 0.0).alias("noul"), F.when(choice, first).alias("choice"), F.when(question_type == "score", 0.0).alias("score"), F.when(~boolean, 1.0).alias("confidence"), F.map_from_entries(sure).alias("probabilities"),
    )


def repo(path: str = "path") -> Column:
    return F.substring_index(path, "/", 2)


def _listed(value: str, when: Column | None = None) -> Column:
    """``rule=value`` of the rows where the value isn't null, by rule; null where there is none."""
    item = F.concat("rule", F.lit("="), value) if value != "rule" else F.col("rule")
    return F.nullif(F.array_join(F.array_sort(F.collect_list(item if when is None else F.when(when, item))), ","), F.lit(""))


def events(judged: DataFrame, skipped: DataFrame) -> DataFrame:
    """One event a judged target: its statuses, reasons, findings, tentative findings and cached rules, sorted by rule; a target is cached where all its answers are and nothing was skipped."""
    out = judged.groupBy("target_id").agg(_listed("status").alias("statuses"), _listed("reason").alias("reasons"), _listed("severity").alias("findings"), _listed("tentative").alias("tentative"), _listed("rule", F.col("cached")).alias("cached_rules"), F.min("cached").alias("_all"))
    gone = skipped.select("target_id").distinct().withColumn("_skips", F.lit(True))
    return out.join(gone, "target_id", "left").select("target_id", "statuses", "reasons", "findings", "tentative", "cached_rules", (F.col("_all") & F.col("_skips").isNull()).alias("cached"))


def checks(judged: DataFrame, skipped: DataFrame, inapplicable: DataFrame) -> DataFrame:
    """Per file how many checks were evaluated, skipped, not applicable by syntax, uncertain, and not applicable at all."""
    rows = judged.select("path", F.lit("evaluated").alias("what"), "status")
    for what, df in (("skipped", skipped), ("inapplicable", inapplicable)):
        rows = rows.unionByName(df.select("path", F.lit(what).alias("what"), F.lit(None).cast("string").alias("status")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    what, status = F.col("what"), F.col("status")
    return rows.groupBy("path").agg(n(what == "evaluated").alias("checks_evaluated"), n(what == "skipped").alias("checks_skipped"), n(what == "inapplicable").alias("applicability_skips"), n(status == "unknown").alias("uncertain"), n((what == "inapplicable") | (status == "not_applicable")).alias("not_applicable"))


def targets(judged: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per repository how many files and units were evaluated, cached and skipped; a target is skipped only if nothing of it was judged."""
    a = judged.groupBy("target_id", "path", "scope").agg(F.min("cached").alias("cached")).withColumn("judged", F.lit(True))
    b = skipped.select("target_id", "path", "scope").distinct().withColumn("skips", F.lit(True))
    rows = a.join(b, ["target_id", "path", "scope"], "full")
    j, s, file = F.col("judged").isNotNull(), F.col("skips").isNotNull(), F.col("scope") == "file"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(repo().alias("repo")).agg(n(file & j).alias("files_evaluated"), n(file & s & ~j).alias("files_skipped"), n(~file & j).alias("units_evaluated"), n(~file & F.col("cached") & ~s).alias("units_cached"), n(~file & s & ~j).alias("units_skipped"))


def findings(judged: DataFrame) -> DataFrame:
    """Per repository and severity the findings, those of rules that never block, and the tentative ones; zero where there is none."""
    severities = judged.withColumn("s", F.explode(F.array(F.lit("warning"), F.lit("error"))))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    found = F.col("severity") == F.col("s")
    return severities.groupBy(repo().alias("repo"), F.col("s").alias("severity")).agg(n(found).alias("findings"), n(found & ~F.col("blocks_exit")).alias("advisory"), n(F.col("tentative") == F.col("s")).alias("tentative"))


def exit_codes(judged: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per repository and threshold: 2 where anything was skipped, else 1 where a finding that blocks is at least as severe, else 0."""
    block = F.col("blocks_exit") & F.col("severity").isNotNull()
    per = judged.groupBy(repo().alias("repo")).agg(F.max(F.coalesce(block & (F.col("severity") == "error"), F.lit(False))).alias("e"), F.max(F.coalesce(block, F.lit(False))).alias("w"))
    gaps = skipped.select(repo().alias("repo")).distinct().withColumn("gap", F.lit(True))
    rows = per.join(gaps, "repo", "left").withColumn("fail_on", F.explode(F.array(*map(F.lit, ("never", "warning", "error")))))
    fails = ((F.col("fail_on") == "warning") & F.col("w")) | ((F.col("fail_on") == "error") & F.col("e"))
    return rows.select("repo", "fail_on", F.when(F.col("gap"), 2).when(fails, 1).otherwise(0).alias("exit_code"))


def review_queue(judged: DataFrame, priority: list[str], ranks: dict[str, int], most: int) -> DataFrame:
    """(path, target_id, rule, trigger, priority, place): the uncertain judgments of a file to look at again, ``most`` a file.

    The trigger is the first reason in order of priority that applies and that the rule asks for; places go by priority, start and rule.
    """
    reasons = F.array(*map(F.lit, priority))
    applies = lambda x: ((x == F.col("reason")) | ((x == "reduced_context") & ~F.col("context_complete"))) & F.array_contains("enrich_on", x)
    rows = judged.filter("status = 'unknown' AND enrich").withColumn("trigger", F.get(F.filter(reasons, applies), F.lit(0))).filter("trigger IS NOT NULL")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col("trigger"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("priority", "start_byte", "rule", "target_id"))
    return rows.withColumn("priority", rank).withColumn("place", place).filter(F.col("place") <= most).select("path", "target_id", "rule", "trigger", "priority", "place")

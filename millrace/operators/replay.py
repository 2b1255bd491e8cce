"""Offline calibration: replaying labelled answers, metrics by rule and split, and the search for thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.assessment import POLICY_FIELDS, assess

# The utility of an outcome by label.
UTILITY = {"Agree": (4.0, 2.0, -4.0), "Partial": (-1.0, 1.0, 0.0), "Disagree": (-8.0, -2.0, 0.0)}
PLACEHOLDERS = ["", "-", "none", "n/a", "unknown"]


def known_cases(cases: DataFrame, *columns: str) -> DataFrame:
    """One row a case of the columns asked for; repeated deliveries count once."""
    return cases.select("case_id", *[c for c in columns if c != "case_id"]).dropDuplicates(["case_id"])


def split_name(split: Column) -> Column:
    return F.lower(F.regexp_replace(split, r"[\s\-_]", ""))


def support_group(provenance: Column) -> Column:
    """The group a case supports: the first of its source, scenario and owner group that isn't missing or a placeholder, without case and
    outer blanks, after the name of its field."""
    def one(field: str) -> Column:
        key = F.lower(F.trim(F.get_json_object(provenance, f"$.{field}")))
        return F.when(~key.isin(PLACEHOLDERS), F.concat(F.lit(f"{field}:"), key))

    return F.coalesce(*map(one, ("source_group", "scenario_group", "owner_group")))


def replay(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """Cases with the outcome of their answer: status, reason, severity, tentative, confirmed, signal, group, split.

    ``policies`` has a row for each type of answer, or for each ``rule_id`` where it has that column.
    """
    rows = known_cases(cases, "rule_id", "answer", "context_complete", "split", "label", "adjudicated_severity", "provenance")
    key = "rule_id" if "rule_id" in policies.columns else "type"
    policy = policies.select(F.col(key).alias("_key"), F.struct(*POLICY_FIELDS).alias("policy"))
    rows = rows.join(F.broadcast(policy), F.col("rule_id" if key == "rule_id" else "answer.type") == F.col("_key"))  # a row a rule or type
    return assessed(rows.withColumn("support", support_group(F.col("provenance"))).withColumn("split", split_name(F.col("split"))))


def assessed(rows: DataFrame, *keep: str) -> DataFrame:
    """Records of rows with an answer and a policy."""
    rows = rows.withColumn("o", assess())
    confirmed = F.col("o.severity").isNotNull()
    signal = confirmed | F.col("o.tentative").isNotNull()
    return rows.select("case_id", "rule_id", "split", "label", "adjudicated_severity", "answer", "context_complete", "support", "o.status", "o.reason", "o.severity", "o.tentative", confirmed.alias("confirmed"), signal.alias("signal"), *keep)


def count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def report(records: DataFrame) -> DataFrame:
    """Per rule and split the counts and fractions of a calibration report in one map-side combined aggregate."""
    agree, disagree, partial = (F.col("label") == x for x in ("Agree", "Disagree", "Partial"))
    c, s = F.col("confirmed"), F.col("signal")
    out = records.groupBy("rule_id", "split").agg(
        F.count(F.lit(1)).alias("n"), count(c).alias("n_confirmed"), count(s).alias("n_signal"), count(c & agree).alias("agree_confirmed"), count(s & agree).alias("agree_signal"),
        count(agree).alias("n_agree"), count(c & disagree).alias("disagree_confirmed"), count(partial & s).alias("partial_signal"), count(F.col("status") == "unknown").alias("n_unknown"),
    )
    part = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return out.select("*", part("agree_confirmed", "n_confirmed").alias("precision"), part("agree_confirmed", "n_agree").alias("recall"), part("agree_signal", "n_agree").alias("review_recall"))


def utility(label: Column, confirmed: Column, signal: Column) -> Column:
    value = F.lit(None).cast("double")
    for name, (sure, maybe, none) in UTILITY.items():
        value = F.when(label == name, F.when(confirmed, sure).when(signal, maybe).otherwise(none)).otherwise(value)
    return value


def weighted_utility(records: DataFrame) -> DataFrame:
    """Per rule the utility of its cases, each weighing one over the size of its support group.

    Group sizes come from an aggregate joined back, not from a window, so a group with a third of all cases isn't sorted in one task.
    """
    rows = records.filter("support IS NOT NULL").withColumn("u", utility(F.col("label"), F.col("confirmed"), F.col("signal")))
    per = rows.groupBy("rule_id", "support").agg(F.sum("u").alias("u"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("rule_id").agg(F.round(F.sum(F.col("u") / F.col("n")), 6).alias("objective"), F.count(F.lit(1)).alias("n_groups"))


def review_list_recall(records: DataFrame) -> DataFrame:
    """Per rule the share of support groups with an agreed case in which a signal was given."""
    rows = records.filter("label = 'Agree' AND support IS NOT NULL").groupBy("rule_id", "support").agg(F.max(F.col("signal")).alias("hit"))
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("hit").alias("n_hit"))

"""Where more evidence is sought, how parts of a judgment are put together, and what an answer must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of evidence, and another name for one of them.
FAMILIES = ["callers", "definitions", "tests", "enclosing_context"]
ALIASES = {"callees": "definitions"}


def allowed_families(mode: Column, asked: Column) -> Column:
    """The families a rule may look at: none, all, or those it asks for, by their own names, each once and in order."""
    named = F.transform(asked, lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ALIASES.items() for v in kv)), x), x))
    known = F.array_distinct(F.filter(named, lambda x: x.isin(FAMILIES)))
    return F.when(mode == "off", F.array().cast("array<string>")).when(mode == "full", F.array(*map(F.lit, FAMILIES))).otherwise(known)


def routing(choice: Column, confidence: Column, probability: Column, scores: Column, least_confidence: float, least_probability: float, least_evidence: float) -> Column:
    """struct<disposition, families>: no disposition where it isn't confident; families, by falling score and then name, where evidence at hand would help.

    ``scores`` is an array of struct<name, score>.
    """
    sure = (confidence >= least_confidence) & (probability >= least_probability)
    passing = F.filter(scores, lambda x: x["score"] >= least_evidence)
    ordered = F.transform(F.array_sort(F.transform(passing, lambda x: F.struct((-x["score"]).alias("k"), x["name"].alias("name")))), lambda x: x["name"])
    none = F.array().cast("array<string>")
    return F.struct(F.when(sure, choice).alias("disposition"), F.when(sure & (choice == "local_evidence"), ordered).otherwise(none).alias("families"))


def compose_all(least: Column, error: float = 0.90, warning: float = 0.71) -> Column:
    """The outcome of parts that must all hold: of the least of their probabilities; null parts hold nothing."""
    return F.when(least >= error, "error").when(least >= warning, "warning").otherwise("ok")


def compose_pair(guarantee: Column, choice: Column, probability: Column, confidence: Column, error: tuple = (0.9, 0.9, 0.7), warning: tuple = (0.6, 0.5, 0.4)) -> Column:
    """The outcome of a guarantee and of whether it is kept: both must pass the gates of a level."""
    passes = lambda g: (guarantee >= g[0]) & (probability >= g[1]) & (confidence >= g[2])
    return F.when(choice == "unclear", "unknown").when(choice != "kept", "ok").when(passes(error), "error").when(passes(warning), "warning").otherwise("ok")


def answer_errors(answer: str, labels: Column) -> Column:
    """What is wrong with an answer to a question with these labels: type, choice or score out of range, other labels, or probabilities out of range."""
    a = lambda f: F.col(f"{answer}.{f}")
    keys, values = F.map_keys(a("probabilities")), F.map_values(a("probabilities"))
    scaled = a("type").isin("choice", "score")
    faults = [
        (~a("type").isin("boolean", "choice", "score"), "type"), ((a("type") == "boolean") & ~F.coalesce(a("noul").between(0, 1), F.lit(False)), "probability"),
        ((a("type") == "choice") & ~F.coalesce(F.array_contains(labels, a("choice")), F.lit(False)), "choice"),
        ((a("type") == "score") & ~F.coalesce((a("score") >= 0) & (a("score") < F.size(labels)), F.lit(False)), "score"),
        (scaled & (F.array_sort(keys) != F.array_sort(labels)), "labels"), (scaled & F.exists(values, lambda p: (p < 0) | (p > 1)), "range"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in faults)))


def key(prefix: str, *parts: Column) -> Column:
    """The key under which something is cached: the digest of a prefix and its parts, a line each."""
    return F.sha2(F.concat_ws("\n", F.lit(prefix), *parts), 256)


def group_measures(records: DataFrame) -> DataFrame:
    """Per rule: recall of cases, of groups, within groups on average, and how many false signals there are to look at, in all and per group."""
    agree, signal = F.col("label") == "Agree", F.col("signal")
    per = records.groupBy("rule_id", "support").agg(F.count_if(agree).alias("a"), F.count_if(agree & signal).alias("h"), F.count_if((F.col("label") == "Disagree") & signal).alias("f"))
    known = F.col("support").isNotNull() & (F.col("a") > 0)
    return per.groupBy("rule_id").agg(
        F.round(F.try_divide(F.sum("h"), F.sum("a")), 6).alias("case_recall"), F.round(F.try_divide(F.count_if(known & (F.col("h") > 0)), F.count_if(known)), 6).alias("group_recall"),
        F.round(F.avg(F.when(known, F.col("h") / F.col("a"))), 6).alias("within_group"), F.sum("f").alias("false_reviews"), F.count_if(F.col("support").isNotNull() & (F.col("f") > 0)).alias("groups_with_false"),
    )

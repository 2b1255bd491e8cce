"""Whether recorded cases may be compared: conflicts within an identity, and an authority they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .replay import known_cases, split_name


def conflicts(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(``key``, field, n): how many values each field has among the rows of a key; above one, they can't be compared. Nulls are no value.

    Values are made distinct by key and field before they are counted, so no key's rows meet in one task.
    """
    parts = F.array(*(F.struct(F.lit(name).alias("field"), F.expr(e).cast("string").alias("value")) for name, e in fields.items()))
    long = rows.select(key, F.explode(parts).alias("x")).select(key, "x.*").distinct()
    return long.groupBy(key, "field").agg(F.count("value").alias("n"))


def identity(cases: DataFrame) -> DataFrame:
    """(case_id, rule_id, split, model, version, policy) of each case; blank texts and versions below 1 are null."""
    rows = known_cases(cases, "rule_id", "split", "returned_model", "prompt")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select("case_id", "rule_id", split_name(F.col("split")).alias("split"), text(F.col("returned_model")).alias("model"), F.when(F.col("prompt.version") >= 1, F.col("prompt.version")).alias("version"), text(F.col("prompt.policy")).alias("policy"))


def check(cases: DataFrame, authority_split: str = "development") -> DataFrame:
    """(case_id, rule_id, split, field, actual, expected): each case's identity beside that of its rule's authority, the first complete case
    of ``authority_split`` by case_id and split; null where there is none. A rule has one authority, so it is broadcast."""
    rows = identity(cases)
    names = ("model", "version", "policy")
    complete = rows.dropna(subset=list(names)).filter(F.col("split") == authority_split)
    authority = complete.groupBy("rule_id").agg(F.min_by(F.struct(*names), F.concat_ws("\n", "case_id", "split")).alias("a"))
    both = rows.join(F.broadcast(authority), "rule_id", "left")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("actual"), F.col(f"a.{c}").cast("string").alias("expected")) for f, c in zip(("returned_model", "prompt.version", "prompt.policy"), names)))
    return both.select("case_id", "rule_id", "split", F.explode(fields).alias("x")).select("case_id", "rule_id", "split", "x.*")


def reasons(checked: DataFrame, scope: str) -> DataFrame:
    """(rule_id, split, reason, n_cases): why the cases of a rule and split can't be used together, or ``compatible``."""
    different = F.coalesce(F.col("actual") != F.col("expected"), F.lit(False))
    any_ = lambda c: F.max(c)
    out = checked.groupBy("rule_id", "split").agg(
        F.count_if(F.col("field") == "returned_model").alias("n_cases"), any_(F.col("actual").isNull()).alias("missing"), any_(F.col("expected").isNotNull()).alias("known"),
        any_(different & (F.col("field") == "returned_model")).alias("model"), any_(different & (F.col("field") != "returned_model")).alias("prompt"),
    )
    named: Column = F.when(~F.col("known"), "no_development_authority").when(F.col("missing"), f"{scope}_compatibility_metadata_missing").when(~F.col("model") & ~F.col("prompt"), "compatible")
    named = named.when(~F.col("prompt"), f"{scope}_model_mismatch").when(~F.col("model"), f"{scope}_prompt_mismatch").otherwise(f"{scope}_model_prompt_mismatch")
    return out.select("rule_id", "split", named.alias("reason"), "n_cases")

"""The queries of the ten problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import Registry
from millrace.sources.tables import table

from . import encoding, grouping, handwritten, mixing, overlap, packing, reading, secrets, splitting, syntax
from .sql import SQL

REGISTRY = Registry()


def _register(f):
    return REGISTRY.query(SQL.get(f.__name__))(f)


@_register
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "calibration_cases"))


@_register
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.classes(table(spark, d, "calibration_cases"))


@_register
def p1_fractions(spark: SparkSession, d: str) -> DataFrame:
    return overlap.fractions(table(spark, d, "calibration_cases"))


@_register
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "calibration_cases"))


@_register
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files")).select("file_id")


@_register
def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    named = handwritten.not_handwritten(table(spark, d, "source_files"))
    return named.groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


@_register
def p2_handwritten_units(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.handwritten_units(table(spark, d, "units"), table(spark, d, "source_files"))


@_register
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "units"), table(spark, d, "source_files"), table(spark, d, "size_limits"))


@_register
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_units(table(spark, d, "units"), table(spark, d, "source_files"), table(spark, d, "size_limits"))


@_register
def p3_check(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces_check(table(spark, d, "units"), table(spark, d, "source_files"), table(spark, d, "size_limits"))


@_register
def p4_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "budget_estimates"), table(spark, d, "pack_limits"))


@_register
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p4_containers(spark, d), table(spark, d, "pack_limits"))


@_register
def p4_check(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_check(table(spark, d, "budget_estimates"), table(spark, d, "pack_limits"))


@_register
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credential_lines(table(spark, d, "source_files"), table(spark, d, "calibration_cases"))


@_register
def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted_texts(table(spark, d, "source_files"), table(spark, d, "calibration_cases"))


@_register
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "source_files")).select("file_id")


@_register
def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"))


@_register
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.groups(table(spark, d, "calibration_cases"), table(spark, d, "adjudications"))


@_register
def p7_forest(spark: SparkSession, d: str) -> DataFrame:
    return grouping.forest(table(spark, d, "calibration_cases"), table(spark, d, "adjudications"))


@_register
def p7_tree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return grouping.tree_sizes(table(spark, d, "calibration_cases"), table(spark, d, "adjudications"))


@_register
def p7_together(spark: SparkSession, d: str) -> DataFrame:
    return grouping.together(p7_splits(spark, d))


@_register
def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouping.assign_splits(table(spark, d, "calibration_cases"), table(spark, d, "adjudications"), table(spark, d, "split_targets"))


@_register
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return grouping.split_report(p7_splits(spark, d), table(spark, d, "split_targets"))


@_register
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")


@_register
def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return encoding.roundtrip(table(spark, d, "documents", "text"))


@_register
def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    return encoding.roundtrip(table(spark, d, "documents", "text")).select("n_docs", "n_exact")


@_register
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[0]


@_register
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[1]


@_register
def p9_check(spark: SparkSession, d: str) -> DataFrame:
    return mixing.caps_check(p9_mix(spark, d), table(spark, d, "documents", "doc_id", "source"), table(spark, d, "mix_targets"))


@_register
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "reading_labels"))


@_register
def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "reading_labels"))


@_register
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "reading_labels"))

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = "source_files units diagnostics calibration_cases adjudications budget_estimates documents size_limits pack_limits split_targets mix_targets reading_labels".split()
CLASHES = "ids tokens u r n key side lines digests label_ h shard m size part arrival spans verdict notice rules sizes hits fault codes dialect word words level_ score band bucket vertex copies base extra bound df evidence question class_id task salt rest".split()


def _cases() -> dict:
    """Each operator as a function of the tables."""
    from millrace.llm import encoding, grouping, handwritten, mixing, overlap, packing, reading, secrets, splitting, syntax

    return {
        "p1": lambda t: overlap.found(t["calibration_cases"]),
        "p1_classes": lambda t: overlap.classes(t["calibration_cases"]),
        "p1_report": lambda t: overlap.report(t["calibration_cases"]),
        "p2": lambda t: handwritten.not_handwritten(t["source_files"]),
        "p3": lambda t: splitting.split_units(t["units"], t["source_files"], t["size_limits"]),
        "p4": lambda t: packing.pack(t["budget_estimates"], t["pack_limits"]),
        "p5": lambda t: secrets.credential_lines(t["source_files"], t["calibration_cases"]),
        "p6": lambda t: syntax.invalid(t["source_files"]),
        "p7": lambda t: grouping.groups(t["calibration_cases"], t["adjudications"]),
        "p7_splits": lambda t: grouping.assign_splits(t["calibration_cases"], t["adjudications"], t["split_targets"]),
        "p8": lambda t: encoding.encode(t["documents"].select("doc_id", "text")),
        "p9": lambda t: mixing.mix(t["documents"], t["mix_targets"])[0],
        "p10": lambda t: reading.levels(t["documents"], t["reading_labels"]),
    }


@pytest.fixture(scope="session")
def operators():
    return _cases()


@pytest.fixture(scope="session")
def tables(spark, data) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{data}/{t}.parquet") for t in TABLES}


@pytest.fixture(scope="session")
def clashing(tables):
    """The same tables with further columns whose names operators use inside."""
    return {t: df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c not in df.columns)) for t, df in tables.items()}


@pytest.fixture(scope="session")
def nulled(tables):
    """The tables with, besides their rows, a few rows for each column in which it is null."""
    out = {}
    for name, df in tables.items():
        some = df.limit(3)
        rows = df
        for c in df.columns:
            rows = rows.unionByName(some.withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        out[name] = rows
    return out

"""Cases as JSON lines: a writer in order, a strict reader, a report of what is wrong with which line, and sidecars of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.folds import running

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_cases(cases: DataFrame, path: str) -> None:
    """One object a line, by case_id over all files of the folder; fields without a value are left out, as the reader takes them as null."""
    rows = cases.repartitionByRange("case_id").sortWithinPartitions("case_id") if "case_id" in cases.columns else cases
    rows.write.mode("overwrite").json(path, timestampFormat=STAMP)


def read_cases(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a folder of JSON lines under a declared schema; a line that doesn't fit ends the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST", timestampFormat=STAMP)


def faults(spark: SparkSession, path: str, schema: StructType, key: str = "case_id") -> DataFrame:
    """(file, line_no, error) of the lines a strict reader refuses: ``empty``, ``invalid``, ``unknown_field``, or ``duplicate`` of an earlier line's key.

    Lines are numbered within their file by a running count over ranges, so a file may be of any size.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("_at"), F.col("value"))
    rows = running(lines, "file", ["_at"], F.lit(1), "line_no")
    bad = StructType.fromJson(schema.jsonValue()).add("_bad", "string")
    parsed = F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "timestampFormat": STAMP})
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    unknown = F.size(F.array_except(F.json_object_keys("value"), names)) > 0
    error = F.when(F.trim("value") == "", "empty").when(F.json_object_keys("value").isNull() | F.col("_p._bad").isNotNull(), "invalid").when(unknown, "unknown_field")
    rows = rows.withColumn("_p", parsed).withColumn("error", error).withColumn("_key", F.get_json_object("value", f"$.{key}"))
    first = rows.filter("error IS NULL AND _key IS NOT NULL").groupBy("_key").agg(F.min(F.struct("file", "line_no")).alias("_first"))
    judged = rows.join(first, "_key", "left").withColumn("error", F.coalesce("error", F.when(F.struct("file", "line_no") > F.col("_first"), "duplicate")))
    return judged.filter("error IS NOT NULL").select("file", F.col("line_no").cast("bigint").alias("line_no"), "error")


def sidecar(lines: DataFrame, line: Column, complete: Column, *by: str) -> DataFrame:
    """(by, records, complete, digest) of a capture: how many lines, whether none is missing, and a digest of all of them in any order."""
    part = F.conv(F.left(F.sha2(line, 256), F.lit(15)), 16, 10).cast("bigint")
    return lines.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.min(complete).alias("complete"), F.bit_xor(part).alias("digest"))

"""Evidence of a check: slices of source, their validity and identity, import lines, relations of siblings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spans import merge_spans, read

from .folds import fold

IMPORT = r"^\s*(?:import |from \S+ import |use |require |export .* from )"
_IMPORT = re.compile(IMPORT)


def abbreviated(signature: Column, most: int = 1024) -> Column:
    """A signature as shown: beyond ``most`` characters it is cut and says so."""
    return F.when(F.length(signature) > most, F.concat(F.left(signature, F.lit(most)), F.lit(" [signature abbreviated]"))).otherwise(signature)


def imports(files: DataFrame, most: int = 32) -> DataFrame:
    """(path, line_no, text) of the first ``most`` import lines of each file, cut at 1,024 characters.

    Lines are filtered inside their array, so only imports become rows.
    """
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.left(x, F.lit(1024)).alias("text")))
    kept = F.slice(F.filter(lines, lambda x: x.text.rlike(IMPORT)), 1, most)
    return files.filter("content IS NOT NULL").select("path", F.explode(kept).alias("l")).select("path", "l.line_no", "l.text")


def sibling_calls(units: DataFrame, files: DataFrame) -> DataFrame:
    """(parent_id, caller, callee): a declaration whose body calls another one of its owner by name. Names called in bodies meet the owner's members by equality."""
    members = units.filter("parent_id IS NOT NULL AND body_start_byte >= 0 AND body_end_byte > body_start_byte").select("unit_id", "parent_id", "path", "name", "body_start_byte", "body_end_byte")
    calls = read(members, files, "unit_id", "body_start_byte", "body_end_byte").select("unit_id", F.explode(F.array_distinct("calls")).alias("name"))
    called = calls.join(members.select("unit_id", "parent_id"), "unit_id").select("parent_id", F.col("unit_id").alias("caller"), "name")
    return called.join(members.select("parent_id", "name", F.col("unit_id").alias("callee")), ["parent_id", "name"]).filter("caller <> callee").select("parent_id", "caller", "callee")


def skip_fit(items: DataFrame, group: str, order: list[str], item: str, size: str, room: int, most: int) -> DataFrame:
    """The items each group admits in order: one that doesn't fit is passed over and later ones are still tried, ``most`` at most."""
    rows = items.select(group, *order, *[c for c in (item, size) if c not in order])

    def step(state: list, row: tuple) -> int:
        if state[0] >= most or state[1] + row[0] > room:
            return -1
        state[0], state[1] = state[0] + 1, state[1] + row[0]
        return state[0] - 1

    return fold(rows, [group], order, [size], T.StructField("place", T.IntegerType()), lambda: [0, 0], step).filter("place >= 0").select(group, "place", item)


def paced(df: DataFrame, key: str, order: list[str], ready: str, interval: int) -> DataFrame:
    """``df`` with ``starts``: the time, in the whole units of ``ready``, at which a limiter lets each event begin, ``interval`` apart and not before it is ready.

    The recursion start = max(ready, last start + interval) unrolls to a running maximum of ready less the waiting before it.
    """
    w = Window.partitionBy(key).orderBy(*order)
    n = (F.row_number().over(w) - 1).cast("bigint")
    rows = df.withColumn("_n", n)
    return rows.withColumn("starts", F.max(F.col(ready) - F.col("_n") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * interval).drop("_n")


def import_spans(files: DataFrame, most: int = 32) -> DataFrame:
    """(path, start_byte, end_byte) of the first ``most`` import lines of each file, without their line ends. ``files`` has one row a path."""
    rows = files.filter("content IS NOT NULL").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = 0, 0
                for line in text.split("\n"):
                    size = len(line.encode("utf-8", "replace"))
                    if n < most and size and _IMPORT.match(line[:1024]):
                        out.append((path, at, at + size))
                        n += 1
                    at += size + 1
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "start_byte", "end_byte"])

    return rows.mapInArrow(run, "path STRING, start_byte BIGINT, end_byte BIGINT")


def compose(wanted: DataFrame, imports: DataFrame, key: str) -> DataFrame:
    """(``key``, start_byte, end_byte): the documents of each wanted span, which are it and its file's imports, merged where they touch.

    ``wanted`` has key, path, from_byte and to_byte; a span is joined to the few imports of its file by path.
    """
    own = wanted.select(key, F.col("from_byte").alias("start_byte"), F.col("to_byte").alias("end_byte"))
    return merge_spans(own.unionByName(wanted.select(key, "path").join(imports, "path").select(key, "start_byte", "end_byte")), key)


def describe(wanted: DataFrame, documents: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(``key``, n_documents, n_bytes, context_complete, target_complete): whether one document covers what was wanted, and the target itself."""
    both = documents.join(wanted.select(key, "from_byte", "to_byte"), key).join(targets.select(key, F.col("start_byte").alias("_s"), F.col("end_byte").alias("_e")), key)
    covers = lambda a, b: F.max((F.col("start_byte") <= F.col(a)) & (F.col("end_byte") >= F.col(b)))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), covers("from_byte", "to_byte").alias("context_complete"), covers("_s", "_e").alias("target_complete"))


def augment(documents: DataFrame, candidates: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """(``key``, path, start_byte, end_byte, file_sha): documents and candidate spans of an evidence united by path and merged, with their file's digest."""
    every = documents.select(key, "path", "start_byte", "end_byte").unionByName(candidates.select(key, "path", "start_byte", "end_byte"))
    named = every.withColumn("_group", F.concat_ws("\n", key, "path"))
    merged = merge_spans(named, "_group").join(named.select("_group", key, "path").distinct(), "_group")
    return merged.join(digests, "path").select(key, "path", "start_byte", "end_byte", "file_sha")

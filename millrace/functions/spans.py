"""Intervals of bytes, zero-based and end-exclusive."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.folds import fold


CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\(")
_QUOTED = r"\"[^\"\\\n]*(?:\\[^\n][^\"\\\n]*)*\"|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'"
STRIPPED = {"#": _QUOTED + r"|#[^\n]*", "//": _QUOTED + r"|//[^\n]*|(?s:/\*.*?\*/)"}
_STRIP = {k: re.compile(v) for k, v in STRIPPED.items()}
HASHED = re.compile(r"\.(?:pyi?|p[lm]|t)$", re.I)


def called(text: str, path: str) -> list[str]:
    """The names that code calls, in order; what stands in its literals and comments calls nothing."""
    return CALL.findall(_STRIP["#" if HASHED.search(path) else "//"].sub(" ", text))


def read(spans: DataFrame, files: DataFrame, key: str, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """(``key``, path, first_line, last_line, starts_whole, ends_whole, text, calls) of each possible span of a file: its lines, whether it begins
    and ends between characters, its text (a cut character becomes a replacement sign) and the names called in it.

    ``files`` has one row a path. Spans are gathered by path, so each content moves once and is searched once; spans that are null,
    reversed, empty or beyond the file have no row.
    """
    lists = spans.filter(F.col(start) >= 0).groupBy("path").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))).alias("l"))
    both = lists.join(files.filter("content IS NOT NULL").select("path", "content"), "path").select("path", "content", "l")
    fields = pa.schema([(key, pa.string()), ("path", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("starts_whole", pa.bool_()), ("ends_whole", pa.bool_()), ("text", pa.string()), ("calls", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, own in zip(*(c.to_pylist() for c in batch.columns)):
                body = content.encode("utf-8", "replace")
                breaks = np.flatnonzero(np.frombuffer(body, np.uint8) == 10)
                whole = lambda at: at >= len(body) or body[at] & 0xC0 != 0x80
                for x in own:
                    s, e = x["s"], x["e"]
                    if e is None or not 0 <= s < e <= len(body):
                        continue
                    text = body[s:e].decode("utf-8", "replace")
                    first, last = (int(np.searchsorted(breaks, at)) + 1 for at in (s, max(s, e - 1)))
                    out.append((x["k"], path, first, last, whole(s), whole(e), text, called(text, path)))
            columns = list(zip(*out)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return both.mapInArrow(run, f"{key} STRING, path STRING, first_line INT, last_line INT, starts_whole BOOLEAN, ends_whole BOOLEAN, text STRING, calls ARRAY<STRING>")


def n_inside(spans: DataFrame, key: str, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """``spans`` with ``n_inside``: how many other spans of their key lie in them, equal ones included, by a sweep from the last start to the first."""
    rows = spans.filter(F.col(start) < F.col(end)).withColumn("_back", -F.col(start))
    equal = Window.partitionBy(key, start, end)
    rows = rows.withColumn("_later", F.count(F.lit(1)).over(equal) - 1)

    def step(ends: list, row: tuple) -> int:
        n = bisect_right(ends, row[1])
        ends.insert(n, row[1])
        return n

    swept = fold(rows, [key], ["_back", end], [start, end], T.StructField("_ahead", T.LongType()), list, step)
    # of equal spans each has those before it in the sweep; the others come after
    nth = F.row_number().over(Window.partitionBy(key, start, end).orderBy("_ahead"))
    return swept.withColumn("n_inside", (F.col("_ahead") + F.col("_later") - (nth - 1)).cast("bigint")).drop("_back", "_later", "_ahead")


def merge_spans(df: DataFrame, key: str, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Per key the maximal spans covered by spans that touch or overlap: gaps and islands over a running greatest end.

    Null and reversed spans are left out; a key's spans are sorted in one window, keys spread over the cluster.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    ahead = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.filter(F.col(start) < F.col(end)).select(key, F.col(start).alias("s"), F.col(end).alias("e"), F.when(F.col(start) <= ahead, 0).otherwise(1).alias("new"))
    island = F.sum("new").over(Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).groupBy(key, "island").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("island")


def gaps(merged: DataFrame, sizes: DataFrame, key: str, size: str, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Per key of ``sizes`` the ranges of [0, size) that no merged span covers."""
    w = Window.partitionBy(key).orderBy("s", "e")
    spans = merged.select(key, F.col(start).alias("s"), F.col(end).alias("e"))
    edge = sizes.select(key, F.col(size).alias("s"), F.col(size).alias("e"))
    rows = spans.join(sizes.select(key), key, "left_semi").unionByName(edge)
    before = F.coalesce(F.lag("e").over(w), F.lit(0))
    return rows.select(key, before.alias(start), F.col("s").alias(end)).filter(F.col(start) < F.col(end))


def innermost(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, point_id: list[str], span_id: str) -> DataFrame:
    """Each point with the smallest closed span of its key that holds it; null where none does.

    The equality of ``key`` makes it a hash or merge join filtered by range; the least by (length, start, id) is a
    map-side combined aggregate, so no group of matches is sorted or held.
    """
    pairs = points.join(spans.select(key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(span_id).alias("_id")), key).filter((F.col("_s") <= F.col(point)) & (F.col(point) <= F.col("_e")))
    best = pairs.groupBy(*point_id).agg(F.min(F.struct(F.col("_e") - F.col("_s"), "_s", "_id")).alias("_m")).select(*point_id, F.col("_m._id").alias(span_id))
    return points.join(best, point_id, "left")

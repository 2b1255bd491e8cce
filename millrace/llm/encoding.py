"""Problem 8: the ids of every document under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenizer import DEFAULT_VOCABULARY, Encoder, load_ranks

_ENCODERS: dict[str, Encoder] = {}


def vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """The vocabulary file as a broadcast; its size is that of the file (under 2 MB), whatever the data."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _encoder(handle, path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(handle.value))
    return _ENCODERS[path]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the ids of ``text`` as an array of integers in ``ids``.

    Null and empty texts have the empty list. Rows are kept as they come, repeats included; other columns pass
    through, and an existing column ``ids`` is replaced. A narrow map: no shuffle, one pass over the text.
    """
    df = df.drop(ids)
    handle = vocabulary(df.sparkSession, path)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(handle, path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                lists = [encoder.encode(t) for t in column.slice(first, 512).to_pylist()]
                offsets = pa.array([0, *_running(lists)], pa.int32())
                flat = b"".join(x.tobytes() for x in lists)
                values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, values)], names=[*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def _running(lists) -> Iterator[int]:
    total = 0
    for x in lists:
        total += len(x)
        yield total


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by its number of ids in ``tokens``; null and empty texts have 0."""
    handle = vocabulary(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text, tokens)]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(handle, path)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n = pa.array([encoder.count(t) for t in table[text].to_pylist()], pa.int64())
            yield from table.select(keep).append_column(tokens, n).to_batches()

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids`` in ``text``: vocabulary strings put together, read as UTF-8. Null ids give null."""
    df = df.drop(text)
    handle = vocabulary(df.sparkSession, path)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = {i: s for s, i in _encoder(handle, path).ranks.items()}
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = [None if r is None else b"".join(map(strings.__getitem__, r)).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def roundtrip(df: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row: documents, ids in all, and documents whose ids decode to their text again (null counts as empty)."""
    both = decode(encode(df.select("text"), path=path), path=path)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("bigint").alias("n_ids"), F.count_if(same).alias("n_exact"))

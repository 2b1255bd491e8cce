"""Problem 1: cases that stand in an evaluation split and, the same or nearly, in the development split.

Distinct lines without white space are cut by a rolling hash into content-defined chunks; chunk digests are joined across
splits; the summed lengths of shared chunks give overlap fractions, and an exact check of lines and words decides.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import keep

from .grouping import clean_key

WINDOW, MASK = 16, 31
_RNG = np.random.default_rng(2023)
_GEAR = _RNG.integers(0, 2**32, 256, np.uint32)
_VALUE = _RNG.integers(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def chunk(lines: list[bytes]) -> tuple[np.ndarray, ...]:
    """(line digests, chunk digests, chunk lengths, line number of each chunk) of lines, none of them holding a line end.

    A chunk ends where the gear hash of the last 16 bytes of its line has five zero bits, and with its line; so equal
    lines always have equal chunks, wherever they stand.
    """
    if not lines:
        none = np.empty(0, np.int64)
        return none, none, none, none
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    body = np.frombuffer(b"".join(lines), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(body)
    owner = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(n) - starts[owner]
    gear = _GEAR[body]
    rolled = gear.copy()
    for j in range(1, WINDOW):
        rolled[j:] += gear[:-j] << np.uint32(j)
    cut = ((rolled >> np.uint32(WINDOW)) & np.uint32(MASK)) == 0
    cut &= (place >= WINDOW - 1) & (place < (sizes[owner] - 4))
    cut[ends - 1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    # a digest is the sum of value * base**place, from running sums that wrap at 64 bits
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = np.uint64(_BASE)
    powers = np.multiply.accumulate(powers)
    back = np.ones(n + 1, np.uint64)
    back[1:] = np.uint64(_INVERSE)
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_VALUE[body] * powers[:-1])])
    digests = _mix((total[last + 1] - total[first]) * back[first] + (last - first).astype(np.uint64))
    whole = _mix((total[ends] - total[starts]) * back[starts] + sizes.astype(np.uint64))
    return whole, digests, last - first + 1, owner[first]


def plain_lines(documents: list[str | None]) -> list[bytes]:
    """The distinct non-blank lines of all documents without their white space."""
    seen = {"".join(line.split()) for text in documents if text for line in text.split("\n")}
    seen.discard("")
    return [line.encode("utf-8", "replace") for line in seen]


def question_words(wire: str | None) -> list[str]:
    """The distinct words of ``instructions`` without case and punctuation; none where the wire isn't a JSON object."""
    try:
        text = json.loads(wire).get("instructions") if wire else None
    except (ValueError, AttributeError):
        return []
    return sorted(set(re.findall(r"[^\W_]+", text.lower()))) if isinstance(text, str) else []


def side(split):
    """dev, eval or null of a split's name, whatever its case, blanks, hyphens and underscores."""
    name = F.lower(F.regexp_replace(split, r"[\s\-_]", ""))
    return F.when(name == "development", "dev").when(name.isin("heldout", "validation"), "eval")


CHUNKED = "case_id STRING, side STRING, split STRING, source STRING, evidence BIGINT, question BIGINT, words ARRAY<STRING>, lines ARRAY<BIGINT>, digests ARRAY<BIGINT>, lengths ARRAY<INT>"
_PARTS = 0xFFFF  # the low bits of a chunk's digest: into how many chunks its line was cut


def weight(digest):
    """The lines a chunk stands for: one over the number of chunks of its line, which its digest holds."""
    return 1.0 / digest.bitwiseAND(F.lit(_PARTS))


def occurrences(digests: np.ndarray, parts: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, digests) by case: each chunk's digest with the number of chunks of its line and its count among equal ones of the case.

    So a case's chunks are a set, and the weights of the chunks two cases share sum up to at least the number of lines they share.
    """
    mixed = _mix(digests.view(np.uint64) * np.uint64(_BASE) + parts.astype(np.uint64))
    order = np.lexsort((mixed, case))
    mixed, case = mixed[order], case[order]
    new = np.concatenate([[True], (case[1:] != case[:-1]) | (mixed[1:] != mixed[:-1])]) if len(case) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(case)), 0)) if len(case) else case
    turn = (np.arange(len(case)) - first).astype(np.uint64)
    mixed = _mix(mixed.view(np.uint64) + turn * np.uint64(_BASE))
    return order, (mixed & ~np.int64(_PARTS)) | np.clip(parts[order], 1, _PARTS)


def chunked(cases: DataFrame) -> DataFrame:
    """One row per case row of either side with its classes (evidence, question), line digests and chunks.

    Cases with no line or no word can match nothing and are left out.
    """
    split = F.lower(F.regexp_replace("split", r"[\s\-_]", ""))
    source = F.coalesce(clean_key(F.get_json_object("provenance", "$.source_group")), F.lit("(none)"))
    rows = cases.select("case_id", side(F.col("split")).alias("side"), split.alias("split"), source.alias("source"), "question_wire", F.map_values("evidence.source_documents").alias("documents"))
    rows = rows.filter("case_id IS NOT NULL AND side IS NOT NULL")
    kinds = pa.schema([(n, pa.string()) for n in ("case_id", "side", "split", "source")] + [("evidence", pa.int64()), ("question", pa.int64()), ("words", pa.list_(pa.string())), ("lines", pa.list_(pa.int64())), ("digests", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                docs, wires = batch.column(5).to_pylist(), batch.column(4).to_pylist()
                words = [question_words(w) for w in wires]
                lines = [plain_lines(d or []) for d in docs]
                counts = np.fromiter(map(len, lines), np.int64, len(lines))
                of_line = np.repeat(np.arange(len(lines)), counts)
                whole_lines, digests, lengths, owner = chunk([x for own in lines for x in own])
                parts = np.bincount(owner, minlength=len(of_line))[owner] if len(owner) else owner
                case = of_line[owner] if len(owner) else owner
                order, digests = occurrences(digests, parts, case)
                offsets = np.searchsorted(case[order], np.arange(len(lines) + 1))
                sorted_lines = whole_lines[np.lexsort((whole_lines, of_line))]
                line_offsets = np.concatenate([[0], np.cumsum(counts)])
                classes = [int.from_bytes(_short(sorted_lines[a:b].tobytes()), "big", signed=True) for a, b in zip(line_offsets, line_offsets[1:])]
                questions = [int.from_bytes(_short(" ".join(w).encode()), "big", signed=True) for w in words]
                lists = lambda values, where, kind: pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(values, kind))
                columns = [*batch.columns[:4], pa.array(classes, pa.int64()), pa.array(questions, pa.int64()), pa.array(words, pa.list_(pa.string()))]
                columns += [lists(sorted_lines, line_offsets, pa.int64()), lists(digests, offsets, pa.int64()), lists(lengths[order], offsets, pa.int32())]
                out = pa.table(columns, schema=kinds)
                yield from out.filter(pa.array([bool(w) and c > 0 for w, c in zip(words, counts)])).to_batches()

    return rows.mapInArrow(run, CHUNKED)


def _short(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=8).digest()


def rare_first(posts: DataFrame, owner: str, key: str, size: str, weight, least: float, bar: float) -> DataFrame:
    """Of each owner's keys the rare ones, without which the rest weighs no more than ``least`` of its size; with ``df``, how many owners hold the
    key, and ``rest``, what it and the more common keys of the owner weigh.

    Keys that stand on one side only can't be shared and are dropped first. Those of at least ``bar`` owners are looked up by broadcast (their
    number is at most that of all posts over ``bar``), the others by a shuffle in which no key is hot. Keys are ordered from common to
    rare, ties by the key, alike for all owners; so two owners that share more than ``least`` of the size of the larger share a kept key.
    """
    known = posts.groupBy(key).agg(F.count(F.lit(1)).alias("df"), F.max("dev").alias("d"), F.max("eval").alias("e")).filter("d AND e").select(key, "df")
    known = keep(known)
    shared = posts.join(F.broadcast(known.filter(F.col("df") >= bar)), key).unionByName(posts.join(known.filter(F.col("df") < bar), key))
    down = Window.partitionBy(owner).orderBy(F.desc("df"), key)
    shared = shared.withColumn("rest", F.sum(weight).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return shared.filter(F.col("rest") > least * F.col(size) - 1e-3)


def evidence_pairs(rows: DataFrame, least: float = 0.5, salt: int = 4096) -> DataFrame:
    """(a, b) of evidence classes, one of a development and one of an evaluation case, that share more than ``least`` of their lines.

    Classes meet by the digests of their rare chunks (``rare_first``); so common chunks join only classes made of little else, and no
    link is lost. The two sides of a chunk held by more than ``salt`` classes are dealt to several tasks. Then the lengths of all
    chunks two classes share, in lines, are summed and give their overlap fraction, which is never below that of the lines; pairs above
    ``least`` are checked against the line sets. Equal classes were made one before.
    """
    classes = rows.groupBy("evidence").agg(F.first("lines").alias("lines"), F.first("digests").alias("digests"), F.max(F.col("side") == "dev").alias("dev"), F.max(F.col("side") == "eval").alias("eval"))
    classes = keep(classes)
    posts = classes.select("evidence", "dev", "eval", F.size("lines").alias("n"), F.explode("digests").alias("digest"))
    # chunks in a hundredth of all classes or more: at most 100 times the mean number of chunks of a class
    kept = keep(rare_first(posts, "evidence", "digest", "n", weight(F.col("digest")), least, classes.count() / 100))
    tasks = F.ceil(F.col("df") / salt).cast("int")
    left = kept.filter("dev").select("digest", F.pmod(F.xxhash64("evidence"), tasks).cast("int").alias("task"), F.col("evidence").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    right = kept.filter("eval").select("digest", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.col("evidence").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    # the rarest chunk two classes share has all others they share after it on both sides, so what is left there must be enough
    enough = F.least("ra", "rb") > least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-3
    pairs = left.join(right, ["digest", "task"]).filter(enough & (F.least("na", "nb") > least * F.greatest("na", "nb"))).select("a", "b").distinct()
    sets = classes.select("evidence", "lines", "digests")
    both = pairs.join(sets.toDF("a", "la", "da"), "a").join(sets.toDF("b", "lb", "db"), "b")
    size = F.size("la") + F.size("lb")
    shared = F.aggregate(F.array_intersect("da", "db"), F.lit(0.0), lambda total, x: total + weight(x))
    both = both.filter(shared > least * (size - shared) - 1e-3)
    same = F.size(F.array_intersect("la", "lb"))
    return both.filter(same > least * (size - same)).select("a", "b")


def links(cases: DataFrame, least_lines: float = 0.5, least_words: float = 0.75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, qa, b, qb): classes of development and of evaluation cases that are near-same; the members of all classes; and the chunked rows.

    Linked classes share more than ``least_lines`` of the distinct lines found in either and more than ``least_words`` of the
    distinct words found in either question. Question classes meet only under a pair of evidence classes, by their rare words. Cases
    of other or null splits, without lines or without words, are in no class.
    """
    rows = keep(chunked(cases))
    pairs = evidence_pairs(rows, least_lines)
    asked = keep(rows.groupBy("question").agg(F.first("words").alias("words"), F.max(F.col("side") == "dev").alias("dev"), F.max(F.col("side") == "eval").alias("eval")))
    posts = asked.select("question", "dev", "eval", F.size("words").alias("n"), F.explode("words").alias("word"))
    rare = rare_first(posts, "question", "word", "n", F.lit(1.0), least_words, asked.count() / 100).select("question", "word").join(asked.select("question", "words"), "question")
    by_class = rows.select("evidence", "side", "question").distinct().join(rare, "question")
    a = by_class.filter("side = 'dev'").select(F.col("evidence").alias("a"), F.col("question").alias("qa"), F.col("words").alias("wa"), "word")
    b = by_class.filter("side = 'eval'").select(F.col("evidence").alias("b"), F.col("question").alias("qb"), F.col("words").alias("wb"), "word")
    same = F.size(F.array_intersect("wa", "wb"))
    met = pairs.join(a, "a").join(b, ["b", "word"]).filter(same > least_words * (F.size("wa") + F.size("wb") - same))
    members = rows.select("case_id", "side", "evidence", "question").distinct()
    return keep(met.select("a", "qa", "b", "qb").distinct()), members, rows


def _expanded(met: DataFrame, members: DataFrame) -> DataFrame:
    dev = members.filter("side = 'dev'").select(F.col("case_id").alias("dev_id"), F.col("evidence").alias("a"), F.col("question").alias("qa"))
    held = members.filter("side = 'eval'").select(F.col("case_id").alias("eval_id"), F.col("evidence").alias("b"), F.col("question").alias("qb"))
    return met.join(dev, ["a", "qa"]).join(held, ["b", "qb"]).filter("dev_id <> eval_id").select("dev_id", "eval_id", "a", "b")


def found(cases: DataFrame) -> DataFrame:
    """(case_id_a, case_id_b), the lesser id first; a case that came with both kinds of split pairs with no other row of itself. Repeated rows give one pair."""
    met, members, _ = links(cases)
    return _expanded(met, members).select(F.least("dev_id", "eval_id").alias("case_id_a"), F.greatest("dev_id", "eval_id").alias("case_id_b")).distinct()


def classes(cases: DataFrame) -> DataFrame:
    """(case_id, side, class_id, n_links): each case that can match, with the least case_id of those of its side with the same lines and
    words, and the number of classes of the other side it is near-same to. Pairs of members are never made."""
    met, members, _ = links(cases)
    named = members.groupBy("side", "evidence", "question").agg(F.min("case_id").alias("class_id"))
    dev = met.groupBy(F.col("a").alias("evidence"), F.col("qa").alias("question")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("dev"))
    held = met.groupBy(F.col("b").alias("evidence"), F.col("qb").alias("question")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("eval"))
    by = ["side", "evidence", "question"]
    named = named.join(dev.unionByName(held), by, "left").select(*by, "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))
    return members.join(named, by).select("case_id", "side", "class_id", "n_links")


def fractions(cases: DataFrame) -> DataFrame:
    """(dev_id, eval_id, shared_bytes, dev_fraction, eval_fraction): lengths of shared chunks against those of each case, once for each pair of classes."""
    met, members, rows = links(cases)
    chunks = rows.groupBy("evidence").agg(F.first("digests").alias("digests"), F.first("lengths").alias("lengths"))
    parts = chunks.select("evidence", F.explode(F.arrays_zip("digests", "lengths")).alias("c")).select("evidence", F.col("c.digests").alias("digest"), F.col("c.lengths").alias("length"))
    total = parts.groupBy("evidence").agg(F.sum("length").alias("bytes"))
    mine, theirs = parts.toDF("a", "digest", "length"), parts.select(F.col("evidence").alias("b"), "digest")
    shared = met.select("a", "b").distinct().join(mine, "a").join(theirs, ["b", "digest"]).groupBy("a", "b").agg(F.sum("length").alias("shared_bytes"))
    out = _expanded(met, members).join(shared, ["a", "b"]).join(total.toDF("a", "bytes_a"), "a").join(total.toDF("b", "bytes_b"), "b")
    return out.select("dev_id", "eval_id", "shared_bytes", (F.col("shared_bytes") / F.col("bytes_a")).alias("dev_fraction"), (F.col("shared_bytes") / F.col("bytes_b")).alias("eval_fraction")).distinct()


def report(cases: DataFrame) -> DataFrame:
    """(split, source, n_cases, n_overlapping): per evaluation split and source group, the cases with a development twin.

    A class is marked by the classes it is linked to, each reduced to its least and greatest case; no pair of cases is made.
    """
    met, members, rows = links(cases)
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    dev = members.filter("side = 'dev'").groupBy(F.col("evidence").alias("a"), F.col("question").alias("qa")).agg(F.min("case_id").alias("lo"), F.max("case_id").alias("hi"))
    hit = met.join(dev, ["a", "qa"]).groupBy(F.col("b").alias("evidence"), F.col("qb").alias("question")).agg(*ends)
    own = rows.filter("side = 'eval'").select("case_id", "split", "source", "evidence", "question").distinct()
    twin = F.when((F.col("lo") != F.col("case_id")) | (F.col("hi") != F.col("case_id")), F.col("case_id"))
    return own.join(hit, ["evidence", "question"], "left").groupBy("split", "source").agg(F.countDistinct("case_id").alias("n_cases"), F.countDistinct(twin).alias("n_overlapping"))

"""Problem 3: cutting oversized items at natural boundaries by packing their structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .languages import language_of

_BLANK = b" \t\r\n\f\v"
_JOINTS = frozenset(b" \t\r\n\f\v,;)]}")


def _line_starts(body: bytes) -> list[int]:
    starts, at = [0], body.find(b"\n")
    while at >= 0 and at + 1 < len(body):
        starts.append(at + 1)
        at = body.find(b"\n", at + 1)
    return starts


def _char_floor(body: bytes, at: int, least: int) -> int:
    """The greatest character boundary not after ``at``; the next one where that would not pass ``least``."""
    low = at
    while low > least and low < len(body) and body[low] & 0xC0 == 0x80:
        low -= 1
    if low > least:
        return low
    at = least + 1
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return at


def _crumble(body: bytes, start: int, end: int, limit: int) -> Iterator[tuple[int, int]]:
    """A line above the limit, cut after white space or a closing sign in the last half of the room, else between characters."""
    while end - start > limit:
        at = start + limit
        cut = next((i for i in range(at, start + limit // 2, -1) if body[i - 1] in _JOINTS and body[i] & 0xC0 != 0x80), 0)
        cut = cut or _char_floor(body, at, start)
        yield start, cut
        start = cut
    if start < end:
        yield start, end


def _nesting(lines: list[bytes], pattern: re.Pattern, closers: re.Pattern) -> list[int]:
    """The number of opened and not yet closed signs ahead of each line, less those it begins by closing; all 0 where they don't match up."""
    out, depth = [], 0
    for line in lines:
        line = _QUOTED.sub(b"", line)
        head = closers.match(line)
        out.append(depth - (head[0].count(head[1]) if head and head[1] else 0))
        for m in pattern.finditer(line):
            depth += -1 if m[1] else 1
        if depth < 0 or out[-1] < 0:
            return [0] * len(lines)
    return out if depth == 0 else [0] * len(lines)


_QUOTED = re.compile(rb"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|(?://|(?<![$\\])#).*")
_BRACKET, _CLOSING = re.compile(rb"([)\]}])|[(\[{]"), re.compile(rb"\s*(?:([)\]}])[)\]}\s]*)?")
_TAG, _END_TAG = re.compile(rb"(</[A-Za-z][^>]*>)|<(?!(?:br|hr|img|input|link|meta)\b)[A-Za-z](?:[^<>/]|/(?!>))*>"), re.compile(rb"\s*(</)?")
_HEADING, _ITEM = re.compile(rb"(#{1,6})\s"), re.compile(rb"(?:[-*+]|\d{1,9}[.)])\s")
_LEAD = re.compile(rb"@|#\[|//|#|/?\*|--|\"\"\"|=head")


def _depths(body: bytes, starts: list[int], markup: bool) -> list[int | None]:
    """How deep each line lies: by indentation and open brackets, or in markup by headings, lists, tags and paragraphs; null for blank lines."""
    lines = [body[a:b] for a, b in zip(starts, [*starts[1:], len(body)])]
    open_ = _nesting(lines, *((_TAG, _END_TAG) if markup else (_BRACKET, _CLOSING)))
    out: list[int | None] = []
    running = False
    for line, nested in zip(lines, open_):
        text = line.strip(_BLANK)
        if not text:
            out.append(None)
            running = False
            continue
        depth = len(line[: len(line) - len(line.lstrip(b" \t"))].expandtabs(4)) + 4 * nested
        if markup and (m := _HEADING.match(text)):
            out.append(len(m[1]) - 7)
            running = False
            continue
        item = markup and _ITEM.match(text)
        out.append(depth + (1 if markup and running and not item else 0))
        running = True
    return out


def _tree(body: bytes, starts: list[int], markup: bool = False) -> list:
    """Nested lists of line numbers: a line owns the deeper lines after it, and a comment, decorator or attribute the line that follows it.

    Blank lines and lines that only close stay with what is before them.
    """
    root: list = []
    stack: list[tuple[int, list, bool]] = [(-9, root, False)]
    fresh = True
    for i, depth in enumerate(_depths(body, starts, markup)):
        if depth is None:
            stack[-1][1].append(i)
            fresh = True
            continue
        text = body[starts[i] : starts[i] + 200].lstrip(b" \t")
        closes = text[:1] in (b")", b"]", b"}") or markup and text.startswith(b"</")
        lead = not markup and bool(_LEAD.match(text))
        while stack[-1][0] > depth:
            stack.pop()
        if stack[-1][0] == depth:
            if closes:
                stack[-1][1].append(i)
                fresh = False
                continue
            if not (stack[-1][2] and not fresh):
                while stack[-1][0] >= depth:
                    stack.pop()
        node = [i]
        stack[-1][1].append(node)
        stack.append((depth, node, lead))
        fresh = False
    return root


def _ends(root: list) -> dict[int, tuple[int, int]]:
    """(first line, last line) of each node by its identity, bottom-up and without recursion."""
    out: dict[int, tuple[int, int]] = {}
    work = [(root, False)]
    while work:
        node, done = work.pop()
        if done:
            edge = [x if isinstance(x, int) else out[id(x)] for x in (node[0], node[-1])]
            out[id(node)] = (edge[0] if isinstance(edge[0], int) else edge[0][0], edge[1] if isinstance(edge[1], int) else edge[1][1])
        else:
            work.append((node, True))
            work.extend((x, False) for x in node if isinstance(x, list))
    return out


def _pack(root: list, start_of: list[int], limit: int, body: bytes) -> list[tuple[int, int]]:
    """Segments within the limit, from the subtrees' sizes: siblings are merged while they fit, only an oversized node is entered, lines are crumbled.

    Nothing is merged across the edge of an oversized node but its head with what follows it inside, and lines that close it with its last segment.
    """
    if not root:
        return []
    ends = _ends(root)
    out: list[tuple[int, int]] = []
    work, first = [iter(root)], False
    begin = end = 0
    head = tail = False  # whether the open segment is nothing but heads of entered nodes; whether it ends an entered node
    while work:
        node = next(work[-1], None)
        if node is None:
            work.pop()
            first, head, tail = False, False, True
            continue
        line = isinstance(node, int)
        a, z = (node, node) if line else ends[id(node)]
        s, e = start_of[a], start_of[z + 1]
        if e - s <= limit:
            closes = line and body[s:e].lstrip(b" \t")[:1] in (b")", b"]", b"}", b"", b"\n", b"\r")
            if end > begin and e - begin <= limit and (not tail or closes):
                end, head = e, head and first
            else:
                if end > begin:
                    out.append((begin, end))
                begin, end, head, tail = s, e, first, False
            first = False
        elif not line:
            if end > begin and not head:
                out.append((begin, end))
                begin = end = s
            elif end <= begin:
                begin = end = s
            tail = False
            work.append(iter(node))
            first = True
        else:
            if end > begin:
                out.append((begin, end))
            *full, (begin, end) = _crumble(body, s, e, limit)
            out.extend(full)
            first = head = tail = False
    if end > begin:
        out.append((begin, end))
    return out


def pieces(body: bytes, limit: int, overlap: int, markup: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of consecutive pieces of ``body``, each of at most ``limit`` bytes.

    Segments take at most ``limit - overlap`` bytes; each piece but the first begins before its segment at the line
    start nearest to ``overlap`` bytes back, else at the nearest joint, else between characters, and never before the
    piece ahead. An overlap above half the limit counts as half, or no piece would get on; a limit under 8 as 8, so that any character fits.
    ``markup`` reads headings, lists, tags and paragraphs instead of the brackets of code.
    """
    limit = max(8, limit)
    overlap = min(max(0, overlap), limit // 2)
    starts = _line_starts(body)
    room = limit - overlap
    segments = _pack(_tree(body, starts, markup), [*starts, len(body)], room, body)
    lines = set(starts)
    out: list[tuple[int, int, int]] = []
    for s, e in segments:
        start = s
        if out and overlap:
            least = max(out[-1][0] + 1, e - limit)
            near = max(overlap // 2, 1)
            marks = [i for i in range(max(least, s - overlap - near), s - overlap + near + 1) if i < s]
            full = [i for i in marks if i in lines] or [i for i in marks if body[i - 1] in _JOINTS and body[i] & 0xC0 != 0x80] or [i for i in marks if body[i] & 0xC0 != 0x80]
            start = min(full, key=lambda i: abs(s - overlap - i), default=s)
        out.append((start, e, s - start))
    return out


def valid_units(units: DataFrame) -> DataFrame:
    """The row of each unit with the greatest scanned_at (a null one counts least; ties go to the later arrival, then to the greater span)."""
    newest = F.max_by(F.struct("path", "start_byte", "end_byte"), F.struct("scanned_at", "ingested_at", "start_byte", "end_byte"))
    return units.filter("unit_id IS NOT NULL").groupBy("unit_id").agg(newest.alias("u")).select("unit_id", "u.*")


def cut_units(units: DataFrame, files: DataFrame, limits: DataFrame, texts: bool) -> DataFrame:
    """The pieces of ``split_units`` from each arrival of a file, with the arrival; ``text`` is null unless asked for."""
    sizes = limits.filter("max_bytes IS NOT NULL").groupBy("language").agg(F.max(F.struct("max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("overlap_bytes"))).alias("l")).select("language", "l.*")
    large = valid_units(units).filter("start_byte >= 0 AND end_byte > start_byte").withColumn("language", language_of(F.col("path")))
    large = large.join(F.broadcast(sizes), "language").filter("end_byte - start_byte > max_bytes")  # one row a language
    spans = large.groupBy("path").agg(F.collect_list(F.struct("unit_id", "start_byte", "end_byte", "max_bytes", "overlap_bytes")).alias("spans"))
    bodies = files.filter("content IS NOT NULL AND path IS NOT NULL").select("path", "content", F.struct(F.unix_micros("ingested_at").alias("at"), "file_id").alias("arrival"))
    both = spans.join(bodies, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                body = row["content"].encode("utf-8")
                for u in row["spans"]:
                    if u["end_byte"] > len(body):
                        continue
                    part = body[u["start_byte"] : u["end_byte"]]
                    for k, (s, e, o) in enumerate(pieces(part, u["max_bytes"], u["overlap_bytes"])):
                        rows.append({"unit_id": u["unit_id"], "path": row["path"], "arrival": row["arrival"], "piece_no": k, "start_byte": u["start_byte"] + s, "end_byte": u["start_byte"] + e, "overlap_bytes": o, "text": part[s:e].decode("utf-8", "replace") if texts else None})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema_arrow)

    ddl = "unit_id STRING, path STRING, arrival STRUCT<at: BIGINT, file_id: BIGINT>, piece_no INT, start_byte BIGINT, end_byte BIGINT, overlap_bytes BIGINT, text STRING"
    schema_arrow = to_arrow_schema(_parse_datatype_string(ddl))
    return both.mapInArrow(run, ddl)


def split_units(units: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """(unit_id, path, piece_no, start_byte, end_byte, overlap_bytes, text) for the units longer than their limit.

    Units without a language, limit, file, readable content or possible span (0 <= start < end <= bytes) have no
    pieces. Repeated files count once. Where a span begins or ends inside a character, so do the first and last piece;
    such bytes are replaced in ``text`` only. Spans are gathered per path, so each content moves once.
    """
    # a repeated file gives the same pieces again; the first arrival counts
    first = F.min_by(F.struct("path", "start_byte", "end_byte", "overlap_bytes", "text"), "arrival")
    return cut_units(units, files, limits, True).groupBy("unit_id", "piece_no").agg(first.alias("p")).select("unit_id", "piece_no", "p.*")


def oversized(units: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """(unit_id) of the units that ``split_units`` cuts, by the same pieces without their texts."""
    return cut_units(units, files, limits, False).filter("piece_no = 0").select("unit_id").distinct()


def pieces_check(units: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """Per unit: whether its pieces are in the limit, follow each other from its start to its end, and repeat what they say; one row a unit.

    A unit's pieces are a few, and no more than its bytes; only their numbers are gathered.
    """
    sizes = limits.filter("max_bytes IS NOT NULL").groupBy("language").agg(F.max("max_bytes").alias("max_bytes"))
    cut = split_units(units, files, limits).withColumn("language", language_of(F.col("path"))).join(F.broadcast(sizes), "language")  # one row a language
    fits = (F.col("end_byte") - F.col("start_byte")).between(1, F.greatest("max_bytes", F.lit(8)))
    run = F.array_sort(F.collect_list(F.struct("piece_no", "start_byte", "end_byte", "overlap_bytes")))
    ahead = lambda x, i: (i == 0) | ((x.start_byte + x.overlap_bytes == F.get("run", i - 1).end_byte) & (x.start_byte > F.get("run", i - 1).start_byte))
    got = cut.groupBy("unit_id").agg(F.min(fits).alias("within"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), run.alias("run"))
    return got.select("unit_id", "start_byte", "end_byte", "within", F.forall(F.transform("run", ahead), lambda ok: ok).alias("joined"))

"""Problem 2: files nobody wrote by hand, from Re-Pair grammars, incompressible literals and rules shared across repositories."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import keep

from .languages import language_of

_LETTER, _DIGIT, _BLANK = ord("a"), ord("0"), ord(" ")
_CLASSES = bytes(_LETTER if chr(c).isalpha() and c < 128 or c == 95 or c >= 128 else _DIGIT if 48 <= c <= 57 else _BLANK if c in b"\t\r\f\v" else c for c in range(256))
STRING = re.compile(rb'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`', re.S)
RAW_STRING = re.compile(rb'r#+"(?:[^"]|"(?!#))*"#+|' + STRING.pattern, re.S)
WORD = re.compile(rb"[A-Za-z_$][\w$]*")
COMMENT = re.compile(rb"(?m)^[ \t]*(?:#|//)[^\n]*$|/\*[\s\S]*?\*/")
NUMBERED = re.compile(rb"[A-Za-z_](\d{1,9})(?!\w)")
FLOW = re.compile(rb"\b(?:if|elif|elsif|else|unless|for|foreach|while|loop|until|return|def|function|fn(?=[^;{]*\{)|sub|try|except|catch|match|switch|throw|raise|die|await|yield|lambda|impl|with)\b|=>[ ]*\{")
# Folders and notices of third-party code, and banners of generators, as a line of a comment begins with them.
VENDOR_PATH = re.compile(r"/(?:vendor|vendored|third[_-]party|node_modules|bower_components|site-packages|extern|external|deps)/[^/]+/")
VENDOR_NOTICE = re.compile(
    rb"(?i)(?:copyright \(c\) (?:\d{4},? )?the \S+ (?:authors|contributors|developers)|\S+ v?\d+\.\d+(?:\.\d+)?\S* (?:- upstream copy|\| ?\(c\))|@license\b)"
)
BANNER = re.compile(
    rb"(?i)(?:@generated\b|<auto-?generated>|code generated by|auto-?generated (?:file|by|from)|automatically generated|generated (?:by|from|with) \S+|machine (?:written|generated)\b|output of \S+ on input"
    rb"|this file (?:is|was) (?:auto-?generated|(?:generated|produced|written) automatically|generated|machine)|do not (?:edit|modify)(?: this file)?(?: by hand)?:? ?(?:-|regenerate|this file|$))"
)
# Banners that speak of the whole file wherever they stand, and words without which a text holds no notice or banner.
OF_FILE = re.compile(rb"(?i)(?:@generated\b|<auto-?generated>|code generated by|auto-?generated file|this file (?:is|was) )|.*\bdo not (?:edit|modify)\b")
HINTS = (b"generated", b"do not edit", b"do not modify", b"machine written", b" automatically", b"output of", b"copyright (c)", b"upstream copy", b"(c)", b"@license")
OPEN = re.compile(rb"""(?m)^[ \t]*(?:#|//)[^\n]*|(/\*)|^(\"\"\"|\'\'\'|=[a-z]\w*)|(\"\"\"|\'\'\'|`)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|<<~?["']?([A-Z_]\w*)""")


def comment_lines(body: bytes) -> Iterator[tuple[bytes, bool, bool]]:
    """(line, opens, ahead) of the lines of all comments without their signs: whether it opens a block or a paragraph, and stands before any code.

    Strings are passed over, so text of templates is none; docstrings at the margin and POD are comments.
    """
    ends: dict[bytes, int] = {}
    at, ahead, fresh = 0, True, True

    def find(close: bytes, start: int) -> int:
        if close not in ends or 0 <= ends[close] < start:
            ends[close] = body.find(close, start)
        return ends[close]

    while m := OPEN.search(body, at):
        between = body[at : m.start()]
        if between.strip():
            ahead, fresh = False, True
        elif between.count(b"\n") > 1:
            fresh = True
        opener = m[1] or m[2] or m[3] or m[4]
        end, closed = m.end(), m.end()
        if opener:
            close = b"*/" if m[1] else b"\n=cut" if opener[:1] == b"=" else b"\n" + opener if m[4] else opener
            k = find(close, m.end())
            if k < 0:
                at = m.end()
                continue
            end, closed = k, k + len(close)
        at = closed
        if m[3] or m[4] or (not opener and m[0][:1] in b"\"'"):
            ahead, fresh = False, True
            continue
        if opener:
            fresh = True
        for line in body[m.end() if opener else m.start() : end].split(b"\n"):
            text = line.strip(b" \t\r\f\v/#*!;")
            if not text or line.startswith(b"#!") or b"coding:" in line[:40]:
                fresh = True
                continue
            yield text, fresh, ahead
            fresh = False
        if opener:
            fresh = True


def banners(body: bytes) -> tuple[int, bool]:
    """How far comments call a text generated, and whether they name a third party.

    2: a banner opens a block before all code, or opens one anywhere and speaks of the file; it decides alone. 1: another banner.
    """
    low = body.lower()
    if not any(x in low for x in HINTS):
        return 0, False
    rank, notice = 0, False
    for line, opens, ahead in comment_lines(body):
        if rank < 2 and BANNER.match(line):
            rank = 2 if opens and (ahead or OF_FILE.match(line)) else 1
        notice = notice or bool(VENDOR_NOTICE.match(line))
    return rank, notice


def _strings(body: bytes) -> re.Pattern:
    """The pattern of literals, with raw ones where the text closes any."""
    return RAW_STRING if b'"#' in body else STRING


def shapes(body: bytes) -> list[bytes]:
    """A token per statement: its text with names, numbers and literals reduced to their class and lists of literals to one sign."""
    x = _strings(body).sub(b'"', body).translate(_CLASSES)
    x = re.sub(rb"a[a0]*", b"a", x)
    x = re.sub(rb"-?0[0a.]*", b"0", x)
    x = x.replace(b" ", b"")
    x = re.sub(rb'(?:[a0"],){4,}', b"L", x)
    return [s for s in re.split(rb"[\n;]|(?<=[{}])", x) if s]


def repair(tokens: list) -> int:
    """Size of the Re-Pair grammar of a sequence: what is left of it and two symbols for each rule.

    The most frequent adjacent pair is replaced by a new symbol until none occurs twice; pairs wait in a heap by count,
    positions in lists, the sequence is doubly linked; entries that no longer hold are skipped. Ties go to the smaller pair.
    """
    ids: dict = {}
    s = [ids.setdefault(t, len(ids)) for t in tokens]
    n = len(s)
    counts = Counter(zip(s, s[1:]))
    if not counts or max(counts.values()) < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict = defaultdict(list)
    for i, p in enumerate(zip(s, s[1:])):
        if counts[p] > 1:
            places[p].append(i)
    heap = [(-len(at), p) for p, at in places.items()]
    heapq.heapify(heap)
    left, rules, fresh = n, 0, len(ids)
    while heap:
        count, pair = heapq.heappop(heap)
        a, b = pair
        valid, used = [], -1
        for i in places.pop(pair, ()):
            j = after[i]
            if s[i] == a and j < n and s[j] == b and i != used:
                valid.append(i)
                used = j
        if len(valid) < 2:
            continue
        if len(valid) < -count:  # it has become rarer: wait for its turn
            places[pair] = valid
            heapq.heappush(heap, (-len(valid), pair))
            continue
        rules += 1
        touched: dict = defaultdict(list)
        for i in valid:
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = fresh, -1
            follow = after[i] = after[j]
            if follow < n:
                before[follow] = i
            left -= 1
            if (lead := before[i]) >= 0:
                touched[(s[lead], fresh)].append(lead)
        for i in valid:
            if s[i] == fresh and after[i] < n:
                touched[(fresh, s[after[i]])].append(i)
        for p, at in touched.items():
            if len(at) > 1:
                places[p] = sorted(set(at))
                heapq.heappush(heap, (-len(places[p]), p))
        fresh += 1
    return left + 2 * rules


def reuse(tokens: list) -> float:
    """Size of one grammar over the whole sequence against its length; 1 where nothing recurs."""
    if len(tokens) < 8:
        return 1.0
    return repair(tokens) / len(tokens)


def incompressible(literal: bytes) -> bool:
    """Whether a literal is a blob: long, with hardly a blank, and deflated to near its information bound."""
    return len(literal) >= 400 and literal.count(b" ") * 50 < len(literal) and len(zlib.compress(literal, 1)) > 0.55 * len(literal)


def numbered(code: bytes, steps: int = 3) -> bool:
    """Whether names count up: the numbers at the ends of names go on by one, from 0 or 1 on, for some steps."""
    want = 0
    for m in NUMBERED.finditer(code):
        n = int(m[1])
        if n == want or n == 1 and not want:
            want = n + 1
            if want >= steps:
                return True
    return False


def verdict(text: str | None, banner: int | None = None) -> str | None:
    """generated, minified, blob, data or null by the text alone; null and blank texts are none of them."""
    if not text or not text.strip():
        return None
    body = text.encode("utf-8", "replace")
    code = COMMENT.sub(b"", body)
    strings = _strings(code)
    literals = strings.findall(code)
    in_literals = sum(map(len, literals))
    bare = strings.sub(b'"', code)
    solid = len(code) - code.count(b" ") - code.count(b"\n") - code.count(b"\t") - code.count(b"\r")
    banner = banners(body)[0] if banner is None else banner
    if solid < 60:
        return "generated" if solid and banner == 2 else None
    words = WORD.findall(bare)
    statements = shapes(code)
    flow = len(FLOW.findall(bare))
    blob = sum(len(x) for x in literals if incompressible(x))
    if blob > 0.8 * len(code) and flow <= 1 and len(statements) <= 10:
        return "blob"
    if not flow or flow < 0.02 * len(statements):
        numbers = len(re.findall(rb"(?<![\w.])-?\d[\w.]*", bare))
        values = numbers + len(literals)
        if in_literals > 0.85 * len(code) and in_literals >= 400:
            return "data"
        if values >= 40 and values >= 3 * len([w for w in words if w not in (b"true", b"false", b"null", b"None", b"True", b"False")]):
            return "data"
    lines = [len(x) for x in code.split(b"\n") if x.strip()]
    if len(words) >= 40 and in_literals < 0.5 * len(code) and (max(lines) > 200 or sum(lines) > 60 * len(lines)):
        names = sum(map(len, words)) / len(words)
        if names < 4 and len(code) - solid < 0.1 * len(code):
            return "minified"
    if banner == 2:
        return "generated"
    ratio = reuse(statements)
    if len(statements) >= 8 and flow <= 0.05 * len(statements) and ratio < 0.78 and (len(statements) >= 48 or numbered(code)):
        return "generated"
    if banner and ratio < 0.9 and flow <= 0.25 * len(statements):
        return "generated"
    return None


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digests of the symbols that pairs of symbols become."""
    h = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def corpus_rules(body: bytes, rounds: int = 5, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(digests, lines) of the rules of the corpus grammar in a text: what each stands for, and the number of its lines.

    Pairs of adjacent symbols are replaced as in Re-Pair, over lines without white space; but which pairs isn't told by their
    count, known only over the whole corpus, but by a bit of each symbol's digest, so all texts take part in one grammar without
    meeting: equal runs of lines become equal rules wherever they stand, up to the few at their edges. Rounds go on as
    long as a rule has about four lines; those of fewer than ``least`` are no evidence. A text without any rule is one. Lines of up to three
    characters, which close blocks, don't count.
    """
    lines = [x for x in body.translate(None, b" \t\r\f\v").split(b"\n") if len(x) > 3]
    if not lines:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    s = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    size = np.ones(len(s), np.int32)
    whole = np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64)
    for k in range(rounds):
        left = (s >> np.uint64(7 * k)) & np.uint64(1) == 0
        first = np.flatnonzero(left[:-1] & ~left[1:])
        s[first], size[first] = _join(s[first], s[first + 1]), size[first] + size[first + 1]
        stay = np.ones(len(s), bool)
        stay[first + 1] = False
        s, size = s[stay], size[stay]
    rule = size >= least
    if not rule.any():
        return whole.view(np.int64), np.array([len(lines)], np.int32)
    return s[rule].view(np.int64), size[rule]


def examined(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, verdict, notice, rules, sizes) of every row with a suffix of the five languages and readable content."""
    repo = F.coalesce("repo", F.substring_index("path", "/", 2))
    rows = files.filter(language_of(F.col("path")).isNotNull() & F.col("content").isNotNull()).select("file_id", repo.alias("repo"), "path", "content")
    fields = pa.schema([("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("verdict", pa.string()), ("notice", pa.bool_()), ("rules", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, repos, paths, contents = batch.columns
            kinds, notices, rules, sizes = [], [], [], []
            for path, content in zip(paths, contents):
                text = content.as_py()
                body = text.encode("utf-8", "replace")
                banner, notice = banners(body)
                kinds.append(verdict(text, banner))
                notices.append(bool(text.strip()) and bool(notice or VENDOR_PATH.search(path.as_py())))
                digests, lines = corpus_rules(body)
                rules.append(digests)
                sizes.append(lines)
            columns = [ids, repos, paths, pa.array(kinds, pa.string()), pa.array(notices, pa.bool_()), pa.array(rules, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return rows.mapInArrow(run, "file_id BIGINT, repo STRING, path STRING, verdict STRING, notice BOOLEAN, rules ARRAY<BIGINT>, sizes ARRAY<INT>")


def not_handwritten(files: DataFrame, share: float = 0.5) -> DataFrame:
    """(file_id, path, reason) of the files of the five languages that nobody wrote by hand in their repo; one row a file.

    The reason is the text's verdict, else ``vendored``: rules of the corpus grammar that occur in another repo too stand for more
    than ``share`` of the lines in rules, or the file stands in a third-party folder or bears a third-party notice. Null,
    empty and comment-only files are not named; repeats count once, and copies within one repo are no sign. Which of two
    repositories had the text first isn't known, so both have it from a third.

    Rules are joined by digest. A digest's repos are reduced to the least and the greatest before the shuffle; shared digests of a
    ten-thousandth of all rows or more, of which there are ten thousand at most, are broadcast, so no key of the join is hot.
    """
    rows = keep(examined(files))
    posts = rows.select("file_id", "repo", F.explode(F.arrays_zip("rules", "sizes")).alias("x")).select("file_id", "repo", F.col("x.rules").alias("digest"), F.col("x.sizes").alias("lines"))
    shared = keep(posts.groupBy("digest").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count(F.lit(1)).alias("df")).filter("a <> b").select("digest", "df"))
    bar = (rows.agg(F.sum(F.size("rules"))).first()[0] or 0) / 10_000
    both = posts.select("file_id", "digest", "lines")
    met = both.join(F.broadcast(shared.filter(F.col("df") >= bar)), "digest").unionByName(both.join(shared.filter(F.col("df") < bar), "digest"))
    hits = met.groupBy("file_id", "digest").agg(F.max("lines").alias("lines")).groupBy("file_id").agg(F.sum("lines").alias("hits"))
    known = F.map_from_entries(F.array_distinct(F.arrays_zip("rules", "sizes")))
    total = F.aggregate(F.map_values(known), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    one = rows.groupBy("file_id").agg(F.max(F.struct("path", "verdict", "notice", total.alias("n"))).alias("r")).select("file_id", "r.*")
    judged = one.join(hits, "file_id", "left")
    reason = F.coalesce("verdict", F.when(F.col("notice") | (F.col("hits") > share * F.col("n")), F.lit("vendored")))
    return judged.select("file_id", "path", reason.alias("reason")).filter("reason IS NOT NULL")


def handwritten_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, path) of the units in files that were written by hand; units of unknown files stay."""
    named = not_handwritten(files).select("path").distinct()
    return units.filter("unit_id IS NOT NULL").select("unit_id", "path").distinct().join(named, "path", "left_anti")

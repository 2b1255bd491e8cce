"""Declarations, calls, imports and faults of source files as rows: Python by the standard library's own parser, four other languages by brackets and words."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.discovery import LANGUAGES
from millrace.operators.discovery import language as language_of

ROWS = (
    "record STRING, path STRING, language STRING, unit_id STRING, kind STRING, name STRING, qualified_name STRING, parent_id STRING, signature STRING, start_byte BIGINT, end_byte BIGINT, body_start_byte BIGINT, body_end_byte BIGINT, "
    "start_line INT, end_line INT, branch_nodes INT, member_count INT, has_implementation BOOLEAN, facts ARRAY<STRING>"
)
_TYPES = {"STRING": pa.string(), "BIGINT": pa.int64(), "INT": pa.int32(), "BOOLEAN": pa.bool_(), "ARRAY<STRING>": pa.list_(pa.string())}
FIELDS = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ROWS.split(", ")])

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)
_EFFECTS = (ast.Assign, ast.AugAssign)
CALLABLE, OWNERS = ("function", "method"), ("class", "impl", "trait", "interface", "package")

# What stands in literals and comments is blanked out before brackets and words are read.
_QUOTES = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_MASKED = {
    "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|" + _QUOTES + r"|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:\[!&|?{};])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"),
    "rust": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|b?r(#*)\"[\s\S]*?\"\1|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x..|u\{[^}]*\}|.))'"),
    "perl": re.compile(r"(?ms)^=[a-z].*?(?:^=cut\b[^\n]*|\Z)|(?<![$\\\w{])#[^\n]*|" + _QUOTES + r"|\b(?:qr|qw|qq|q|m)\s*(?:\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\]|/(?:[^/\\\n]|\\.)*/)\w*|(?<==~)\s*s?/(?:[^/\\\n]|\\.)*/(?:(?:[^/\\\n]|\\.)*/)?\w*"),
}
_MASKED["typescript"] = _MASKED["javascript"]
_DECLARED = {
    "javascript": [
        ("class", re.compile(r"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\babstract\s+)?\bclass\s+([\w$]+)")),
        ("function", re.compile(r"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]+)")),
        ("function", re.compile(r"(?:\bexport\s+)?\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;\n]*)?=\s*(?:async\s*)?(?=\()")),
    ],
    "rust": [
        ("function", re.compile(r"(?:\bpub(?:\([^)\n]*\))?\s+)?(?:\b(?:const|async|unsafe)\s+|\bextern\s+)*\bfn\s+(\w+)")), ("impl", re.compile(r"(?:\bunsafe\s+)?(?<![\w>] )(?<!->)\bimpl\b(?:\s*<[^{;]*?>)?\s+([^{;]+?)\s*(?=\{|\bwhere\b)")),
        ("struct", re.compile(r"(?:\bpub(?:\([^)\n]*\))?\s+)?\bstruct\s+(\w+)")), ("enum", re.compile(r"(?:\bpub(?:\([^)\n]*\))?\s+)?\benum\s+(\w+)")), ("trait", re.compile(r"(?:\bpub(?:\([^)\n]*\))?\s+)?\btrait\s+(\w+)")),
    ],
    "perl": [("package", re.compile(r"\bpackage\s+([\w:]+)")), ("function", re.compile(r"(?<![$@%&>\w])sub\s+([\w:]+)"))],
}
_DECLARED["typescript"] = [*_DECLARED["javascript"], ("interface", re.compile(r"(?:\bexport\s+)?\binterface\s+([\w$]+)")), ("enum", re.compile(r"(?:\bexport\s+)?(?:\bconst\s+)?\benum\s+([\w$]+)"))]
_MEMBER = re.compile(r"(?:\b(?:public|private|protected|static|async|readonly|get|set|override|abstract)\s+)*[*#]?[ \t]*([A-Za-z_$][\w$]*)\s*(?:<[^<>()\n]*>)?(?=\()")
_IMPORT = {
    "python": re.compile(r"(?m)^[ \t]*(?:import|from)[ \t]+[^\n]+"), "javascript": re.compile(r"(?m)^[ \t]*(?:import\b[^;\n]*|export\b[^;\n]*\bfrom\b[^;\n]*)"), "rust": re.compile(r"(?m)^[ \t]*(?:pub\s+)?use\s+[^;]+;"), "perl": re.compile(r"(?m)^[ \t]*(?:use|require)\s+[^;\n]+;"),
}
_IMPORT["typescript"] = _IMPORT["javascript"]
_OPENING = re.compile(r"[({\[]")
_CALLS = re.compile(r"([A-Za-z_$][\w$]*)\s*!?\(")
_WORDS = frozenset("if for while switch catch return function match fn sub elsif unless until foreach and or not my our qw print await typeof new in of super this constructor with assert del raise yield lambda except elif else".split())
_BRANCH = re.compile(r"\b(?:if|elsif|unless|else if|for|foreach|while|until|case|catch|match)\b|\?(?![.?:])")
_FALLBACK = {"javascript": r"\bcatch\b|\?\?|\|\|", "rust": r"\bunwrap_or\w*|\bor_else\b|\bunwrap_or_default\b", "perl": r"\bor\b|//|\|\|"}
_VALIDATES = {"javascript": r"\bthrow\b|===?\s*(?:null|undefined)", "rust": r"\b(?:return\s+)?Err\(|\bpanic!|\bis_none\(|\bis_empty\(", "perl": r"\bdie\b|\bcroak\b|\bdefined\b"}
_CHANGES = {"javascript": r"\bthis\.[\w$.]+\s*(?:[-+*/]?=)(?![=>])", "rust": r"\bself\.[\w.]+\s*(?:[-+*/]?=)(?!=)", "perl": r"->\{\w+\}\s*(?:[-+*/.]?=)(?![=~])"}
for _t in (_FALLBACK, _VALIDATES, _CHANGES):
    _t["typescript"] = _t["javascript"]


class Fault(Exception):
    """A file that can't be read, with the line of the first fault."""

    def __init__(self, line: int) -> None:
        self.line = line


@dataclass
class Unit:
    kind: str
    name: str
    start: int
    end: int
    body: tuple[int, int] | None = None
    branches: int = 0
    implemented: bool = False
    facts: list[str] = field(default_factory=list)


def _brackets(masked: str) -> dict[int, int]:
    """Each opening bracket's closing one; raises Fault where they don't match."""
    pairs, stack, close = {}, [], {"(": ")", "[": "]", "{": "}"}
    for m in re.finditer(r"[()\[\]{}]", masked):
        if m[0] in close:
            stack.append(m.start())
        elif not stack or close[masked[stack[-1]]] != m[0]:
            raise Fault(masked.count("\n", 0, m.start()) + 1)
        else:
            pairs[stack.pop()] = m.start()
    if stack:
        raise Fault(masked.count("\n", 0, stack[-1]) + 1)
    return pairs


def _body_of(masked: str, pairs: dict[int, int], at: int, limit: int) -> int:
    """The brace that opens a body after a head at ``at``, over its parameters and types; -1 where a statement ends first."""
    while at < limit:
        c = masked[at]
        if c == "{":
            return at
        if c in ";}":
            return -1
        at = pairs[at] + 1 if c in "([" else at + 1
    return -1


def _others(text: str, language: str) -> tuple[list[Unit], str]:
    masked = _MASKED[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    pairs = _brackets(masked)
    units: list[Unit] = []
    for kind, pattern in _DECLARED[language]:
        for m in pattern.finditer(masked):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            brace = _body_of(masked, pairs, m.end(), len(masked))
            if kind == "function" and "=" in m[0]:  # an arrow bound to a name
                close = pairs.get(m.end(), -1)
                if close < 0 or not (a := re.compile(r"\s*(?::[^=;{}]*)?=>\s*\{").match(masked, close + 1)):
                    continue
                brace = a.end() - 1
            if brace < 0:
                stop = masked.find(";", m.end())
                if kind in ("struct", "package") and stop >= 0:
                    units.append(Unit(kind, m[1], start, stop + 1))
                continue
            units.append(Unit(kind, m[1].strip(), start, pairs[brace] + 1, (brace, pairs[brace] + 1)))
    if language in ("javascript", "typescript"):
        for owner in [u for u in units if u.kind == "class"]:
            at = owner.body[0] + 1
            while m := _MEMBER.search(masked, at, owner.end - 1):
                if nested := _OPENING.search(masked, at, m.start()):  # a field's value or a body ahead of it
                    at = pairs[nested.start()] + 1
                    continue
                brace = _body_of(masked, pairs, m.end(), owner.end)
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                if brace >= 0 and m[1] not in _WORDS - {"constructor"}:
                    units.append(Unit("method", m[1], start, pairs[brace] + 1, (brace, pairs[brace] + 1)))
                    at = pairs[brace] + 1
                else:
                    at = pairs[m.end()] + 1
    if language == "perl":  # a package without braces runs to the next one, else to the end of the text
        heads = sorted((u for u in units if u.kind == "package" and not u.body), key=lambda u: u.start)
        for u, after in zip(heads, [*heads[1:], None]):
            stop = after.start if after else len(masked)
            u.end = u.start + len(masked[u.start : stop].rstrip())
    for u in units:
        part = masked[u.body[0] : u.body[1]] if u.body else ""
        u.branches = len(_BRANCH.findall(part))
        u.implemented = u.kind in CALLABLE and bool(u.body) and (language == "rust" or bool(part[1:-1].strip()))
        if u.implemented:
            u.facts = ["executable_behavior"]
            u.facts += ["fallback_candidate"] * bool(re.search(_FALLBACK[language], part))
            u.facts += ["state_transition_candidate"] * (len(re.findall(_CHANGES[language], part)) > 1)
            u.facts += ["validation_candidate"] * bool(re.search(_VALIDATES[language], part))
    return units, masked


def _python(text: str) -> tuple[list[Unit], list[tuple[str, int]]]:
    """Declarations and (name, place) of calls; offsets are bytes."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError as e:
        raise Fault(e.lineno or 1) from None
    except (ValueError, RecursionError, MemoryError):
        raise Fault(1) from None
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    place = lambda line, column: starts[line - 1] + column
    units, calls = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)
            if name:
                calls.append((name, place(node.lineno, node.col_offset)))
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        u = Unit("class" if isinstance(node, ast.ClassDef) else "function", node.name, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset))
        u.body = (place(node.body[0].lineno, node.body[0].col_offset), u.end)
        own: list[ast.AST] = []
        todo = list(node.body)
        while todo:  # nested callables have their own effects
            x = todo.pop()
            own.append(x)
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                todo.extend(ast.iter_child_nodes(x))
        u.branches = sum(isinstance(x, _BRANCHES) for x in ast.walk(node))
        u.implemented = u.kind == "function" and any(not isinstance(s, ast.Pass) and not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) for s in node.body)
        if u.implemented:
            changes = sum(isinstance(x, _EFFECTS) and any(isinstance(t, ast.Attribute) for t in (x.targets if isinstance(x, ast.Assign) else [x.target])) for x in own)
            fallback = any(isinstance(x, (ast.ExceptHandler, ast.IfExp)) or isinstance(x, ast.BoolOp) and isinstance(x.op, ast.Or) for x in own)
            u.facts = ["executable_behavior"] + ["fallback_candidate"] * fallback + ["state_transition_candidate"] * (changes > 1) + ["validation_candidate"] * any(isinstance(x, (ast.Raise, ast.Assert)) for x in own)
        units.append(u)
    return units, calls


EVERY = ("unit", "reference", "import", "diagnostic")


def parse(path: str, text: str, max_units: int | None = None, records: tuple[str, ...] = EVERY) -> Iterator[dict]:
    """The rows of one file: its units with their place, owner, facts and members, the calls in each, its first 32 imports; or one diagnostic.

    Units are nested by their spans: sorted by start and falling end, a stack gives each its owner. A function in a class, implementation, trait or
    interface is a method. More units than ``max_units`` are a diagnostic, never a cut.
    """
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        return
    base = {"path": path, "language": language}
    ascii_ = text.isascii()
    try:
        if language == "python":
            units, calls = _python(text)
            calls = calls if "reference" in records else []
        else:
            units, masked = _others(text, language)
            calls = []
        if language != "python" and "reference" in records:
            declared = {masked.find(u.name, u.start) for u in units if u.kind in CALLABLE}
            calls = [(m[1], m.start()) for m in _CALLS.finditer(masked) if m[1] not in _WORDS and m.start() not in declared]
    except Fault as fault:
        if "diagnostic" not in records:
            return
        yield base | {"record": "diagnostic", "kind": "syntax-error", "start_line": fault.line}
        return
    if max_units is not None and len(units) > max_units:
        yield base | {"record": "diagnostic", "kind": "unit-limit", "start_line": 1}
        return
    body = text.encode("utf-8", "replace")
    if language != "python" and not ascii_:
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        ends = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]).tolist()
        for u in units:
            u.start, u.end, u.body = ends[u.start], ends[u.end], u.body and (ends[u.body[0]], ends[u.body[1]])
        calls = [(n, ends[at]) for n, at in calls]
    breaks = np.flatnonzero(np.frombuffer(body, np.uint8) == 10).tolist()
    line = lambda at: bisect_right(breaks, at - 1) + 1
    units.sort(key=lambda u: (u.start, -u.end))
    joint = "::" if language in ("rust", "perl") else "."
    stack: list[dict] = []
    rows: list[dict] = []
    for u in units:
        while stack and stack[-1]["end_byte"] < u.end:
            stack.pop()
        owner = stack[-1] if stack else None
        kind = "method" if u.kind == "function" and owner and owner["kind"] in OWNERS else u.kind
        absolute = language == "perl" and ("::" in u.name or u.kind == "package")
        qualified = f"{owner['qualified_name']}{joint}{u.name}" if owner and not absolute else u.name
        signature = body[u.start : u.body[0] if u.body else u.end].decode("utf-8", "replace").strip().rstrip(";:{").strip()
        row = base | {
            "record": "unit", "unit_id": f"{path}:{u.start}:{kind}", "kind": kind, "name": u.name, "qualified_name": qualified, "parent_id": owner and owner["unit_id"], "signature": signature if len(signature) <= 1024 else signature[:1024] + " [signature abbreviated]",
            "start_byte": u.start, "end_byte": u.end, "body_start_byte": u.body and u.body[0], "body_end_byte": u.body and u.body[1], "start_line": line(u.start), "end_line": line(max(u.start, u.end - 1)), "branch_nodes": u.branches, "member_count": 0, "has_implementation": u.implemented, "facts": u.facts,
        }
        if owner:
            owner["member_count"] += 1
            if u.implemented and owner["kind"] in OWNERS and "executable_behavior" not in owner["facts"]:
                owner["facts"] = [*owner["facts"], "executable_behavior"]
        rows.append(row)
        stack.append(row)
    if "unit" in records:
        yield from rows
    opened: list[dict] = []
    following = iter([*rows, None])
    coming = next(following)
    for name, at in sorted(calls, key=lambda x: x[1]):  # a sweep over starts with the open units on a stack
        while coming is not None and coming["start_byte"] <= at:
            while opened and opened[-1]["end_byte"] < coming["end_byte"]:
                opened.pop()
            opened.append(coming)
            coming = next(following)
        while opened and opened[-1]["end_byte"] <= at:
            opened.pop()
        yield base | {"record": "reference", "name": name, "parent_id": opened[-1]["unit_id"] if opened else None, "start_byte": at, "start_line": line(at)}
    for m in list(_IMPORT[language].finditer(text))[:32] if "import" in records else ():
        at = len(text[: m.start()].encode("utf-8", "replace"))
        yield base | {"record": "import", "signature": m[0].strip()[:1024], "start_byte": at, "start_line": line(at)}


def parsed(files: DataFrame, max_bytes: int | None = None, max_units: int | None = None, records: tuple[str, ...] = EVERY) -> DataFrame:
    """The rows, of the kinds asked for, of all files in the five languages, in one narrow map over whole texts; repeated files count once.

    ``record`` is unit, reference (a call, with its innermost unit), import or diagnostic. Files above ``max_bytes`` give a ``size-limit``
    diagnostic, unreadable ones ``unreadable``; others that fail give ``syntax-error`` with the line of the first fault.
    """
    rows = files.select("path", "content").filter(language_of(F.col("path")).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                language = LANGUAGES.get((path or "").rsplit(".", 1)[-1].lower())
                if language is None:
                    continue
                if text is None or max_bytes is not None and len(text.encode("utf-8", "replace")) > max_bytes:
                    if "diagnostic" in records:
                        out.append({"record": "diagnostic", "path": path, "language": language, "kind": "unreadable" if text is None else "size-limit", "start_line": 1})
                    continue
                out.extend(parse(path, text, max_units, records))
            columns = [pa.array([r.get(f.name) for r in out], f.type) for f in FIELDS]
            yield pa.RecordBatch.from_arrays(columns, schema=FIELDS)

    # a repeated file gives the same rows again; its rows are less than its text
    return rows.mapInArrow(run, ROWS).dropDuplicates(["record", "path", "kind", "name", "start_byte"])

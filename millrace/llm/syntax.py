"""Problem 6: files that are no valid syntax of their language.

A lexer reduces each file to its adjacent pairs of token classes; the pairs are rows of a DataFrame, anti-joined with
the pairs that the grammar's classes permit. Nesting and statement productions are reductions over windows of a file's
tokens, which are columns for many files at a time. Python's productions are those of the interpreter's own grammar.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import language_of

# Token classes. What a pair means depends on the language; the numbers do not.
CLASSES = "EDGE IDENT NUM STR REGEX LPAR RPAR LBRACK RBRACK LBRACE RBRACE SEMI COMMA DOT ARROW SPREAD ASSIGN BIN LT GT SIGN INCDEC BANG QUEST COLON AT DECL FUNC CLASS HEAD BLOCK RETURN PREFIX INFIX CONST MODULE BREAK HERITAGE MODIFIER CASE CATCH LIFETIME STAR AMP PIPE HASH MACRO PATHSEP THINARROW LETMOD VAR BUILTIN".split()
C = {name: i for i, name in enumerate(CLASSES)}
N = len(CLASSES)
OPEN = {"(": ")", "[": "]", "{": "}"}
CONFLICT = re.compile(r"(?m)^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))")

SKIP = r"(?:[ \t\r\f\v﻿   ]+|//[^\n]*+|/\*(?>[\s\S]*?\*/))"


def _words(spec: dict[str, str]) -> dict[str, int]:
    return {w: C[k] for k, words in spec.items() for w in words.split()}


# The reserved words of the languages by the class of what may follow them.
JS_WORDS = _words({
    "DECL": "const let var", "FUNC": "function", "CLASS": "class", "HEAD": "if while for switch with", "CATCH": "catch finally", "BLOCK": "else do try",
    "RETURN": "return throw", "PREFIX": "new typeof void delete await yield", "INFIX": "in instanceof", "CONST": "this super null true false", "MODULE": "import export",
    "BREAK": "break continue debugger", "HERITAGE": "extends", "MODIFIER": "async get set static of from as", "CASE": "case default",
})
TS_WORDS = JS_WORDS | _words({
    "HERITAGE": "extends implements", "CLASS": "class interface enum namespace module type",
    "MODIFIER": "async get set static of from as public private protected readonly declare abstract keyof infer is satisfies asserts unique override accessor global",
})
TS_SOFT = frozenset("type namespace module interface enum".split())
RUST_WORDS = _words({
    "FUNC": "fn", "CLASS": "struct enum union trait mod", "HEAD": "if while match for impl", "BLOCK": "else loop", "RETURN": "return break", "INFIX": "as in where", "CONST": "self Self super crate true false",
    "MODULE": "use", "DECL": "let const static type", "LETMOD": "mut ref move", "MODIFIER": "pub unsafe extern async dyn", "BREAK": "continue", "PREFIX": "await",
})
PERL_WORDS = _words({
    "DECL": "my our local state", "FUNC": "sub", "CLASS": "package", "MODULE": "use no require", "HEAD": "if elsif unless while until for foreach given when", "BLOCK": "else do eval continue BEGIN END",
    "RETURN": "return die warn print printf say exit last next redo goto", "INFIX": "and or xor not x eq ne lt gt le ge cmp isa",
    "BUILTIN": "abs bless chomp chop chr close closedir defined delete each exists exec exp grep hex index int join keys kill lc lcfirst length local log lstat map mkdir new oct open opendir ord pack pop pos push quotemeta rand read ref reverse rindex rmdir scalar seek shift sleep sort splice split sprintf sqrt stat substr system tie time uc ucfirst undef unlink unpack unshift utime values wantarray write bin2 binmode caller carp croak confess eof fileno lock sin cos local localtime gmtime ok is isnt like is_deeply done_testing plan diag note",
})

_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_JS_OPS = [
    ("SPREAD", r"\.\.\."), ("ARROW", r"=>"), ("BIN", r">>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?="), ("DOT", r"\?\.(?!\d)|\.(?!\d)"), ("ASSIGN", r"(?:[+\-*/%&|^])=(?!=)|=(?!=)"),
    ("BIN", r"===|!==|==|!=|<=|>=(?!=)|&&|\|\||\?\?|\*\*|<<"), ("GT", r">>>|>>|>"), ("LT", r"<"), ("INCDEC", r"\+\+|--"), ("SIGN", r"[+\-]"), ("BIN", r"/(?!\*)|[*%^]"), ("PIPE", r"[|&]"),
    ("BANG", r"[!~]"), ("QUEST", r"\?"), ("COLON", r":"), ("AT", r"@"),
]
_PUNCT = [("LPAR", r"\("), ("RPAR", r"\)"), ("LBRACK", r"\["), ("RBRACK", r"\]"), ("LBRACE", r"\{"), ("RBRACE", r"\}"), ("SEMI", r";"), ("COMMA", r",")]
_NUMBER = r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"


def _compile(rules: list[tuple[str, str]], skip: str) -> tuple[re.Pattern, list[int]]:
    kinds = [-1]
    for k, r in rules:
        kinds += [C.get(k, -2)] * (1 + re.compile(r).groups)
    return re.compile(skip + "*+(?:" + "|".join(f"({r})" for _, r in rules) + ")"), kinds


_JS_BASE = [("NL", r"\n"), ("IDENT", r"#?(?:[^\W\d]|[$\\])[\w$\u200c\u200d]*"), ("NUM", _NUMBER + r"(?![\w$])"), ("STR", _STRING)]
_JS_REGEX = [("REGEX", r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")]
JS_AFTER_OPERAND = _compile([*_JS_BASE, *_PUNCT, *_JS_OPS], SKIP)
JS_AFTER_OPERATOR = _compile([*_JS_BASE, *_JS_REGEX, *_PUNCT, *_JS_OPS], SKIP)
_RUST_SKIP = r"(?:\s++|//[^\n]*+)"
RUST = _compile([
    ("RAW", r"(?:b|c)?r#*\""), ("STR", r"[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'"), ("LIFETIME", r"'[A-Za-z_]\w*"),
    ("IDENT", r"(?:r#)?[^\W\d]\w*"), ("NUM", r"(?:0[xob][0-9a-fA-F_]+|\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?![\w])"), *_PUNCT,
    ("PATHSEP", r"::"), ("THINARROW", r"->"), ("ARROW", r"=>"), ("SPREAD", r"\.\.=|\.\.\.|\.\."), ("DOT", r"\."), ("ASSIGN", r"<<=|>>=|[+\-*/%^&|]=|=(?!=)"), ("BIN", r"==|!=|<=|>=|<<|/(?!\*)|[%^+]"),
    ("AMP", r"&&|&"), ("PIPE", r"\|\||\|"), ("STAR", r"\*"), ("SIGN", r"-"), ("BANG", r"!"), ("QUEST", r"\?"), ("COLON", r":"), ("LT", r"<"), ("GT", r">"), ("HASH", r"#"), ("AT", r"@"), ("MACRO", r"\$"),
], _RUST_SKIP)
_PERL_SKIP = r"(?:[ \t\r\f\v]++|#[^\n]*+)"
_PERL_VAR = r"\$#?\{?\^?\w+\}?(?:::\w+)*|\$#?(?:::)?\w+(?:::\w+)*|\$#?\${1,8}\w+|\$[&`'+!^/\\,;.@0-9\-\"<>()\[\]|?:~=%]|\$#?(?=\{|\$)|@(?:::)?[A-Za-z_]\w*(?:::\w+)*|@\${1,8}\w+|@(?=\{)|@_\b|@[\-+]"
_PERL_OPS = [
    ("ARROW", r"=>"), ("DOT", r"->"), ("PATHSEP", r"::"), ("SPREAD", r"\.\.\.|\.\."), ("ASSIGN", r"\*\*=|\|\|=|&&=|//=|<<=|>>=|[+\-*/.%x&|^]=(?![=~])|=(?![=~])"), ("BIN", r"<=>|==|!=|=~|!~|<=|>=|&&|\|\||\*\*|<<|>>"),
    ("INCDEC", r"\+\+|--"), ("SIGN", r"[+\-]"), ("LT", r"<"), ("GT", r">"), ("BIN", r"[*.^|]"), ("BANG", r"[!~\\]"), ("QUEST", r"\?"), ("COLON", r":"),
]
_PERL_BASE = [("NL", r"\n"), ("NUM", r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|v\d+(?:\.\d+)+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?!\w)"), ("IDENT", r"[A-Za-z_]\w*(?:(?:::|')(?=[A-Za-z_])\w+)*(?:::)?"), ("STR", r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"), ("VAR", _PERL_VAR)]
PERL_AFTER_OPERAND = _compile([*_PERL_BASE, *_PUNCT, *_PERL_OPS, ("BIN", r"//|/|%|&")], _PERL_SKIP)
PERL_AFTER_OPERATOR = _compile([
    *_PERL_BASE, ("HEREDOC", r"<<~?(?:\"[^\"\n]*\"|'[^'\n]*'|[A-Za-z_]\w*)"), ("STR", r"<\$?\w*>|<STDIN>"), ("REGEX", r"/(?:[^/\\\n]|\\.)*/[a-z]*"), ("VAR", r"%(?:::)?[A-Za-z_+!]\w*(?:::\w+)*|%\${1,8}\w+|%(?=\{)|&\$?[A-Za-z_]\w*(?:::\w+)*|&(?=\{|\$)|\*[A-Za-z_]\w*|\*(?=\{)"),
    ("PREFIX", r"-[a-zA-Z](?=\s*[\$\"'/_])"), *_PUNCT, *_PERL_OPS,
], _PERL_SKIP)
QUOTES = frozenset("q qq qw m qr s tr y".split())
CLOSER = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _set(text: str) -> frozenset[int]:
    return frozenset(C[w] for w in text.split())


ENDS = {
    "js": _set("IDENT NUM STR REGEX RPAR RBRACK RBRACE INCDEC CONST MODIFIER"),
    "rust": _set("IDENT NUM STR RPAR RBRACK RBRACE CONST QUEST LIFETIME PREFIX"),
    "perl": _set("NUM STR REGEX RPAR RBRACK RBRACE VAR INCDEC IDENT"),
}
ENDS["ts"] = ENDS["js"] | _set("GT BANG CLASS PREFIX")


def permitted(language: str) -> frozenset[tuple[int, int, int]]:
    """The (class, next class, line end between) that a program of the language may hold, from what ends and begins an
    operand, a statement, a declaration or a block; the edge of the file is a class of its own."""
    out = set()

    def add(left: str | frozenset, right: str | frozenset, line: tuple = (0, 1)) -> None:
        left = _set(left) if isinstance(left, str) else left
        right = _set(right) if isinstance(right, str) else right
        out.update((a, b, k) for a in left for b in right for k in line)

    ends = ENDS[language]
    if language in ("js", "ts"):
        begins = _set("IDENT NUM STR REGEX LPAR LBRACK LBRACE SIGN INCDEC BANG FUNC CLASS PREFIX CONST MODIFIER MODULE AT") | (_set("LT PIPE") if language == "ts" else frozenset())
        starts = begins | _set("DECL HEAD BLOCK RETURN BREAK CASE SEMI CATCH")
        operators = "ASSIGN BIN LT GT SIGN BANG QUEST COLON COMMA ARROW SPREAD LPAR LBRACK INFIX PREFIX RETURN PIPE HERITAGE"
        add(ends, "ASSIGN BIN LT GT SIGN DOT QUEST COLON COMMA SEMI RPAR RBRACK RBRACE LPAR LBRACK INCDEC ARROW INFIX PIPE EDGE")
        add(ends, starts, (1,))
        add("RBRACE RPAR", starts, (0,))
        add("RBRACE", "BLOCK CATCH HERITAGE MODIFIER", (0, 1))
        add("IDENT RPAR RBRACK CONST STR", "LBRACE", (0,))
        add("IDENT STR", "MODIFIER", (0,))
        add("MODIFIER", "IDENT LBRACE LPAR LBRACK STR FUNC CONST MODIFIER NUM CLASS DECL PREFIX", (0,))
        add("IDENT RBRACE MODIFIER", "HERITAGE")
        add(operators, begins)
        add("LPAR", "RPAR"), add("LBRACK", "RBRACK"), add("COMMA", "RPAR RBRACK RBRACE COMMA"), add("LBRACK", "COMMA")
        add("LPAR SEMI", "SEMI DECL RPAR"), add("INFIX", "DECL")
        add("QUEST", "DOT COLON")
        add("LBRACE RBRACE SEMI EDGE", starts | _set("RBRACE EDGE"))
        add("LBRACE", "SPREAD"), add("COMMA LPAR LBRACK", "SPREAD"), add("SPREAD", begins)
        add("LBRACE COMMA", "BIN") if language == "js" else add("LBRACE COMMA", "BIN SIGN")
        add("FUNC MODIFIER COMMA LBRACE RBRACE SEMI PREFIX", "BIN")  # generators: * as of BIN
        add("BIN", "IDENT LPAR LBRACK STR")
        add("COLON", starts | _set("RBRACE"))
        add("ARROW", "LBRACE")
        add("INCDEC SIGN", begins)
        add("DECL", "IDENT LBRACK LBRACE MODIFIER CLASS"), add("FUNC", "IDENT LPAR MODIFIER BIN LT"), add("CLASS", "IDENT LBRACE HERITAGE MODIFIER")
        add("HEAD", "LPAR"), add("HEAD", "PREFIX", (0,)), add("CATCH", "LPAR LBRACE"), add("BLOCK", "LBRACE"), add("BLOCK", starts)
        add("RETURN", "SEMI RBRACE EDGE"), add("RETURN", starts, (1,)), add("PREFIX", "DOT SEMI RPAR RBRACE COMMA")
        add("MODULE", "LBRACE STR IDENT DECL FUNC CLASS MODIFIER CASE BIN LPAR DOT ASSIGN MODULE AT")
        add("BREAK", "SEMI IDENT RBRACE EDGE"), add("BREAK", starts, (1,))
        add("CASE", begins | _set("COLON COMMA RBRACE FUNC"))
        add("HERITAGE", "LBRACE"), add("AT", "IDENT LPAR"), add("DOT", "IDENT LPAR LBRACK STR LT MODIFIER CONST")
        add("BIN", "RBRACE COMMA SEMI", ()), add("MODIFIER", "BIN")
        if language == "ts":
            add(ends, "BANG HERITAGE"), add("GT RBRACK IDENT CONST", "LBRACE"), add("PREFIX CONST", "RPAR RBRACK RBRACE COMMA SEMI LBRACE ASSIGN GT PIPE ARROW")
            add("RPAR RBRACK NUM GT CONST", "MODIFIER"), add("QUEST", "RPAR COMMA LPAR ASSIGN SEMI RBRACE LT"), add("LT COMMA PIPE COLON ASSIGN ARROW", begins)
            add("SIGN", "QUEST MODIFIER"), add("COLON LPAR COMMA LT PIPE ASSIGN INFIX", "PREFIX CONST FUNC"), add("CLASS", "STR ASSIGN COLON DOT COMMA RPAR SEMI QUEST LBRACK CLASS LT"), add("MODIFIER", "PREFIX CLASS DECL MODULE")
            add("DECL", "CLASS"), add("DOT", "CLASS"), add("MODULE", "CLASS"), add("BANG", "ASSIGN DOT COLON"), add("LBRACE COMMA SEMI", "SIGN"), add("QUEST COLON ARROW", "PIPE"), add("RBRACK IDENT RPAR RBRACE CONST GT PREFIX", "SEMI"), add("PREFIX", "FUNC PIPE LBRACE EDGE")
    elif language == "rust":
        begins = _set("IDENT NUM STR LPAR LBRACK LBRACE SIGN STAR AMP PIPE BANG CONST HEAD BLOCK RETURN BREAK LETMOD MODIFIER LT PATHSEP LIFETIME SPREAD HASH MACRO")
        items = begins | _set("FUNC CLASS DECL MODULE SEMI")
        add(ends, "ASSIGN BIN LT GT SIGN STAR AMP PIPE DOT QUEST COLON COMMA SEMI RPAR RBRACK RBRACE LPAR LBRACK LBRACE ARROW SPREAD INFIX PATHSEP AT BANG EDGE")
        add(ends, "HEAD BLOCK"), add("RPAR GT", "THINARROW"), add("RPAR RBRACK RBRACE GT IDENT CONST", "INFIX")
        add("RBRACE SEMI LBRACE", items | _set("RBRACE EDGE"))
        add("EDGE", "IDENT HEAD HASH CONST PATHSEP MODIFIER FUNC CLASS DECL MODULE EDGE"), add("RBRACK", items - _set("NUM STR"))
        add("RPAR", "MODIFIER FUNC CLASS IDENT DECL MODULE"), add("RBRACE", "BLOCK RPAR RBRACK COMMA DOT QUEST")
        add("ASSIGN BIN SIGN STAR AMP PIPE BANG COMMA ARROW LPAR LBRACK SPREAD COLON INFIX RETURN LT AT", begins), add("THINARROW", begins - _set("LBRACE NUM STR BLOCK RETURN BREAK SIGN PIPE SPREAD HASH") | _set("FUNC"))
        add("PIPE", "PIPE THINARROW LBRACE IDENT"), add("LPAR", "RPAR"), add("LBRACK", "RBRACK"), add("COMMA", "RPAR RBRACK RBRACE GT HASH DECL"), add("LT COMMA", "GT LIFETIME DECL"), add("LPAR LBRACE", "DECL MODULE")
        add("GT", "LPAR LBRACE COMMA SEMI RPAR RBRACK GT ASSIGN PATHSEP PIPE COLON RBRACE BIN DOT INFIX QUEST ARROW AMP STAR IDENT NUM CONST STR SIGN LBRACK BANG MACRO LIFETIME HEAD EDGE"), add("BIN", "GT")
        add("PATHSEP", "IDENT LT STAR LBRACE CONST"), add("STAR", "DECL SEMI COMMA RBRACE"), add("AMP", "LETMOD LIFETIME")
        add("DOT", "IDENT NUM PREFIX"), add("FUNC", "IDENT LPAR MACRO"), add("CLASS", "IDENT MACRO"), add("DECL", "IDENT LPAR LBRACK LETMOD AMP CONST FUNC MODIFIER BLOCK LBRACE MACRO NUM")
        add("HEAD BLOCK", "LBRACE DECL LT LPAR HEAD"), add("HEAD", begins), add("RETURN", "SEMI RBRACE COMMA LIFETIME RPAR"), add("BREAK", "SEMI RBRACE LIFETIME COMMA"), add("MODULE", "IDENT CONST PATHSEP LBRACE MACRO")
        add("LETMOD", "IDENT CONST PIPE BLOCK LBRACE LETMOD MACRO LPAR AMP"), add("MODIFIER", "FUNC CLASS DECL MODULE LPAR MODIFIER LBRACE HEAD STR IDENT CONST LETMOD PIPE")
        add("HASH", "LBRACK BANG"), add("BANG", "LPAR LBRACK LBRACE IDENT SEMI COMMA RBRACE"), add("MACRO", "IDENT LPAR CONST"), add("IDENT", "MACRO BANG"), add("COLON", "LIFETIME BANG"), add("LIFETIME", "COLON IDENT GT COMMA LETMOD LPAR LBRACK MODIFIER BIN LBRACE")
        add("SPREAD", "RPAR RBRACK RBRACE COMMA ASSIGN SEMI LBRACE ARROW"), add("QUEST", "CLASS IDENT"), add("INFIX", "LIFETIME STAR"), add("PIPE", "COMMA ARROW LETMOD"), add("CONST", "CLASS"), add("LPAR COMMA", "LETMOD AMP LIFETIME HASH")
    else:
        begins = _set("IDENT NUM STR REGEX LPAR LBRACK LBRACE SIGN INCDEC BANG DECL FUNC BUILTIN RETURN VAR PREFIX HEAD BLOCK LT MODULE CLASS INFIX")
        starts = begins | _set("SEMI RBRACE EDGE")
        add(ends, "ASSIGN BIN LT GT SIGN DOT QUEST COLON COMMA SEMI RPAR RBRACK RBRACE LBRACK LBRACE LPAR ARROW SPREAD INFIX INCDEC HEAD EDGE BLOCK PATHSEP")
        add("RBRACE", starts), add("SEMI LBRACE EDGE", starts), add("COLON", starts)
        add("ASSIGN BIN LT GT SIGN QUEST COMMA ARROW SPREAD LPAR LBRACK INFIX BANG LBRACE RETURN BUILTIN PREFIX INCDEC", begins)
        add("COMMA ARROW LPAR", "RPAR RBRACK RBRACE COMMA"), add("LBRACK", "RBRACK"), add("RPAR", "STR VAR LBRACE BUILTIN", (0,)), add("LPAR", "SEMI"), add("SEMI", "RPAR")
        add("DOT", "IDENT LPAR LBRACK LBRACE VAR BUILTIN RETURN HEAD BLOCK INFIX CLASS FUNC DECL MODULE")
        add("IDENT", "VAR STR NUM LBRACE FUNC", (0, 1)), add("IDENT", "BUILTIN", (0,))
        add("BUILTIN", "SEMI RPAR RBRACK RBRACE COMMA ARROW ASSIGN BIN GT LT SIGN QUEST COLON INFIX IDENT HEAD EDGE DOT")
        add("VAR", "VAR LBRACE"), add("DECL", "VAR LPAR IDENT"), add("FUNC", "IDENT LBRACE LPAR BUILTIN"), add("CLASS", "IDENT"), add("MODULE", "IDENT NUM STR"), add("IDENT", "STR VAR NUM REGEX")
        add("HEAD", "LPAR DECL VAR"), add("HEAD", begins), add("BLOCK", "LBRACE IDENT STR VAR"), add("RETURN", "SEMI RBRACE HEAD IDENT INFIX EDGE ARROW RPAR COMMA"), add("VAR", "FUNC")
        add("DECL RETURN HEAD BLOCK CLASS MODULE INFIX FUNC", "ARROW RBRACE"), add("INFIX", "HEAD"), add("RPAR", "IDENT", (0,)), add("NUM", "IDENT INFIX", (0,))
        out -= {(C["INFIX"], C["INFIX"], 1)}
    return frozenset(out)


_IN_STRING = re.compile(r"[^\\`$]+")


def _template(text: str, at: int) -> int:
    """The end of the template literal whose first character is at ``at``, with what is nested in it; -1 where it isn't closed."""
    n, i = len(text), at + 1
    inside: list[int] = [-1]  # for each open template -1, for each substitution in it the braces open there
    quoted = re.compile(_STRING)
    while i < n:
        c = text[i]
        if inside[-1] < 0:
            if c == "\\":
                i += 2
            elif c == "`":
                inside.pop()
                i += 1
                if not inside:
                    return i
            elif c == "$" and text[i + 1 : i + 2] == "{":
                inside.append(1)
                i += 2
            elif m := _IN_STRING.match(text, i):
                i = m.end()
            else:
                i += 1
        elif c == "`":
            inside.append(-1)
            i += 1
        elif c in "\"'":
            m = quoted.match(text, i)
            if not m:
                return -1
            i = m.end()
        else:
            inside[-1] += (c == "{") - (c == "}")
            if not inside[-1]:
                inside.pop()
            i += 1
    return -1


def _delimited(text: str, at: int) -> int:
    """The end of a quote-like operand whose delimiter is at ``at``, nested brackets counted; -1 where it isn't closed."""
    if at >= len(text):
        return -1
    start = text[at]
    close = CLOSER.get(start, start)
    depth, i = 1, at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == close:
            depth -= 1
            if not depth:
                return i + 1
        elif c == start:
            depth += 1
        i += 1
    return -1


class Fault(Exception):
    """What is wrong, in a word."""


def tokens(text: str, language: str) -> Iterator[tuple[int, int, int, int]]:
    """(class, line end before, start, end) of each token; raises Fault where the text has none."""
    js = language in ("js", "ts")
    after_operand, after_operator = {"perl": (PERL_AFTER_OPERAND, PERL_AFTER_OPERATOR), "rust": (RUST, RUST)}.get(language, (JS_AFTER_OPERAND, JS_AFTER_OPERATOR))
    words = {"js": JS_WORDS, "ts": TS_WORDS, "rust": RUST_WORDS, "perl": PERL_WORDS}[language]
    ends, ident, dot = ENDS[language], C["IDENT"], C["DOT"]
    pos, n, prev, line = 0, len(text), 0, 0
    trailing = re.compile({"rust": _RUST_SKIP, "perl": _PERL_SKIP}.get(language, SKIP) + "*+")
    heredocs: list[tuple[str, bool]] = []
    word = ""
    while True:
        pattern, kinds = after_operand if prev in ends and word not in ("return", "and", "or", "not", "if", "unless") else after_operator
        m = pattern.match(text, pos)
        if not m:
            pos = trailing.match(text, pos).end()
            if pos >= n:
                break
            if js and text[pos] == "`":
                end = _template(text, pos)
                if end < 0:
                    raise Fault("template")
                yield C["STR"], line, pos, end
                prev, pos, line, word = C["STR"], end, 0, ""
                continue
            if language == "rust" and text.startswith("/*", pos):
                depth, i = 1, pos + 2
                for k in re.compile(r"/\*|\*/").finditer(text, i):
                    depth += 1 if k[0] == "/*" else -1
                    if not depth:
                        break
                if depth:
                    raise Fault("comment")
                pos = k.end()
                continue
            raise Fault("token")
        index = m.lastindex
        kind = kinds[index]
        start, end = m.span(index)
        if kind == -2:
            if language == "rust":  # a raw string, whose end isn't escaped
                close = text[start:end].lstrip("bcr").rstrip('"')
                end = text.find('"' + close, end)
                if end < 0:
                    raise Fault("token")
                end += 1 + len(close)
                yield C["STR"], line, start, end
                prev, pos, line, word = C["STR"], end, 0, ""
                continue
            if text[start] == "\n":  # a line end
                pos, line = end, 1
                if language == "perl":
                    if heredocs:
                        for tag, indented in heredocs:
                            k = re.compile(rf"(?m)^{'[ \t]*' if indented else ''}{re.escape(tag)}$").search(text, pos)
                            if not k:
                                raise Fault("heredoc")
                            pos = min(n, k.end() + 1)
                        heredocs = []
                    if re.compile(r"=[A-Za-z]").match(text, pos):
                        k = re.compile(r"(?m)^=cut\b[^\n]*\n?").search(text, pos)
                        pos = k.end() if k else n
                continue
            tag = m[index][2:]
            heredocs.append((tag.lstrip("~").strip("\"'"), tag.startswith("~")))
            kind = C["STR"]
        if kind == ident:
            word = text[start:end]
            known = words.get(word)
            if known is not None and prev != dot:
                rest = text[end : end + 2].lstrip(" ")
                if js and (rest[:1] == ":" and word != "default" or language == "ts" and word in TS_SOFT and not re.match(r"\s+[A-Za-z_$\"'{]", text[end : end + 40])):
                    kind = ident
                elif js and rest[:1] in (",", ")", "=", ";", ".") and (known == C["MODIFIER"] or word == "await" and rest != "=>"):
                    kind = ident
                elif language == "perl" and (text[end : end + 8].lstrip().startswith("=>") or (prev == C["LBRACE"] and text[end : end + 1] == "}")):
                    kind = C["STR"]
                elif word == "const" and language == "ts" and prev == C["MODIFIER"]:
                    kind = C["CONST"]
                else:
                    kind = known
            elif language == "perl" and word in QUOTES and prev != dot and prev != C["FUNC"] and not text[end : end + 8].lstrip().startswith(("=>", ",", ";", ")")) and not (prev == C["LBRACE"] and text[end : end + 1] == "}") and not (word in ("s", "y", "m", "q") and text[end : end + 8].lstrip(" ").startswith("=")):
                at = end
                while at < n and text[at].isspace():
                    at += 1
                end = _delimited(text, at)
                if end < 0:
                    raise Fault("quote")
                if word in ("s", "tr", "y"):
                    if text[at] in CLOSER:
                        at = end
                        while at < n and text[at].isspace():
                            at += 1
                        end = _delimited(text, at)
                    else:
                        end = _delimited(text, end - 1)
                    if end < 0:
                        raise Fault("quote")
                k = re.compile(r"[a-z]*").match(text, end)
                end, kind, word = k.end() if word != "qw" and word not in ("q", "qq") else end, C["STR"], ""
            elif language == "perl" and word in ("__END__", "__DATA__"):
                break
            if kind != ident and word not in ("return", "and", "or", "not", "if", "unless"):
                word = ""
        else:
            word = ""
        yield kind, line, start, end
        prev, pos, line = kind, end, 0
    if heredocs:
        raise Fault("heredoc")


# Words that productions ask for, by number.
WORDS = {w: i for i, w in enumerate(["", "if", "else", "for", "while", "switch", "with", "try", "case", "const", "struct", "self", "elsif", "unless", "until", "await"])}
_WORDED = _set("HEAD BLOCK CASE DECL CLASS CONST PREFIX")
_CLOSES = {C["LPAR"]: C["RPAR"], C["LBRACK"]: C["RBRACK"], C["LBRACE"]: C["RBRACE"]}


def lex(text: str, language: str) -> tuple[list[int], list[int], list[int], str | None]:
    """(classes, line ends before, words) of the tokens of a text that isn't Python, and what stopped the lexer: a character that
    begins no token, or a conflict marker; null where it came to the end."""
    kinds, lines, words = [], [], []
    if text.startswith("#!") and not text.startswith("#!["):
        text = text[text.find("\n") if "\n" in text else len(text) :]
    try:
        for kind, line, start, end in tokens(text, language):
            kinds.append(kind)
            lines.append(line)
            words.append(WORDS.get(text[start:end], 0) if kind in _WORDED else 0)
            if line and text[start] in "<=>|" and text[start - 1] == "\n" and CONFLICT.match(text, start):
                return kinds, lines, words, "conflict"
    except Fault as fault:
        return kinds, lines, words, str(fault)
    return kinds, lines, words, None


def _is(values: np.ndarray, names: str) -> np.ndarray:
    return np.isin(values, list(_set(names)))


class Tokens:
    """The tokens of many files of one language as columns, in file order, with what windows over a file's tokens tell of each.

    ``depth`` is a running sum of brackets; ``mate`` the bracket that follows in the window of a file and depth; ``parent`` the last
    bracket opened one level up. Places outside a file hold -1, the class there is EDGE.
    """

    def __init__(self, file: np.ndarray, kind: np.ndarray, line: np.ndarray, word: np.ndarray) -> None:
        self.file, self.kind, self.line, self.word = file, kind, line, word
        n = len(kind)
        self.at = np.arange(n)
        opens, closes = _is(kind, "LPAR LBRACK LBRACE"), _is(kind, "RPAR RBRACK RBRACE")
        total = np.cumsum(opens.astype(np.int64) - closes)
        new = np.concatenate([[True], file[1:] != file[:-1]]) if n else np.empty(0, bool)
        self.first = np.maximum.accumulate(np.where(new, self.at, 0)) if n else self.at
        start = np.concatenate([[0], total[:-1]])[self.first] if n else total
        depth = total - start
        self.opens, self.closes, self.below, self.left = opens, closes, depth < 0, depth
        level = depth + closes
        b = np.flatnonzero(opens | closes)
        b = b[np.lexsort((b, level[b], file[b]))]
        self.mate = np.full(n, -1)
        pair = np.flatnonzero((file[b[:-1]] == file[b[1:]]) & (level[b[:-1]] == level[b[1:]]) & opens[b[:-1]] & closes[b[1:]]) if len(b) else b
        o, c = b[pair], b[pair + 1] if len(pair) else pair
        self.mate[o], self.mate[c] = c, o
        self.crossed = np.zeros(n, bool)
        self.crossed[o] = np.array([_CLOSES.get(k, -1) for k in range(N)])[kind[o]] != kind[c]
        # the window of a file and depth holds the brackets opened to that depth and what lies directly in them
        o = np.flatnonzero(opens)
        where = np.concatenate([o, self.at])
        key = np.concatenate([level[o], level - opens - closes])
        setter = np.concatenate([np.ones(len(o), bool), np.zeros(n, bool)])
        order = np.lexsort((where, key, file[where]))
        last = np.maximum.accumulate(np.where(setter[order], np.arange(len(order)), -1)) if n else order
        got = np.where(last >= 0, order[np.maximum(last, 0)], 0)
        same = (last >= 0) & (file[where[got]] == file[where[order]]) & (key[got] == key[order])
        parent = np.empty(len(order), np.int64)
        parent[order] = np.where(same, where[got], -1)
        self.parent = parent[len(o) :]

    def kinds(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.kind[np.maximum(places, 0)], 0)

    def words(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.word[np.maximum(places, 0)], 0)

    def back(self, places: np.ndarray, k: int = 1) -> np.ndarray:
        """The tokens ``k`` before some, in the same file."""
        to = places - k
        return np.where((places >= 0) & (to >= self.first[np.maximum(places, 0)]), to, -1)

    def on(self, places: np.ndarray) -> np.ndarray:
        """The tokens after some, in the same file."""
        to = np.minimum(places + 1, len(self.kind) - 1)
        return np.where((places >= 0) & (to > places) & (self.file[to] == self.file[np.maximum(places, 0)]), to, -1)

    def before_mate(self, closers: np.ndarray) -> np.ndarray:
        """What stands before the bracket that some closing ones close."""
        mates = np.where(closers >= 0, self.mate[np.maximum(closers, 0)], -1)
        return self.back(mates)


def _count(t: Tokens, where: np.ndarray) -> np.ndarray:
    """Per place, how many of the marked tokens lie directly in the bracket opened there."""
    parents = t.parent[where]
    return np.bincount(parents[parents >= 0], minlength=len(t.kind))


def _pieces_with(t: Tokens, lists: np.ndarray, ends: str, having: np.ndarray) -> np.ndarray:
    """Whether each piece between commas directly in the brackets ``lists`` holds a marked token; true for empty pieces; per bracket the least."""
    inside = np.flatnonzero(np.isin(t.parent, lists) & ~_is(t.kind, ends))
    comma = np.isin(t.parent, lists) & _is(t.kind, ends)
    piece = np.cumsum(comma)[inside]
    key = t.parent[inside] * (len(t.kind) + 1) + piece
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    ok = np.zeros(len(first), bool)
    np.logical_or.at(ok, inverse, having[inside])
    out = np.ones(len(t.kind), bool)
    np.logical_and.at(out, t.parent[inside[first]], ok)
    return out


def productions(t: Tokens, language: str) -> Iterator[tuple[str, np.ndarray]]:
    """(fault, places) of the statement productions a language's tokens don't keep, as reductions over windows of a file's tokens."""
    k, w, at = t.kind, t.word, t.at
    before, after = t.back(at), t.on(at)
    prev, nxt, up = t.kinds(before), t.kinds(after), t.kinds(t.parent)
    one = {name: i for name, i in C.items()}
    starts = _is(prev, "EDGE SEMI")
    if language in ("js", "ts"):
        brace = k == one["LBRACE"]
        of_try = brace & (prev == one["BLOCK"]) & (t.words(before) == WORDS["try"])
        yield "try", of_try & (t.kinds(t.on(t.mate)) != one["CATCH"])
        block = brace & _is(prev, "EDGE SEMI RBRACE LBRACE RPAR ARROW BLOCK")
        label = (k == one["COLON"]) & (prev == one["STR"]) & (t.back(at, 2) == t.parent) & (t.parent >= 0) & block[np.maximum(t.parent, 0)]
        yield "label", label
        head, word = t.kinds(t.back(t.parent)), t.words(t.back(t.parent))
        loop = (word == WORDS["for"]) | (word == WORDS["await"])
        semi = k == one["SEMI"]
        yield "semicolon", semi & (up == one["LBRACK"]) | semi & (up == one["LPAR"]) & ~loop
        clauses = _count(t, semi)
        yield "clauses", (k == one["LPAR"]) & np.isin(t.words(before), [WORDS["for"], WORDS["await"]]) & (clauses != 0) & (clauses != 2) & (t.kinds(before) == one["HEAD"])
        yield "head", (k == one["LPAR"]) & (prev == one["HEAD"]) & (nxt == one["RPAR"])
        owner = t.before_mate(before)
        of_switch = brace & (prev == one["RPAR"]) & (t.words(owner) == WORDS["switch"]) & (t.kinds(owner) == one["HEAD"])
        yield "switch", of_switch & ~_is(nxt, "CASE RBRACE")
        in_switch = (t.parent >= 0) & of_switch[np.maximum(t.parent, 0)]
        yield "case", (k == one["CASE"]) & (w == WORDS["case"]) & ~in_switch & (nxt != one["LPAR"])
        opened = t.before_mate(before)
        of_call = (t.kinds(opened) == one["RPAR"]) & _is(t.kinds(t.before_mate(opened)), "IDENT FUNC")
        bare = _is(t.kinds(opened), "EDGE SEMI LBRACE RBRACE") & (t.mate[np.maximum(before, 0)] >= 0)
        otherwise = (k == one["BLOCK"]) & (w == WORDS["else"])
        yield "else", otherwise & (_is(prev, "EDGE LBRACE") | ~_is(prev, "RBRACE SEMI") & (t.line == 0) | (prev == one["RBRACE"]) & (of_call | bare))
        yield "catch", (k == one["CATCH"]) & (prev == one["EDGE"])
        yield "function", (k == one["FUNC"]) & starts & (nxt == one["LPAR"]) & (t.parent < 0)
        if language == "js":
            plain = (k == one["DECL"]) & (w == WORDS["const"]) & (nxt == one["IDENT"]) & (up != one["LPAR"])
            yield "initializer", plain & _is(t.kinds(t.on(after)), "SEMI RBRACE EDGE")
            yield "operand", flat(t, language) & _is(prev, "RPAR RBRACE") & _is(k, "IDENT NUM")
            headed = _is(t.kinds(owner), "HEAD CATCH") | (t.words(owner) == WORDS["await"])
            yield "operand", (prev == one["RPAR"]) & (t.line == 0) & _is(k, "IDENT NUM") & ~headed
            yield "colon", _unasked(t, np.ones(len(k), bool), _is(up, "LPAR LBRACK"))
            asked = _count(t, k == one["QUEST"]) - _count(t, k == one["COLON"])
            yield "question", _is(k, "LPAR LBRACK") & (asked > 0)
    elif language == "rust":
        name = t.back(at, 2)
        args = (k == one["LPAR"]) & (prev == one["IDENT"]) & (t.kinds(name) == one["FUNC"])
        generic = (k == one["LPAR"]) & (prev == one["GT"]) & (t.kinds(name) == one["IDENT"]) & (t.kinds(t.back(at, 3)) == one["LT"]) & (t.kinds(t.back(at, 5)) == one["FUNC"])
        fields = (k == one["LBRACE"]) & (prev == one["IDENT"]) & (t.words(name) == WORDS["struct"]) & (t.kinds(name) == one["CLASS"])
        typed = _is(k, "COLON MACRO SPREAD HASH") | (k == one["CONST"]) & (w == WORDS["self"])
        lists = args | generic | fields
        yield "parameters", lists & ~_pieces_with(t, np.flatnonzero(lists), "COMMA", typed)
        yield "semicolon", (k == one["SEMI"]) & (up == one["LPAR"]) & (t.kinds(t.back(t.parent)) == one["IDENT"]) & ~np.isin(t.parent, t.parent[k == one["MACRO"]])
        yield "else", (k == one["BLOCK"]) & (w == WORDS["else"]) & _is(prev, "EDGE SEMI LBRACE")
    else:
        yield "else", ((k == one["BLOCK"]) & (w == WORDS["else"]) | (k == one["HEAD"]) & (w == WORDS["elsif"])) & (prev != one["RBRACE"]) & (nxt != one["ARROW"])
        asks = np.isin(w, [WORDS[x] for x in ("if", "unless", "while", "until")]) & (k == one["HEAD"])
        yield "head", asks & starts & ~_is(nxt, "LPAR ARROW")
        label = (prev == one["IDENT"]) & _is(t.kinds(t.back(at, 2)), "EDGE SEMI LBRACE RBRACE")
        yield "colon", _unasked(t, ~label, _is(prev, "STR NUM RPAR RBRACK RBRACE VAR REGEX"))


def _unasked(t: Tokens, counts: np.ndarray, faulty: np.ndarray) -> np.ndarray:
    """Colons that no question mark of the same bracket and statement asks for, among those where that is a fault."""
    ask, answer = t.kind == C["QUEST"], (t.kind == C["COLON"]) & counts
    some = np.flatnonzero(ask | answer | (t.kind == C["SEMI"]))
    some = some[np.lexsort((some, t.parent[some], t.file[some]))]
    part = np.cumsum((t.kind[some] == C["SEMI"]) | np.concatenate([[True], (t.parent[some][1:] != t.parent[some][:-1]) | (t.file[some][1:] != t.file[some][:-1])])) if len(some) else some
    step = ask[some].astype(np.int64) - answer[some]
    run = np.cumsum(step)
    new = np.concatenate([[True], part[1:] != part[:-1]]) if len(some) else np.empty(0, bool)
    base = np.concatenate([[0], run[:-1]])[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))] if len(some) else run
    out = np.zeros(len(t.kind), bool)
    out[some] = (run - base < 0) & answer[some]
    return out & faulty


def flat(t: Tokens, language: str) -> np.ndarray:
    """Tokens that lie directly where no statement can end: in parentheses, in square brackets and, in JavaScript, in object literals."""
    up = t.kinds(t.parent)
    out = _is(up, "LPAR LBRACK")
    if language == "js":
        out |= (up == C["LBRACE"]) & _is(t.kinds(t.back(t.parent)), "ASSIGN LPAR LBRACK COMMA RETURN BIN QUEST INFIX SPREAD")
    return out


def reduce_tokens(texts: list[str], language: str) -> tuple[list[list[int]], list[str | None]]:
    """For each text the distinct codes of adjacent class pairs (a line end counts where a statement can end) and its first fault, if any.

    Tokens of all texts are columns; nesting and productions are reductions over windows partitioned by file.
    """
    kinds, lines, words, faults = zip(*(lex(text, language) for text in texts)) if texts else ((), (), (), ())
    sizes = np.array([len(x) for x in kinds], np.int64)
    column = lambda parts, kind: np.fromiter((x for part in parts for x in part), kind, int(sizes.sum()))
    t = Tokens(np.repeat(np.arange(len(sizes)), sizes), column(kinds, np.int64), column(lines, np.int64), column(words, np.int64))
    out: list[str | None] = list(faults)
    if len(t.kind):
        last = np.cumsum(sizes) - 1
        found = [("nesting", t.below | t.crossed)]
        unclosed = np.zeros(len(t.kind), bool)
        unclosed[last[sizes > 0]] = t.left[last[sizes > 0]] > 0
        found.append(("end", unclosed))
        clean = np.ones(len(sizes), bool)
        for name, places in [*found, *productions(t, language)]:
            for f in np.unique(t.file[places & clean[t.file]]).tolist():
                out[f] = out[f] or name
                clean[f] = False
    line = t.line & ~flat(t, language) if language in ("js", "ts") else t.line
    code = (t.kinds(t.back(t.at)) * N + t.kind) * 2 + line
    ends = np.flatnonzero(np.concatenate([t.file[1:] != t.file[:-1], [True]])) if len(t.kind) else t.at
    every = np.unique(np.concatenate([t.file * (2 * N * N) + code, t.file[ends] * (2 * N * N) + t.kind[ends] * N * 2 + 1]))
    bounds = np.searchsorted(every, np.arange(len(sizes) + 1) * (2 * N * N))
    return [(every[a:b] % (2 * N * N)).tolist() for a, b in zip(bounds, bounds[1:])], out


def reduced(text: str, language: str) -> tuple[list[int], str | None]:
    """(pair codes, fault) of one text that isn't Python."""
    codes, faults = reduce_tokens([text], language)
    return codes[0], faults[0]


def python_fault(text: str) -> str | None:
    """What the grammar of Python 3.12 has against a text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text, feature_version=(3, 12))
    except (SyntaxError, ValueError):
        return "production"
    except (RecursionError, MemoryError):
        return None
    return None


DIALECTS = {"javascript": "js", "typescript": "ts", "rust": "rust", "perl": "perl"}
LEXED = "file_id BIGINT, repo STRING, path STRING, language STRING, dialect STRING, fault STRING, codes ARRAY<INT>"


def lexed(files: DataFrame) -> DataFrame:
    """One row per row of a file of the five languages with content that isn't blank: its fault and its pair codes."""
    language = language_of(F.col("path"))
    repo = F.coalesce("repo", F.substring_index("path", "/", 2))
    rows = files.select("file_id", repo.alias("repo"), "path", language.alias("language"), "content").filter("language IS NOT NULL AND content IS NOT NULL AND trim(content) <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [x.removeprefix("\ufeff") for x in batch.column(4).to_pylist()]
                dialects = [DIALECTS.get(x) for x in batch.column(3).to_pylist()]
                faults: list[str | None] = [None] * len(texts)
                codes: list[list[int]] = [[] for _ in texts]
                for dialect in sorted({d or "" for d in dialects}):
                    own = [i for i, d in enumerate(dialects) if (d or "") == dialect]
                    got = reduce_tokens([texts[i] for i in own], dialect) if dialect else ([[]] * len(own), [python_fault(texts[i]) for i in own])
                    for i, c, f in zip(own, *got):
                        codes[i], faults[i] = c, f
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(dialects, pa.string()), pa.array(faults, pa.string()), pa.array(codes, pa.list_(pa.int32()))], names=["file_id", "repo", "path", "language", "dialect", "fault", "codes"])

    return rows.mapInArrow(run, LEXED)


def permitted_pairs(spark) -> DataFrame:
    """(dialect, code) of every permitted pair: a few thousand rows, fixed by the grammars."""
    return spark.createDataFrame([(k, (a * N + b) * 2 + line) for k in DIALECTS.values() for a, b, line in sorted(permitted(k))], "dialect STRING, code INT")


def _coded(files: DataFrame) -> DataFrame:
    """A row per file and pair; a code no grammar permits stands for a fault, so a file is lexed once."""
    dialect = F.coalesce("dialect", F.lit("python"))
    codes = F.when(F.col("fault").isNotNull(), F.array(F.lit(-1))).otherwise(F.col("codes"))
    return lexed(files).select("file_id", "repo", "path", "language", dialect.alias("dialect"), F.coalesce("fault", F.lit("pair")).alias("fault"), F.explode_outer(codes).alias("code"))


def invalid(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, language, fault) of the files that aren't valid in their path's language; one row a file.

    Null, blank and comment-only content is no case; other suffixes aren't looked at; repeats count once.
    """
    wrong = _coded(files).filter("code IS NOT NULL").join(F.broadcast(permitted_pairs(files.sparkSession)), ["dialect", "code"], "left_anti")
    return wrong.groupBy("file_id").agg(F.min(F.struct("repo", "path", "language", "fault")).alias("r")).select("file_id", "r.*")


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_invalid, rate): over the files of the five languages with readable, not blank content, in one pass over them."""
    known = permitted_pairs(files.sparkSession).withColumn("permitted", F.lit(True))
    bad = F.col("code").isNotNull() & F.col("permitted").isNull()
    judged = _coded(files).join(F.broadcast(known), ["dialect", "code"], "left").groupBy("file_id").agg(F.max(F.struct("repo", "language")).alias("r"), F.max(bad.cast("int")).alias("bad"))
    return judged.groupBy("r.repo", "r.language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bad").alias("n_invalid"), F.avg("bad").alias("rate"))

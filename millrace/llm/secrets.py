"""Problem 5: credentials in source text, found through layers of encoding and blanked out in place."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prefixes and forms of issued tokens, as their issuers document them.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[oprsu]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[0-9A-Za-z-]{16,}|A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?:sk|rk)_(?:live|prod|test)_[0-9A-Za-z]{16,}|[a-z]{2,4}-[0-9A-Za-z]{20}\.[0-9A-Za-z]{8,}|AIza[\w-]{35}|npm_[0-9A-Za-z]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{16,})"
)
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,20} ){0,4})PRIVATE KEY( BLOCK)?-----")
COMMENTED = re.compile(r"^\s*(#+!?|//+!?|/?\*+!?|--+|;+|%+|>+|!+|')\s*$")
# Words for a secret in names, and words that make such a name mean something else.
SECRET = re.compile(r"(?i)pass(?:w(?:or)?d|phrase|code)?|pwd|secret|token|(?:api|access|signing|hmac|private|master|encryption|account|shared|auth)[_-]?key|bearer|cred(?:ential)?s?|phrase|auth(?![a-z])|authorization")
OTHER = re.compile(r"(?i)(?:public|kind|field|type|label|name|hint|count|length|policy|regex|pattern|selector|column|_id\b|url|path|file|digest|hash|checksum|integrity|sha\d|etag|commit|uuid|fingerprint|format|prefix|header_name|limit|expir|ttl)")
PLACEHOLDER = re.compile(
    r"(?i)^(?:\W*|change[-_ ]?(?:me|it)|todo|fixme|replace[-_ ]?(?:me|this)|redacted|removed|hidden|none|null|nil|undef(?:ined)?|true|false|x{3,}|(.)\1*|<.*>|\[.*\]|\{.*\}|%\w|%\(.*\).|\$\w+|\$\{.*\}|\$\(.*\)|#\{.*\}|\{\{.*\}\}|@\w+@"
    r"|.*(?:your[-_ ]|example|placeholder|dummy|xxxx|\*\*\*|insert[-_ ]|set[-_ ]in|vault|env\b|environ|getenv|secrets?manager).*|.*\.\.\.|test|foo|bar|secret|password|token|key)$"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
HOST = re.compile(r"^(?:[a-z]+://)?[\w-]+(?:\.[a-z][\w-]*)+(?::\d+)?(?:/\S*)?$")
LITERAL = re.compile(r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`", re.S)
JOIN = re.compile(r"(?:\.to_(?:string|owned)\(\)|\.into\(\))?\s*+(?:\+\s*+&?|\.|\\|,(?=[^\S\n]*+\n))?\s*+(?:\\\n)?\s*+$")
BEFORE = re.compile(r"([A-Za-z_$@%][\w$.\-]*)[\"'`]?\]?\s*(?::\s*&?[\w<>&'\[\]| ]{1,40}?)?\s*(?:=>|:=|\?\?=|=|:|\bwas\b|\bis\b)\s*(?:String::from\(|concat!\(|\()?\s*[rbfuRBFU]{0,2}#*$")
PAIR = re.compile(r"[\"'`]([\w.\-]+)[\"'`]\s*,\s*[rbf]?$")
CALL = re.compile(r"([\w$]+)!?\(([^()]*)$")
OPENS = re.compile(r"(?i)connect|client|login|sign_?in|authenticate|open_?session|credential")
DECODES = re.compile(r"(?i)decode|atob|b64|base64|fromhex|unhex|unescape|unquote")
URL = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*+://([^\s:/@\"'`<>]*+):([^\s@\"'`/]++)@[\w\[{$]")
CONN = re.compile(r"(?i)(?:^|[;\"'`\s])(?:pwd|password)=([^;\"'`\s]+)(?=;)|;(?:pwd|password)=([^;\"'`\s]+)")
HEADER = re.compile(r"(?i)\b(bearer|basic|token)[ :]+([A-Za-z0-9+/=_\-.]{8,})")
LOOSE = re.compile(
    r"(?i)(?:\s-u|--user)[ =]+[\"']?[\w.\-]+:([^\s\"']+)|\b(?:login|log in|credentials?|account)\b[^\n]{0,60}?[:=]\s*[\w.\-]+\s*/\s*([^\s\"'`]+)"
    r"|(?<![\w\-])([\w\-]{0,40}?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|cred|bearer|phrase)[\w\-]{0,40})\s+(?:was|is|=|:)\s+[\"'`]?([^\s\"'`,]+)"
)
BARE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*[=:][ \t]*([^\s\"'`#;{\[(][^\s]*)[ \t\r]*$")
CONFIG = (".env", ".ini", ".cfg", ".conf", ".properties", ".yaml", ".yml", ".toml", ".json")
COMMENT = re.compile(r"(?:^|\s)(?:#|//|/\*|\*|--|;)")
# What a line must hold, in lower case, to be looked at.
TRIGGERS = ["pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "basic ", "phrase", "connect", "client", "login", "sign_in", "signin", "session(", "decode", "atob", "b64", "unhex", "fromhex", "unescape", "unquote", "://", "curl",
            "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "xox", "akia", "asia", "sk_", "rk_", "tsk-", "aiza", "npm_", "eyj", "\\x", "\\u", "%7", "%6"]
# What makes a line one to look at without any of these: literals in the forms layers() decodes, and short parts that are joined on.
ENCODED = re.compile(r"[\"'`](?:[A-Za-z0-9+/_\-]{12,}+={0,2}[\"'`]|[A-Za-z0-9+/_\-]{1,11}={0,2}[\"'`]\s*+[+.\\\"'`])|%[0-9A-Fa-f]{2}|\\[^\s\"'`ntr0]")
BARE_ENCODED = re.compile(ENCODED.pattern + r"|[=:][ \t]*+[A-Za-z0-9+/_\-]{12,}+={0,2}[ \t\r,]*+$", re.M)
# A percent sign or backslash encoded again and again is one layer, so the number of layers is at most logarithmic in a text's length.
NESTED_PERCENT = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
NESTED_ESCAPE = re.compile(r"\\(?:x5[cC]|u005[cC])+(?=[xu])")
_TEXT = set(range(32, 127)) | {9, 10, 13}


def _automaton():
    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, len(t))
    a.make_automaton()
    return a


_TRIGGER = None


def escapes(value: str) -> str:
    """The value a literal with backslash escapes stands for."""
    if "\\" not in value:
        return value
    known = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else ""
        return known.get(m[4], m[4])

    return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u\{?([0-9A-Fa-f]{4,6})\}?|x\{([0-9A-Fa-f]{1,6})\}|(.))", one, value, flags=re.S)


def _der(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(tag, start, end) of the values that fill ``raw[at:end]`` by the grammar of DER; the last has tag -1 where one doesn't fit."""
    while at < end:
        if at + 2 > end:
            yield -1, at, end
            return
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                yield -1, at, end
                return
            n, at = int.from_bytes(raw[at : at + k]), at + k
        if at + n > end:
            yield -1, at, end
            return
        yield tag, at, at + n
        at += n


def der_sequence(raw: bytes) -> bool:
    """Whether the bytes are one DER SEQUENCE whose length fits and whose first field is an INTEGER, as private keys are."""
    whole = list(_der(raw, 0, len(raw))) if len(raw) >= 8 and raw[0] == 0x30 else []
    return len(whole) == 1 and whole[0][0] == 0x30 and next(_der(raw, *whole[0][1:]), (0,))[0] == 0x02


def openssh(raw: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic, cipher, kdf and its options, the number of keys, public and private parts to the end."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at + 4 <= len(raw):
        n = int.from_bytes(raw[at : at + 4])
        if n == 0 and fields != 2:  # only the options may be empty
            return False
        # the number of keys stands between the options and the parts
        at, fields = at + 4 + (n if fields != 3 else 0), fields + 1
    return fields >= 6 and at == len(raw)


def key_container(raw: bytes) -> bool:
    """Whether the bytes are a private key by their grammar, read to the end: OpenSSH, or DER as PKCS#8 (plain or encrypted), PKCS#1, DSA and SEC1 have it."""
    if openssh(raw):
        return True
    whole = list(_der(raw, 0, len(raw))) if len(raw) >= 8 and raw[0] == 0x30 else []
    if len(whole) != 1:
        return False
    parts = list(_der(raw, *whole[0][1:]))
    tags = [t for t, _, _ in parts]
    if -1 in tags or not tags:
        return False
    if tags == [0x30, 0x04]:  # encrypted: an algorithm with its parameters, and octets
        inner = [t for t, _, _ in _der(raw, *parts[0][1:])]
        return inner == [0x06, 0x30] and parts[1][2] - parts[1][1] >= 32
    version = raw[parts[0][1]] if tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 else -1
    if version not in (0, 1):
        return False
    if tags[1:3] == [0x30, 0x04]:
        return next(_der(raw, *parts[1][1:]), (0,))[0] == 0x06
    return (len(tags) >= 6 and set(tags[:6]) == {0x02}) or (version == 1 and tags[1:2] == [0x04] and parts[1][2] - parts[1][1] >= 16)


def private_key(kind: str, body: str, sign: str = "") -> bool:
    """Whether an armoured body holds key material: a container by its grammar, or base64 of high entropy.

    The armour itself says what the body is, so bytes that are no container (a format unknown here, or one cut short) still count where
    they can't be a placeholder or text; without armour the grammar alone decides (``key_container``). ``sign`` is the comment sign before the BEGIN line, if any; it is taken off each line of the body.
    """
    signs = ("*",) if sign.startswith("/*") else (sign,)
    lines = [x.strip() for x in escapes(body).splitlines()]
    lines = [next((x.removeprefix(c) for c in signs if c and x.startswith(c)), x).strip().strip("\"'+\\,.") for x in lines]
    packed = "".join(x.replace(" ", "") for x in lines if x and ":" not in x and not (kind.startswith("PGP ") and re.fullmatch(r"=[A-Za-z0-9+/]{1,4}", x)))
    if not re.fullmatch(r"[A-Za-z0-9+/]{32,}={0,2}", packed):
        return False
    try:
        raw = base64.b64decode(packed + "=" * (-len(packed) % 4), validate=True)
    except binascii.Error:
        return len(set(packed)) > 16
    return key_container(raw) or (len(set(raw)) > 16 and not set(raw) <= _TEXT)


def armoured(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private keys between their BEGIN and END lines; a BEGIN before the END opens anew."""
    ends: dict[str, int] = {}
    for m in ARMOUR.finditer(text):
        close = f"-----END {m[1]}PRIVATE KEY{m[2] or ''}-----"
        if ends.get(close, 0) >= 0 and ends.get(close, 0) <= m.end():
            ends[close] = text.find(close, m.end())
        end = ends[close]
        again = text.find("-----BEGIN ", m.end(), end) if end >= 0 else 0
        before = COMMENTED.match(text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - 100) : m.start()])
        if end >= 0 and again < 0 and private_key(m[1], text[m.end() : end], before[1] if before else ""):
            yield m.start(), end + len(close)


def binaries(value: str) -> Iterator[bytes]:
    """The bytes that hex and base64 stand for."""
    if len(value) >= 16 and len(value) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", value):
        yield bytes.fromhex(value)
    if len(value) >= 12 and re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", value):
        core = value.rstrip("=").replace("-", "+").replace("_", "/")
        if len(core) % 4 != 1:
            yield base64.b64decode(core + "=" * (-len(core) % 4))


def layers(value: str) -> Iterator[str]:
    """What a value decodes to in one step: percent, escapes, base64 and hex, where the result is text."""
    if "%" in value and (v := unquote(NESTED_PERCENT.sub("%", value))) != value:
        yield v
    if "\\" in value and (v := escapes(NESTED_ESCAPE.sub(r"\\", value))) != value:
        yield v
    for raw in binaries(value):
        if set(raw) <= _TEXT:
            yield raw.decode()


def shaped(value: str) -> bool:
    """Whether a value could be a password or key by its form: no placeholder, name, host, id or plain word."""
    if len(value) < 8 or any(c.isspace() for c in value) or PLACEHOLDER.match(value) or UUID.match(value) or HOST.match(value) or value.startswith(("sha256-", "sha384-", "sha512-", "/", "./", "#", "http")):
        return False
    digits = sum(c.isdigit() for c in value)
    lower, upper = any(c.islower() for c in value), any(c.isupper() for c in value)
    symbols = sum(not c.isalnum() for c in value)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return len(value) >= 16 and digits > 1
    if digits >= 2 and (lower or upper) and (lower and upper or symbols or len(value) >= 16):
        return not re.fullmatch(r"[a-z]+[-_.]?\d{1,4}|[\d.:/\-]+", value)
    return len(value) >= 20 and lower and upper and (digits or not symbols) and len(set(value)) >= 14 and not re.fullmatch(r"(?:[A-Z]?[a-z]++)++", value)


def usable(value: str, named: bool, decoding: bool = False, depth: int = 0) -> bool:
    """Whether a value, or what it decodes to over any number of layers, is a credential; every layer is shorter than the one before."""
    if any(map(key_container, binaries(value))):
        return True
    if len(value) <= 4096 and PLACEHOLDER.match(value):
        return False
    if (m := ISSUED.search(value)) and not PLACEHOLDER.match(m[0]):
        return True
    if "PRIVATE KEY" in value and next(armoured(value), None):
        return True
    for m in URL.finditer(value):
        if usable(unquote(m[2]), True, depth=depth + 1):
            return True
    if named and shaped(value):
        return True
    if decoding and depth and ":" in value and not value.startswith("{"):
        user, _, rest = value.partition(":")
        if re.fullmatch(r"[\w.\-@]+", user) and shaped(rest):
            return True
    return any(usable(v, named, decoding, depth + 1) for v in layers(value))


def _login(value: str) -> bool:
    """Whether a Basic header's value decodes to a user and a password that isn't a placeholder."""
    return any(re.fullmatch(r"[\w.\-@]+:\S{6,}", v) and not PLACEHOLDER.match(v.partition(":")[2]) for v in layers(value))


def _names(name: str) -> bool:
    """Whether a name is that of a secret: the last secret word in it isn't turned into something else by the words around it."""
    return bool(SECRET.search(name)) and not OTHER.search(name)


_BLANKS = re.compile(r"\s*+")


def _before(line: str, start: int, least: int = 400) -> str:
    """What stands before a literal: at least ``least`` characters, blanks between words counted as one, and no name cut in two."""
    out, size, at = [], 0, start
    while at > 0 and size < least:
        k = at
        while k > 0 and at - k < least and not line[k - 1].isspace():
            k -= 1
        if k < at:
            out.append(line[k:at])
            size += at - k
            at = k
            continue
        while k > 0 and line[k - 1].isspace():
            k -= 1
        out.append(" ")
        size += 1
        at = k
    while at > 0 and size < 8 * least and (line[at - 1].isalnum() or line[at - 1] in "_$.-"):
        k = at - 1
        out.append(line[k:at])
        size, at = size + 1, k
    return "".join(reversed(out))


def _logical(text: str, start: int, config: bool) -> int:
    """End of the line at ``start``, with those after it that go on with the same literal; a bare value's padding doesn't."""
    at, last, concat, depth, opened, ahead = start, "", False, 0, False, -1
    while True:
        end = text.find("\n", at)
        if end < 0:
            return len(text)
        line = text[at:end].rstrip()
        if line:  # of the lines so far only this is needed: the newest that isn't blank, and what is open before it
            last = line
            if (k := line.rfind("(")) >= 0:
                opened = ")" not in line[k:]
            elif ")" in line:
                opened = False
            if concat := concat or "concat" in line:
                code = LITERAL.sub("", line)
                depth += code.count("(") - code.count(")")
        if ahead <= end:  # the next character that isn't blank
            ahead = _BLANKS.match(text, end + 1).end()
        tail = text[ahead : ahead + 1]
        k = _BLANKS.match(text, ahead + 1).end() if tail and tail in "+." else len(text)
        then = text[k : k + 1]
        goes_on = last.endswith(("+", "(", "\\", "\" .", "' .", "=>")) or (last.endswith("=") and not config)
        goes_on = goes_on or (concat and depth > 0 and last.endswith((",", "\"", "'"))) or (then and then in "\"'`")
        if not goes_on and not (opened and last.endswith(("\"", "'")) and tail in ("\"", "'")):
            return end
        at = end + 1


def _line(line: str, config: bool) -> Iterator[tuple[int, int]]:
    """Spans of credentials in one logical line; later parts of a value come with a start below zero, as ~start."""
    groups: list[list] = []
    for m in LITERAL.finditer(line):
        q = 3 if m[0].startswith('"""') else 1
        part = (m.start() + q, m.end() - q)
        if groups and JOIN.match(line[groups[-1][2] : m.start()]) and (groups[-1][2] < m.start() or q == 1) and re.search(r"[+.\\\n]", line[groups[-1][2] : m.start()]):
            groups[-1][0].append(part)
            groups[-1][2] = m.end()
        else:
            groups.append([[part], m.start(), m.end()])
    for parts, start, _ in groups:
        value = escapes("".join(line[a:b] for a, b in parts))
        if len(value) < 8:
            continue
        before = _before(line, start)
        name = (m := BEFORE.search(before)) and m[1] or ""
        call = (m := CALL.search(before)) and m[1] or ""
        if not name and not OPENS.search(call) and (m := PAIR.search(before)):
            name = m[1]
        named = _names(name) if name else bool(OPENS.search(call))
        if name and not named and OTHER.search(name):
            if not ISSUED.search(value):
                continue
        inner = [m.span(2) for m in URL.finditer(value) if usable(unquote(m[2]), True)] + [m.span(1) if m[1] else m.span(2) for m in CONN.finditer(value) if usable(m[1] or m[2], True)]
        inner += [m.span(2) for m in HEADER.finditer(value) if (_login(m[2]) if m[1].lower() == "basic" else usable(m[2], True))]
        hit = bool(inner) or usable(value, named and "://" not in value and ";" not in value and " " not in value, bool(DECODES.search(call)) or named)
        if hit:
            if inner and len(parts) == 1 and "\\" not in line[parts[0][0] : parts[0][1]]:
                yield from ((parts[0][0] + a, parts[0][0] + b) for a, b in inner)
            else:
                yield parts[0]
                yield from ((~a, b) for a, b in parts[1:])
    sign = COMMENT.search(line)
    for m in LOOSE.finditer(line):
        k = next(i for i in (1, 2, 4) if m[i])
        value = m[k].rstrip(",.;)")
        commented = sign and sign.end() <= m.start(k) or line.lstrip().startswith(("#", "//", "*", "--", ";"))
        if (k == 1 or commented) and (k != 4 or _names(m[3])) and usable(value, True):
            yield m.start(k), m.start(k) + len(value)
    if config and (m := BARE.match(line)):
        value = m[2].rstrip(",")
        urls = list(URL.finditer(value))
        if urls:
            yield from ((m.start(2) + u.start(2), m.start(2) + u.end(2)) for u in urls if usable(unquote(u[2]), True))
        elif usable(value, _names(m[1])):
            yield m.start(2), m.start(2) + len(value)
    for m in ISSUED.finditer(line):
        if not PLACEHOLDER.match(m[0]):
            yield m.span()
    for m in URL.finditer(line):
        if usable(unquote(m[2]), True):
            yield m.span(2)


def credentials(text: str | None, path: str | None = None) -> list[tuple[int, int, bool]]:
    """Merged (start, end, begins) of the credentials of a text, in order; none for null and empty texts.

    ``begins`` is false for the later parts of a value put together from several literals.
    """
    global _TRIGGER
    if not text:
        return []
    _TRIGGER = _TRIGGER or _automaton()
    spans: list[tuple[int, int, bool]] = []
    spans += [(a, b, True) for a, b in (armoured(text) if "PRIVATE KEY" in text else ())]
    low = text.lower()
    if len(low) != len(text):  # some letters grow in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    config = (path or "").lower().endswith(CONFIG) or not re.search(r"\.\w+$", path or "")
    done = -1
    encoded = (m.start() for m in (BARE_ENCODED if config else ENCODED).finditer(text))
    for at in merge((at for at, _ in _TRIGGER.iter(low)), encoded):
        if at < done:
            continue
        start = text.rfind("\n", 0, at) + 1
        while start > 0 and not config:  # a value may begin on the line after its name
            back = text.rfind("\n", 0, start - 1) + 1
            if start <= done or not text[back : start - 1].rstrip().endswith(("=", "(", "+")):
                break
            start = back
        start = max(start, done)
        end = _logical(text, start, config)
        spans.extend((start + (a if a >= 0 else ~a), start + b, a >= 0) for a, b in _line(text[start:end], config))
        done = end + 1
    out: list[tuple[int, int, bool]] = []
    later = {a for a, _, begins in spans if not begins}
    for a, b, begins in sorted(spans):
        begins = begins and a not in later
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        elif a < b:
            out.append((a, b, begins))
    return out


def blank(text: str, spans: list[tuple[int, int, bool]], sign: str = "*") -> str:
    """The text with each span overwritten, its line ends kept, so lines, columns and quotes stay as they are."""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at:a])
        out.append(re.sub(r"[^\r\n]", sign, text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


FOUND = "holder STRING, holder_id STRING, path STRING, line_nos ARRAY<BIGINT>, redacted STRING"


def holders(files: DataFrame, cases: DataFrame) -> DataFrame:
    """(holder, holder_id, path, text) of every file and every document of every case; null texts are left out."""
    own = files.select(F.lit("file").alias("holder"), F.col("file_id").cast("string").alias("holder_id"), "path", F.col("content").alias("text"))
    docs = cases.select(F.lit("case").alias("holder"), F.col("case_id").alias("holder_id"), F.explode("evidence.source_documents").alias("path", "text"))
    return own.unionByName(docs).filter("text IS NOT NULL AND text <> ''")


def scan(texts: DataFrame, redact: bool = False) -> DataFrame:
    """(holder, holder_id, path, line_nos, redacted) of each text with a credential; ``redacted`` only where asked for.

    A narrow map; a text is read whole. Repeats give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holder, ids, paths, bodies = (batch.column(i) for i in range(4))
            out = []
            for i in range(batch.num_rows):
                text, path = bodies[i].as_py(), paths[i].as_py()
                spans = credentials(text, path)
                if spans:
                    ends = [m.start() for m in re.finditer("\n", text)]
                    lines = sorted({bisect_right(ends, a - 1) + 1 for a, _, begins in spans if begins})
                    out.append((holder[i].as_py(), ids[i].as_py(), path, lines, blank(text, spans) if redact else None))
            cols = list(zip(*out)) or [[], [], [], [], []]
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["holder", "holder_id", "path", "line_nos", "redacted"])

    return texts.select("holder", "holder_id", "path", "text").mapInArrow(run, FOUND)


def credential_lines(files: DataFrame, cases: DataFrame) -> DataFrame:
    """(holder, holder_id, path, line_no): one row per line on which a credential begins; repeated rows count once."""
    return scan(holders(files, cases)).select("holder", "holder_id", "path", F.explode("line_nos").alias("line_no")).distinct()


def redacted_texts(files: DataFrame, cases: DataFrame) -> DataFrame:
    """(holder, holder_id, path, n_lines, redacted) of each text with a credential; repeated rows count once."""
    return scan(holders(files, cases), redact=True).select("holder", "holder_id", "path", F.size("line_nos").alias("n_lines"), "redacted").distinct()

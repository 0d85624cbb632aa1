"""Secrets in texts: fixed patterns, and literals that are assigned to sensitive names.

The patterns (kinds ``assign access hex``) run over the UTF-8 bytes. The method lexes source and
configuration syntax around every ``=``, ``:``, ``:=`` and ``=>`` into pairs of a name and a value
(quoted strings, also joined by ``+``; bare words; other names), follows names to the literal they
stand for, and scores each literal by the name that it ends up in and by its own randomness. A literal
of at least ``THRESHOLD`` is a span of kind ``literal``, unless a pattern covers it already. Names of
secrets that people choose need no randomness: any quoted literal of 6 characters that is no placeholder
counts. Other names never take a literal with an inner space (but for ``Bearer`` and the like before it)
or of a single class of characters. A quoted literal that is not itself a span is lexed in turn, without its
escapes and with names of its own (connection strings, embedded JSON).

A null text is empty, an empty table gives an empty result, columns other than doc_id and text are not returned.
Each row is judged alone: repeats and ties need no rule. Positions are in code points. Every operator is looked at once. Chains share what they have in common; only one that runs into
its own pairs again, in a text where it can still reach a literal, is followed for itself, at most once
through each pair.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import Reach, text_slices
from reelflow.llm.pii import code_points, written

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")
THRESHOLD = 0.6

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_WORDS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")

#: How telling a part of a name is. Fixed values.
NAME_PARTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.75, "bearer": 0.8, "private": 0.6, "signing": 0.6, "encryption": 0.6, "key": 0.6, "salt": 0.75, "pin": 0.75, "dsn": 0.75, "cookie": 0.75}
#: Names of what people choose: any literal counts, however little random. Of a ``pin`` any digits do.
CHOSEN = frozenset(("password", "passwd", "passphrase", "pwd", "secret", "credential", "credentials"))
#: Parts that make a ``key`` a secret.
KEY_PREFIXES = frozenset(("api", "access", "private", "secret", "signing", "encryption", "auth", "master", "service", "account"))
#: Names and values that are not secrets.
HARMLESS_NAMES = frozenset(("id", "name", "url", "uri", "path", "file", "type", "length", "count", "field", "label", "hint", "policy", "expires", "ttl"))
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|0+|none|null|nil|true|false|changeme|change_me|example.*|your[_-].*|my[_-].*|todo|test|dummy|sample.*|placeholder.*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$[A-Za-z_].*)$")

#: What stands before a token in a header.
_SCHEME = re.compile(r"(?i)^(?:bearer|basic|token) +")

_OPERATOR = re.compile(rb":=|=>|==+|[:=]")
_NAME = re.compile(rb"[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*")
_NAME_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
#: A bare value has no operator inside, so no part of a text is read for more than one name; base64 may end in two.
_BARE = re.compile(rb"[A-Za-z0-9+/_.~!@#%^&*-]{6,}={0,2}")
_GAP = re.compile(rb"[ \t]*")
_PLUS = re.compile(rb"[ \t]*\+[ \t]*(?=[\"'])")
#: Escapes that stand for themselves without the backslash, and all.
_SELF = {b"\\\\": 92, b'\\"': 34, b"\\'": 39, b"\\/": 47}
_ESCAPES = _SELF | {b"\\n": 10, b"\\r": 13, b"\\t": 9}
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int]
#: name, end of the operator, spans of the literal's pieces, the name it refers to
Pair = tuple[str, int, list[tuple[int, int]], str | None]


def base_spans(text: bytes) -> list[Span]:
    """Byte spans of the fixed patterns, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _name_before(text: bytes, at: int) -> str | None:
    """The name that ends before ``at``, past blanks, a closing quote and bracket."""
    end = at
    while end > 0 and text[end - 1] in b" \t":
        end -= 1
    while end > 0 and text[end - 1] in b"\"']":
        end -= 1
    start = end
    while start > 0 and text[start - 1] in _NAME_BYTES:
        start -= 1
    name = text[start:end].strip(b".-").decode()
    return name if name and not name[0].isdigit() else None


def _quoted(text: bytes, at: int) -> int | None:
    """End of the string whose opening quote stands at ``at``; None if its line ends first."""
    quote, i = text[at], at + 1
    stop = text.find(b"\n", i)
    stop = len(text) if stop < 0 else stop
    while i < stop:
        if text[i] == 92:
            i += 2
        elif text[i] == quote:
            return i
        else:
            i += 1
    return None


def pairs(text: bytes) -> list[Pair]:
    """Names and the values assigned to them, in order."""
    out: list[Pair] = []
    done = 0
    for m in _OPERATOR.finditer(text):
        if m.start() < done or len(m.group()) > 1 and m.group().startswith(b"=="):
            continue
        name = _name_before(text, m.start())
        if name is None:
            continue
        at = _GAP.match(text, m.end()).end()
        pieces: list[tuple[int, int]] = []
        while at < len(text) and text[at] in b"\"'":
            end = _quoted(text, at)
            if end is None:
                break
            pieces.append((at + 1, end))
            done = end + 1
            more = _PLUS.match(text, done)
            if not more:
                break
            at = more.end()
        other = None
        if not pieces:
            ref = _NAME.match(text, at)
            bare = _BARE.match(text, at)
            if bare and (not ref or bare.end() > ref.end() or any(48 <= c <= 57 for c in bare.group())):
                pieces = [(at, at + len(bare.group().rstrip(b".,!")))]
            if ref:
                other = ref.group().decode()
        if pieces or other:
            out.append((name, m.end(), pieces, other))
    return out


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _CAMEL.findall(name)]


def name_score(name: str) -> float:
    """0 to 1: how surely a thing of this name is a secret."""
    parts = _parts(name)
    if not parts or parts[-1] in HARMLESS_NAMES:
        return 0.0
    best = max(NAME_PARTS.get(p, 0.0) for p in parts)
    joined = "".join(parts)
    if "apikey" in joined or parts[-1] == "key" and KEY_PREFIXES & {*parts}:
        best = 1.0
    return best


def _blank(value: str) -> bool:
    return len(value) < 6 or bool(PLACEHOLDERS.match(value))


def literal_score(value: str) -> float:
    """0 to 1: how random a literal looks; 0 for placeholders and for fewer than 6 characters."""
    value = _SCHEME.sub("", value)
    if _blank(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    spread = min(1.0, entropy / min(4.0, math.log2(n)))
    return spread * (0.55 if kinds == 1 else 0.85 if kinds == 2 else 1.0) * (0.5 if " " in value.strip() else 1.0)


def score(name: str, value: str, quoted: bool) -> float:
    """0 to 1: how surely ``value`` is a secret that ``name`` holds. A bare word of letters may be prose and is never taken as chosen."""
    weight = name_score(name)
    parts = {*_parts(name)}
    if (parts & CHOSEN and (quoted or not value.isalpha()) or "pin" in parts and value.isdigit()) and not _blank(value):
        return weight
    return weight * literal_score(value)


def _alive(found: list[Pair]) -> set[str]:
    """Names from which some literal can be reached."""
    users: dict[str, list[str]] = {}
    for name, _, pieces, other in found:
        if not pieces and other:
            users.setdefault(other, []).append(name)
    alive = {p[0] for p in found if p[2]}
    todo = list(alive)
    while todo:
        fresh = {n for n in users.pop(todo.pop(), ()) if n not in alive}
        alive |= fresh
        todo += fresh
    return alive


def _unseen(options: list[int], k: int, past: dict[int, int]) -> int:
    """The first place from ``k`` on whose pair is not in ``past``; what has been skipped points there from now on."""
    way = []
    while 0 <= k < len(options) and options[k] in past:
        way.append(options[k])
        k = past[options[k]]
    past.update(dict.fromkeys(way, k))
    return k


def ends_of_chains(found: list[Pair], starts: list[int]) -> dict[int, int | None]:
    """Per start the pair with the literal that its name stands for, or None.

    A name stands for its nearest earlier assignment that the chain has not seen, else the first later one.
    Self-assignments lead only to what they could be skipped for, so they are no options.
    """
    held: dict[str, list[int]] = {}
    for i, (name, _, pieces, other) in enumerate(found):
        if pieces or other != name:
            held.setdefault(name, []).append(i)
    alive = _alive(found)
    known: dict[int, int | None] = {}  # of pairs whose chain meets none of its own pairs again
    out: dict[int, int | None] = {}
    for i in starts:
        at: int | None = i
        way: list[int] = []
        below: dict[int, int] = {}
        above: dict[int, int] = {}
        circle = False
        while at is not None and not found[at][2]:
            name, other = found[at][0], found[at][3]
            if other not in alive:
                at = None
            elif not circle and at in known:
                at = known[at]
            else:
                way.append(at)
                if name != other:
                    k = bisect_left(held[name], at)
                    below[at], above[at] = k - 1, k + 1
                options = held.get(other, [])
                k = bisect_left(options, at)
                n = _unseen(options, k - 1, below) if k else -1
                circle = circle or k > 0 and n != k - 1
                if n < 0:
                    k += k < len(options) and options[k] == at
                    n = _unseen(options, k, above)
                    circle = circle or n != k
                at = options[n] if 0 <= n < len(options) else None
        if not circle:
            known.update(dict.fromkeys(way, at))
        out[i] = at
    return out


def _quoted_pieces(text: bytes, pieces: list[tuple[int, int]]) -> bool:
    return bool(pieces) and text[pieces[0][0] - 1] in b"\"'"


def _unescaped(text: bytes, pieces: list[tuple[int, int]]) -> tuple[bytes, list[int]]:
    """What a quoted literal holds, and where each of its bytes stands."""
    out, at = bytearray(), []
    for a, b in pieces:
        i = a
        while i < b:
            two = text[i : min(i + 2, b)]
            c = _ESCAPES.get(two)
            out.append(text[i] if c is None else c)
            at.append(i + (two in _SELF))
            i += 1 if c is None else 2
    return bytes(out), at


def literal_spans(text: bytes) -> list[Span]:
    """Byte spans of literals that sensitive names hold, directly or through other names."""
    if b"=" not in text and b":" not in text:
        return []
    found = pairs(text)
    starts = [i for i, p in enumerate(found) if name_score(p[0]) >= THRESHOLD]
    spans: set[Span] = set()
    for i, at in ends_of_chains(found, starts).items():
        if at is None:
            continue
        pieces = found[at][2]
        value = b"".join(text[a:b] for a, b in pieces).decode("utf-8", "replace")
        if score(found[i][0], value, _quoted_pieces(text, pieces)) >= THRESHOLD:
            spans.add(("literal", pieces[0][0], pieces[-1][1]))
    for _, _, pieces, _ in found:
        if _quoted_pieces(text, pieces) and ("literal", pieces[0][0], pieces[-1][1]) not in spans:
            if any(text.find(c, a, b) >= 0 for a, b in pieces for c in (b"=", b":")):
                inner, at = _unescaped(text, pieces)
                spans.update(("literal", at[a], at[b - 1] + 1) for _, a, b in literal_spans(inner))
    return sorted(spans, key=lambda s: s[1:])


def all_spans(text: bytes) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, those of patterns and method), by start, then kind as listed."""
    base = base_spans(text)
    reach = Reach([(a, b) for _, a, b in base])
    more = [s for s in literal_spans(text) if reach.end(s[1] + 1) < s[2]]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            n: dict[str, list[int]] = {k: [] for k in KINDS}
            sha, spans = [], []
            for text in texts:
                base, every = all_spans(text)
                sha.append(hashlib.sha256(written(code_points(text, base)).encode()).hexdigest())
                spans.append(written(code_points(text, every)))
                for k, v in n.items():
                    v.append(sum(s[0] == k for s in every))
            cols = [rows.column(0), *(pa.array(n[k], pa.int64()) for k in BASE_KINDS), pa.array(sha), pa.array(spans), pa.array(n["literal"], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

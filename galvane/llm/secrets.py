"""Secret scan: assignment-aware lexing.

Source and configuration text is lexed into (name, literal) pairs around =, :, := and =>. Names
that hold literals are constants; an expression of constants and literals is resolved through
them. A literal is scored by how sensitive the name is that it ends up in and by the shape of all the
literals of that expression together. A literal that a base span covers in part has a span of its own, so
both are masked. Blanks around operators, line breaks after + (and before one
that is indented), names, literals of an expression and chains of constants have no limit of number.
Besides operators, these pair a name with a literal: a setter's call (setPassword("..."), .password("...")), a call
with a name and a value (put("db.password", "...")), an element (<pwd>...</pwd>) and an authorization header
(Authorization: Bearer ...). Quotes are ", ' and `.

A literal of fewer than 8 characters, a placeholder (none, changeme, your..., ${...}) or one with blanks has
no score; under names of phrases (PHRASES) blanks are allowed in three words or more. A name's weight and its
literal's score of at most 1 together have to reach THRESHOLD, so weights lie above THRESHOLD - 1.

Defined results: a null or empty text has no spans; rows repeat as they are; a null doc_id is
kept; other columns, whatever their names, are not read. Each text is scanned whole, by itself.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "lex")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: How much of a secret a name's part stands for.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "authorization": 0.7, "bearer": 0.7, "signature": 0.6, "salt": 0.6, "mnemonic": 1.0}
#: The same for two parts in a row.
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("account", "key"): 0.8, ("connection", "string"): 0.6}
#: Names whose literals are words.
PHRASES = {"passphrase", "mnemonic"}
#: First parts of names of calls that take a secret, not give one.
SETTERS = {"set", "with", "put", "use"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|example.*|your.*|dummy.*|sample.*|placeholder.*|todo.*|test|<.*>|\$\{?.*|%\(.*|\{\{.*)$")
THRESHOLD = 1.5

_OPERATOR = re.compile(r":=|=>|=|:")
_WORD = string.ascii_letters + string.digits + "_.-"
_TERM = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`|\$\{([A-Za-z_][A-Za-z0-9_]*)\}|([^\s"'`,;(){}\[\]<>+]+))""")
_PLUS = re.compile(r"[ \t]*+(?:\r?\n[ \t]++)?\+(?:[ \t]|\\?\r?\n)*+(?=[\"'`$A-Za-z_])")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_QUOTED = r"""(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)"""
_CALL = re.compile(r"(?<![A-Za-z0-9_.])([A-Za-z_.][A-Za-z0-9_.]*+)\([ \t]*+" + _QUOTED + r"(?:[ \t]*+,[ \t]*+" + _QUOTED + r")?[ \t]*+\)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>\n]++)</\1>")
_HEADER = re.compile(r"""((?i:authorization))["'\]]*+[ \t]*+[:=,][ \t]*+["'`]?(?i:bearer|basic|token)\x20++([A-Za-z0-9+/_.~=-]++)""")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def name_score(name: str) -> float:
    parts = [x.lower() for x in _PARTS.findall(name)]
    return max([0.0, *(SENSITIVE.get(x, 0.0) for x in parts), *(SENSITIVE_PAIRS.get(x, 0.0) for x in zip(parts, parts[1:], strict=False))])


class Shape:
    """What literal_score needs of literals in a row, in little room however often they repeat."""

    def __init__(self, value: str = ""):
        self.n, self.counts, self.head, self.last = len(value), Counter(value), value[:64], value[-1:]

    def __iadd__(self, other: Shape) -> Shape:
        self.n, self.counts = self.n + other.n, self.counts + other.counts
        self.head, self.last = (self.head + other.head)[:64], other.last or self.last
        if self.n >> 900:  # only the shares of such counts matter
            self.n, self.counts = self.n >> 800, Counter({c: max(1, k >> 800) for c, k in self.counts.items()})
        return self

    def sample(self) -> str:
        """The text itself if it is short, else one that PLACEHOLDER takes as it takes the text."""
        return self.head if self.n <= 64 else self.head + "".join(self.counts) + self.last


def literal_score(value: str | Shape, phrase: bool = False) -> float:
    """0 for prose (of a phrase: of fewer than three words) and placeholders, towards 1 for long mixed strings."""
    value = Shape(value) if isinstance(value, str) else value
    n, counts = value.n, value.counts
    if n < 8 or " " in counts and not (phrase and counts[" "] >= 2) or PLACEHOLDER.match(value.sample()):
        return 0.0
    bits = -sum(p * math.log2(p) for k in counts.values() if (p := k / n))
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.15 + bits / 8 + 0.1 * kinds + min(n, 40) / 200)


def _back(text: str, end: int, chars: str) -> int:
    """Where the run of chars that ends at end starts."""
    size = 64
    while True:
        lo = max(0, end - size)
        kept = len(text[lo:end].rstrip(chars))
        if kept or not lo:
            return lo + kept
        size *= 2


def name_before(text: str, end: int) -> str:
    """The name that ends at end but for a quote, a bracket and blanks; empty if there is none."""
    end = _back(text, end, " \t")
    for _ in range(2):
        end -= end > 0 and text[end - 1] in "\"']"
    return text[_back(text, end, _WORD) : end].lstrip(string.digits + ".-")


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int, bool]]]]:
    """(name, terms) in the text's order; a term is (content, start, end, is it a literal?)."""
    at = 0
    for m in _OPERATOR.finditer(text):
        if m.start() < at:
            continue
        name = name_before(text, m.start())
        if not name:
            continue
        terms, pos = [], m.end()
        while t := _TERM.match(text, pos):
            group = t.lastindex
            content = t[group]
            literal = group in (1, 2, 3) or group == 5 and not _IDENTIFIER.match(content)
            terms.append((content, t.start(group), t.end(group), literal))
            pos = t.end()
            plus = _PLUS.match(text, pos)
            if not plus:
                break
            pos = plus.end()
        if terms:
            at = pos
            yield name, terms


def marked(text: str) -> Iterator[tuple[str, list[tuple[str, int, int, bool]]]]:
    """Pairs as in pairs(), of calls, elements and headers."""
    if "(" in text:
        for m in _CALL.finditer(text):
            given = [k for k in range(2, 8) if m[k] is not None]
            name, k = m[1].rsplit(".", 1)[-1], given[-1]
            if len(given) == 2:
                yield m[given[0]], [(m[k], m.start(k), m.end(k), True)]
            elif (first := tuple(x.lower() for x in _PARTS.findall(name)[:2])) and (first[0] in SETTERS or first[0] in SENSITIVE or first in SENSITIVE_PAIRS):
                yield name, [(m[k], m.start(k), m.end(k), True)]
    if "</" in text:
        yield from ((m[1], [(m[2], m.start(2), m.end(2), True)]) for m in _ELEMENT.finditer(text))
    yield from ((m[1], [(m[2], m.start(2), m.end(2), True)]) for m in _HEADER.finditer(text))


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name."""
    nodes: list[tuple[list[tuple[int, int]], list[int]]] = []  # own literals, and constants as numbers of nodes before
    constants: dict[str, tuple[int, Shape]] = {}
    wanted: list[tuple[float, int]] = []
    for name, terms in sorted([*pairs(text), *marked(text)], key=lambda x: x[1][0][1]):
        own, used, shape = [], [], Shape()
        for content, start, end, literal in terms:
            if literal or content not in constants and len(terms) == 1 and any(c.isdigit() for c in content):
                own.append((start, end))  # or a bare word that looks like no name
                shape += Shape(content)
            elif content in constants:
                used.append(constants[content][0])
                shape += constants[content][1]
        constants[name] = len(nodes), shape
        nodes.append((own, used))
        sensitive = name_score(name)
        if sensitive and (own or used) and (score := sensitive + literal_score(shape, not PHRASES.isdisjoint(x.lower() for x in _PARTS.findall(name)))) >= THRESHOLD:
            wanted.append((score, len(nodes) - 1))
    found: dict[tuple[int, int], float] = {}
    visited: set[int] = set()
    for score, k in sorted(wanted, reverse=True):  # so each literal gets the best score that it reaches
        todo = [k]
        while todo:
            k = todo.pop()
            if k not in visited:
                visited.add(k)
                todo += nodes[k][1]
                for span in nodes[k][0]:
                    if span[1] > span[0]:
                        found.setdefault(span, score)
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, then all spans, each by start and kind."""
    base = []
    pair = "=" in text or ":" in text
    if pair:
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    by = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base.sort(key=by)
    starts, ends = [s for _, s, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    inside = lambda a, b: (k := bisect.bisect_right(starts, a)) and ends[k - 1] >= b  # noqa: E731  of base spans
    more = [("lex", a, b) for a, b, _ in lexed(text) if not inside(a, b)] if pair or "(" in text or "</" in text else []
    return base, sorted(base + more, key=by)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
SCHEMA = f"doc_id bigint, base {SPANS}, spans {SPANS}"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (kind, start, end in code points) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [scan(t or "") for t in batch.column(1).to_pylist()]
            cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in both], _SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(text: str) -> str:
    """text with each run of spans replaced by [SECRET]."""
    out, at = [], 0
    for _, a, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all their columns, in order; secrets in text are masked, null stays null."""
    names, k = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if t is None else redacted(t) for t in batch.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == k else batch.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts by kind, a hash of the base spans, all spans as text, and their number."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, base, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                flat = [[(s["kind"], s["start"], s["end"]) for s in x] for x in (base, spans)]
                n = Counter(k for k, _, _ in flat[0])
                rows.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(flat[0]).encode()).hexdigest(), joined(flat[1]), len(flat[1])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return find_secrets(docs).mapInArrow(run, schema)

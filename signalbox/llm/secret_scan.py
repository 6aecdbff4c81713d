"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration text.

The lexer reads ``name <operator> value`` (``=``, ``:``, ``:=``, ``=>``; names and values may be
quoted), ``key="name" value="literal"`` attributes and ``<name>literal</name>`` elements. A value is
a ``+`` chain of literals and names. Names are resolved to their nearest earlier assignment, else to
their first one, so a constant that reaches a sensitive name by way of other names is found where it
is written. A literal is scored by the sensitivity of the names it reaches and by its own strength.
Every scan is linear in the text, up to a sort of the assignments found.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.textkit import slices

#: Fixed values of the contract: kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: A literal is reported from this score on.
THRESHOLD = 0.5
#: Sensitivity of the parts of a name; the strongest part counts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "pin": 0.6,
    "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "auth": 0.7,
    "authorization": 0.8, "bearer": 0.8, "private": 0.7, "signing": 0.7, "encryption": 0.7,
    "key": 0.65, "salt": 0.6, "dsn": 0.6, "cookie": 0.6, "session": 0.6,
}
#: Parts that turn a sensitive name into a harmless one, such as ``token_type`` or ``password_length``.
HARMLESS = {"type", "length", "len", "name", "count", "url", "uri", "path", "file", "field", "label", "hint", "id", "ttl", "expiry", "public"}

_OPERATOR = re.compile(r"[:=]+>?")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_BARE = re.compile(r"[^\s,;\"'`<>(){}\[\]+]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*)>([^<>\s]+)</")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:\$\{.*\}|\{\{.*\}\}|<.*>|%.*%|x{3,}|\*{3,}|\.{3,}|changeme|example|placeholder|none|null|true|false|undefined|your.*)$")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``kind, start, end, value start`` of the fixed patterns, ordered by start, then kind."""
    found = []
    lower = text.lower()
    if any(part in lower for part in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _name_before(text: str, at: int) -> str:
    """The name that ends right before an operator, quotes and blanks aside."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME_CHARS:
        start -= 1
    name = text[start:end].lstrip("-.0123456789")
    return name.rstrip("-.")


def _value_after(text: str, at: int, limit: int) -> list[tuple[str, str, int]]:
    """Terms of the ``+`` chain after an operator, up to ``limit``: ("literal" or "name", text, start)."""
    terms = []
    while True:
        while at < limit and text[at] in " \t":
            at += 1
        if (m := _QUOTED.match(text, at, limit)) and m.lastindex:
            terms.append(("literal", m[m.lastindex], m.start(m.lastindex)))
        elif m := _BARE.match(text, at, limit):
            terms.append(("name" if _NAME.match(m[0]) else "literal", m[0], m.start()))
        else:
            return terms
        at = m.end()
        while at < limit and text[at] in " \t":
            at += 1
        if at >= limit or text[at] != "+":
            return terms
        at += 1


class _Values:
    """The values that hold the place reached: an operator counts only where its value may be read.

    A value is read once. Operators in its bare terms belong to it; those in a quoted term are read up to
    the end of that term, which quotes of another kind may hold in turn, so at most a few values are open.
    """

    def __init__(self, size: int):
        self.size = size
        self.open: list[tuple[int, deque[tuple[int, int]]]] = []

    def limit(self, at: int) -> int | None:
        """Up to where the value of an operator at a place reaches; None inside a bare term."""
        while self.open and self.open[-1][0] <= at:
            self.open.pop()
        if not self.open:
            return self.size
        quoted = self.open[-1][1]
        while quoted and quoted[0][1] <= at:
            quoted.popleft()
        return quoted[0][1] if quoted and quoted[0][0] <= at else None

    def add(self, text: str, terms: list[tuple[str, str, int]]) -> None:
        quoted = deque((start, start + len(value)) for _, value, start in terms if text[start - 1] in "\"'`")
        self.open.append((terms[-1][2] + len(terms[-1][1]), quoted))


def assignments(text: str) -> list[tuple[int, str, list[tuple[str, str, int]]]]:
    """``position, name, terms`` of every assignment, in order."""
    found = []
    if "=" in text or ":" in text:
        key, values = None, _Values(len(text))
        for m in _OPERATOR.finditer(text):
            if (limit := values.limit(m.start())) is None:
                continue  # part of a bare value
            if m[0] not in ("=", ":", ":=", "=>") or m.start() and text[m.start() - 1] in "!<>":
                continue
            name = _name_before(text, m.start())
            if not name or m[0] == ":" and text.startswith("//", m.end()):
                continue
            if terms := _value_after(text, m.end(), limit):
                values.add(text, terms)
                if name.lower() == "value" and key:
                    name = key
                key = terms[0][1] if name.lower() in ("key", "name") and terms[0][0] == "literal" else None
                found.append((m.start(), name, terms))
    if "</" in text:
        found += [(m.start(), m[1], [("literal", m[2], m.start(2))]) for m in _ELEMENT.finditer(text)]
        found.sort(key=lambda a: a[0])
    return found


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if parts and parts[-1] in HARMLESS:
        return 0.0
    joined = {"".join(pair) for pair in zip(parts, parts[1:])}
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0)


def strength(literal: str) -> float:
    """0 to 1: what length, entropy and mixture of characters say about a literal."""
    if len(literal) < 6 or _PLACEHOLDER.match(literal):
        return 0.0
    seen = Counter(literal)
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in seen.values()) * len(literal)
    kinds = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal), re.search("[^A-Za-z0-9]", literal))))
    blanks = 0.5 if any(c.isspace() for c in literal) else 1.0
    return min(1.0, bits / 40) * (0.4 + 0.2 * min(kinds, 3)) * blanks


def literal_spans(text: str) -> list[tuple[str, int, int, float, str]]:
    """``kind, start, end, score, name`` of the literals that reach a sensitive name."""
    found = assignments(text)
    if not found:
        return []
    places = defaultdict(list)
    for i, (_, name, _) in enumerate(found):
        places[name].append(i)
    # Spread sensitivity to the assignments a name is resolved to, the most sensitive first: each is visited once.
    reached: dict[int, tuple[float, str]] = {}
    levels = [(sensitivity(name), i) for i, (_, name, _) in enumerate(found)]
    for level, i in sorted(((level, i) for level, i in levels if level), key=lambda x: (-x[0], x[1])):
        todo = [i]
        while todo:
            at = todo.pop()
            if at in reached:
                continue
            reached[at] = level, found[i][1]
            for kind, value, _ in found[at][2]:
                if kind == "name" and (own := places.get(value)):
                    todo.append(own[max(0, bisect.bisect_left(own, at) - 1)])
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for i, (level, name) in reached.items():
        # A plain word, or a name that is not assigned here, is no literal.
        literals = [t for t in found[i][2] if t[0] == "literal" or t[1] not in places and any(c.isdigit() for c in t[1])]
        score = level * strength("".join(value for _, value, _ in literals))
        if score >= THRESHOLD:
            for _, value, start in literals:
                if value:
                    span = start, start + len(value)
                    best[span] = max(best.get(span, (0.0, "")), (score, name))
    return [("literal", a, b, score, name) for (a, b), (score, name) in sorted(best.items())]


def findings(text: str | None) -> list[dict]:
    """All spans by start, then kind; a literal inside a span of a fixed pattern is not repeated."""
    if not text:
        return []
    base = base_spans(text)
    rows = [{"kind": k, "start": a, "end": b, "value_start": v, "score": 1.0, "name": ""} for k, a, b, v in base]
    starts, reach = [], []
    for _, a, b, _ in base:
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for kind, a, b, score, name in literal_spans(text):
        i = bisect.bisect_right(starts, a) - 1
        if i < 0 or reach[i] < b:
            rows.append({"kind": kind, "start": a, "end": b, "value_start": a, "score": score, "name": name})
    return sorted(rows, key=lambda r: (r["start"], KINDS.index(r["kind"])))


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with the value of every finding replaced; overlapping values are replaced once."""
    if not text or not (found := findings(text)):
        return text
    parts, at = [], 0
    for start, end in sorted((r["value_start"], r["end"]) for r in found):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("value_start", pa.int64()), ("score", pa.float64()), ("name", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, findings`` for every row of ``docs``; a null or empty text has no findings.

    ``findings`` is an array of (kind, start, end, value_start, score, name), offsets in code points,
    end exclusive. Ids may be null or repeated: rows are independent. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [findings(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, type=_FINDING)], names=["id", "findings"])

    kinds = "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,score:double,name:string>>"
    return rows.mapInArrow(run, f"id {id_type}, findings {kinds}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the values of all findings replaced in ``text_col``; every row and column stays."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                texts = [redacted(t) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array(texts, type=part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)

"""Secret scan: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer goes forward once from name to name. It reads assignments (``name = value``, ``"name": value``, ``name: type = value``),
calls (``name(value)``, ``f("name", value)``, ``f(name=value)``), XML elements and YAML blocks. A value is made of quoted strings of
all kinds, bare literals, names and calls, joined by ``+``; the name of a called function is no literal. Constants are kept in
order, names in later values are resolved, and what a sensitive name receives is scored. The span of a found literal is reported
where the literal stands, so a constant that reaches a password through another name is found at its definition. A constant
keeps references to the constants it is made of and a summary of its characters, so chains of any length take linear time.

Defined results: a null text is empty and has no spans; texts of any length are read whole; each row is scanned by itself,
so repeated rows and null keys pass through; equal spans found twice are listed once; an empty table gives an empty table;
an input column named like a result is replaced. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixbag.llm.words import small_batches

# Fixed patterns; re.A keeps the case folding to ASCII letters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "lexed")

# Weights of the parts of a name; the strongest part counts.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "signingkey": 1.0, "authkey": 1.0,
    "auth": 0.6, "bearer": 0.7, "key": 0.5, "salt": 0.5,
}
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "placeholder", "redacted", "password", "secret", "token", "string"}
# Score from which a literal counts, and the least length of a literal.
THRESHOLD, LEAST = 0.55, 6

# A run that may hold a name, and what makes it the head of an assignment or call. Possessive, so no run is read twice.
HEAD = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["'\]]{0,2}+[\x20\t]*+(:=|=>|[:=(])""")
NAME = re.compile(r"[A-Za-z_].*", re.S)
SPACES = re.compile(r"[\x20\t]*+")
STRING = r'(?:[rRbBuUfF]{1,2}(?=["\']))?+(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'((?:[^\'\\]|\\.|\'(?!\'\'))*+)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|\'((?:[^\'\\\n]|\\.)*+)\')'
TERM = re.compile(STRING + r"|([A-Za-z0-9_+/.~$-]++=*+)", re.S)
ARGUMENT = re.compile(STRING + r"|([A-Za-z0-9_+/.~$-]++)|([(){}\[\],:=+\n])", re.S)
DECLARED = re.compile(r"[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\]<>|?,\x20]*+=(?![=>])")
BLOCK = re.compile(r"[\x20\t]*+[|>][+-]?[0-9]?[\x20\t]*+\n")
LINE = re.compile(r"([\x20\t]*+)([^\n]*+)(?:\n|\Z)")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)[^<>]*+>\s*+([^<>]++)</\1\s*+>")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
PATH = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+\Z")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Every sensitive name holds one of these, so other texts need no lexing.
ROOTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "salt")
# Characters counted of a value before the counts are halved; only their proportions matter.
MOST_COUNTED = 1 << 40

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_weight(name: str) -> float:
    """How sensitive a name is, by its parts and pairs of neighbouring parts."""
    parts = [p.lower() for p in CAMEL.findall(name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in joined), default=0.0)


class Value:
    """A constant: spans of its own literals, the constants it is made of, and a summary of its characters."""

    __slots__ = ("spans", "sources", "length", "counts", "start", "reported")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.sources: list[Value] = []
        self.length, self.counts = 0, {}
        # The first characters, as many as the longest placeholder has and one more.
        self.start = ""
        self.reported = False

    def add(self, text: str, start: int) -> None:
        self.spans.append((start, start + len(text)))
        self._count(len(text), Counter(text), text[:SHOWN])

    def use(self, other: Value) -> None:
        self.sources.append(other)
        self._count(other.length, other.counts, other.start)

    def _count(self, length: int, counts: dict[str, int], start: str) -> None:
        self.start = (self.start + start)[:SHOWN] if self.length < SHOWN else self.start
        self.length += length
        for c, n in counts.items():
            self.counts[c] = self.counts.get(c, 0) + n
        if self.length > MOST_COUNTED:
            self.length >>= 1
            self.counts = {c: max(1, n >> 1) for c, n in self.counts.items()}

    def strength(self) -> float:
        """0 to 1: randomness of the literal from its entropy and its classes of characters."""
        seen = self.counts
        if self.length < LEAST or self.start.lower() in PLACEHOLDERS or len(seen) < 4 or any(c.isspace() for c in seen):
            return 0.0
        n = sum(seen.values())
        entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
        kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in seen}
        return min(1.0, entropy / 4 * 0.7 + (len(kinds) - 1) * 0.15)

    def report(self, found: dict[tuple[int, int], None]) -> None:
        """Add the spans of the value and of all it is made of, each constant once."""
        waiting = [self]
        while waiting:
            value = waiting.pop()
            if not value.reported:
                value.reported = True
                found.update((span, None) for span in value.spans if span[1] > span[0])
                waiting += value.sources


SHOWN = max(map(len, PLACEHOLDERS)) + 1


class Lexer:
    """One forward pass over a text."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, Value] = {}
        self.found: dict[tuple[int, int], None] = {}

    def receive(self, name: str, value: Value) -> None:
        weight = name_weight(name)
        if weight and weight * 0.4 + value.strength() * 0.6 >= THRESHOLD:
            value.report(self.found)

    def call(self, at: int, value: Value) -> int:
        """Read arguments up to the closing bracket or the line's end; strings and known names go to ``value``. A string or
        name with a string behind a comma, colon or equals sign is a pair of its own."""
        depth, name, text = 1, None, self.text
        pending, last = None, ""
        for token in ARGUMENT.finditer(text, at):
            mark, word = token[6], token[5]
            at = token.end()
            if mark:
                last = mark
                if mark in "([{":
                    depth += 1
                elif mark in ")]}":
                    depth -= 1
                if depth == 0 or mark == "\n":
                    break
                if mark in ",:=" and pending is not None:
                    name, pending = pending, None
                elif mark not in "([{":
                    name = pending = None
                continue
            if word is not None:
                if word in self.constants:
                    value.use(self.constants[word])
                    if name:
                        self.receive(name, self.constants[word])
                pending, name = word, None
                continue
            which = next(i for i in range(1, 5) if token[i] is not None)
            literal, start = token[which], token.start(which)
            if name:
                own = Value()
                own.add(literal, start)
                self.receive(name, own)
            # A sensitive name given as a string is no secret itself.
            if not (IDENTIFIER.match(literal) and name_weight(literal)):
                value.add(literal, start)
            pending, name = literal, None
        return at

    def expression(self, at: int) -> tuple[Value | None, int]:
        """The value at a place, and where it ends."""
        text, value = self.text, Value()
        at = SPACES.match(text, at).end()
        end = at
        while term := TERM.match(text, at):
            bare, end = term[5], term.end()
            if bare is None:
                which = next(i for i in range(1, 5) if term[i] is not None)
                value.add(term[which], term.start(which))
            elif text[end : end + 1] == "(":
                end = self.call(end + 1, value)
            elif bare in self.constants and IDENTIFIER.match(bare):
                value.use(self.constants[bare])
            elif not PATH.match(bare):
                value.add(bare, term.start())
            plus = SPACES.match(text, end).end()
            if text[plus : plus + 1] != "+":
                break
            at = SPACES.match(text, plus + 1).end()
        return (value if value.spans or value.sources else None), end

    def block(self, head: int, at: int) -> tuple[Value, int]:
        """The lines below a YAML key that are further in than it."""
        text, value = self.text, Value()
        line = text.rfind("\n", 0, head) + 1
        inside = SPACES.match(text, line).end() - line
        while at < len(text) and (row := LINE.match(text, at)) and (not row[2] or len(row[1]) > inside):
            if body := row[2].rstrip():
                value.add(body, row.start(2))
            at = row.end()
        return value, at

    def run(self) -> list[Span]:
        text, at = self.text, 0
        while head := HEAD.search(text, at):
            at = head.end()
            named = NAME.search(head[1])
            name = named[0] if named else ""
            if head[2] == "(":
                value = Value()
                at = self.call(at, value)
                self.receive(name, value)
                continue
            if not name:
                continue
            if head[2] == ":" and (opened := BLOCK.match(text, at)):
                value, at = self.block(head.start(), opened.end())
            else:
                if head[2] == ":" and (declared := DECLARED.match(text, at)):
                    at = declared.end()
                value, at = self.expression(at)
            if value is not None:
                self.constants[name] = value
                self.receive(name, value)
        if "</" in text:
            for element in ELEMENT.finditer(text):
                value = Value()
                value.add(element[2].rstrip(), element.start(2))
                self.receive(element[1], value)
        return [(start, KINDS.index("lexed"), end) for start, end in sorted(self.found)]


def lexed_spans(text: str) -> list[Span]:
    """(start, kind, end) of literals that reach a sensitive name."""
    low = text.lower()
    return Lexer(text).run() if any(root in low for root in ROOTS) else []


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and lexed spans together, both in order."""
    base = base_spans(text)
    more = lexed_spans(text)
    return base, sorted(base + more) if more else base


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, text: str, new: list[tuple[str, str, pa.DataType]], values: Callable[[str | None], tuple]) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [n for n, _, _ in new]
    fields = docs.drop(*names).schema.fields
    kept = [f.name for f in fields]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [values(value.as_py()) for value in batch.column(text)]
            columns = [pa.array([r[i] for r in rows], type=t) for i, (_, _, t) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *columns], names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_assign, n_access, n_hex, n_lexed, base_spans and spans (``kind:start:end``, comma-joined)."""
    def values(value: str | None) -> tuple:
        base, every = scan_text(value or "")
        counts = Counter(kind for _, kind, _ in every)
        return *[counts[k] for k in range(len(KINDS))], written(base), written(every)

    new = [(f"n_{kind}", "bigint", pa.int64()) for kind in KINDS]
    return _mapped(docs, text, [*new, ("base_spans", "string", pa.string()), ("spans", "string", pa.string())], values)


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per span: the columns of docs without the text, and kind, start and end."""
    parts = F.split("_span", ":")
    return (
        scan(docs.drop("kind", "start", "end"), text).where(F.col("spans") != "")
        .withColumn("_span", F.explode(F.split("spans", ",")))
        .withColumns({"kind": parts[0], "start": parts[1].cast("bigint"), "end": parts[2].cast("bigint")})
        .drop(text, "_span", "base_spans", "spans", *[f"n_{kind}" for kind in KINDS])
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found stretch replaced by ``mark``; columns and null texts stay as they are."""
    def values(value: str | None) -> tuple:
        return (None if value is None else redacted(value, scan_text(value)[1], mark),)

    order = docs.columns
    return _mapped(docs, text, [(text, "string", pa.string())], values).select(*order)


"""Secret scans: fixed patterns, and assignment-aware lexing that adds what they miss."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_rows, blocks

#: Kinds in the order in which they are listed, patterns and least lengths.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run is taken whole, so this is AKIA[A-Z0-9]+ of 18 or more
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

#: Heads of pairs: a name with an assigning sign after it, or called, in source code, JSON, YAML, INI or shell; an XML element.
HEAD = re.compile(r"""
    (?<![A-Za-z0-9_.$-]) (?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)
    (?: (?P<call>\([ \t\r\n]*+)
      | (?:\\?["'`]?\]|\\?["'`]|(?P<places>(?:\[[^\[\]\n]*+\])++))? [ \t]*+ (?P<sign>:=|=>|[:=]) [ \t]*+ )
  | <(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*+) (?:[ \t\r\n][^<>]*+)? (?<!/)> (?P<body>[^<>]*+) </(?P=tag)[ \t]*+>""", re.VERBOSE)
#: A type between ``:`` and ``=``; ``=`` has a space beside it or a quote after it, else it is part of a bare value.
TYPE = re.compile(r"""(?:[A-Za-z_][\w.]*+(?:\[(?:[^\[\]\n]|\[[^\[\]\n]*+\])*+\]|<(?:[^<>\n]|<[^<>\n]*+>)*+>)*+[?!]?(?:[ \t]*+\|[ \t]*+)?)++(?:[ \t]++=[ \t]*+|=(?=[ \t"'`])[ \t]*+)(?!=)""")
QUOTED = re.compile(r"""(?:[A-Za-z]{1,2}(?=["'`]))?(?:\"{3}(?P<triple>(?s:.*?))\"{3}|'{3}(?P<three>(?s:.*?))'{3}|"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<back>[^`]*+)`)|\\"(?P<nested>[^"\\\n]*+)\\" """.rstrip())
#: A name that is called or subscripted is no value.
CALLED = re.compile(r"""[A-Za-z_$][A-Za-z0-9_.$]*+(?=[(\[](?:[)\]"'`\s]|[A-Za-z0-9_.$]*+(?:[,)\].(=\s]|$)))""")
#: Up to white space, the end, or a sign before which another name is assigned to; brackets first only around plain text.
BARE = re.compile(r"""(?:[^\s"'`,;=:#&?()\[\]{}<>\\]|[({\[<](?=[^\s"'`=:]*+(?!\S))|[#&?](?=\S))(?:[^\s&,;?(){}\[\]"'`<]|[&,;?(){}\[\]"'`<]++(?!["'`/]*+[A-Za-z_][A-Za-z0-9_.-]*+["'`]?\]?[:=>]))*+""")
OPENED = re.compile(r"\(\s*+(?=[A-Za-z]{0,2}[\"'`])")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*+(?=[,;)\]}]*+$)")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*+(?![ \t]*+[:=(\[])")
CONCATENATED = re.compile(r"[ \t]*+(?:(?:\+|\.\.?|&|\\)[ \t]*+(?:\r?\n[ \t]*+)?|(?:\r?\n[ \t]*+)\+[ \t]*+|(?=[\"'`]))")
CONTINUED = re.compile(r"\s*+(?:(?:\+|\.\.?|&|\\)\s*+|(?=[A-Za-z]{0,2}[\"'`]))")
COMMA = re.compile(r"\s*+,\s*+")
#: What a value on the lines after its name starts with: nothing, or the mark of a block; and what is no value there.
NEXT_LINE = re.compile(r"(?:[|>][+-]?[0-9]?)?[ \t]*+\r?\n(?P<indent>[ \t]*+)(?=[^\s#])")
ITEM = re.compile(r"""-[ \t]|["'`]?[A-Za-z_$][A-Za-z0-9_.$-]*+["'`]?[ \t]*+[:=]""")
#: Names that stand for the one before them, and what may stand between the two.
STANDS_FOR = {"value", "default", "text", "data", "literal", "plaintext", "content", "stringvalue"}
NAMING = {"key", "name", "id"}
BETWEEN = re.compile(r"""[\s"'`,;{\[(|>\\-]*+""")
RANDOM = re.compile(r"(?=.*[a-z])(?=.*[A-Z]).*[0-9].*[^0-9].*[0-9]")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: How strongly a part of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8, "pass": 0.7, "auth": 0.6, "signature": 0.5, "key": 0.5, "private": 0.4, "access": 0.3, "api": 0.4, "client": 0.2, "signing": 0.4, "encryption": 0.4}
#: Words that show in a name even where nothing parts them from the rest of it.
STRONG = ("password", "passwd", "passphrase", "secret", "apikey", "credential", "credentials", "token")
#: A text without any of these has no sensitive name, as what is left out doesn't reach the least score alone.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "auth", "sign", "private", "access", "api", "encryption")
LEAST_NAME = 0.5
MOST_SCORED = 100
PLACEHOLDER = re.compile(r"(?ai)^(x+|\*+|changeme|example|placeholder|your[_-].*|none|null|true|false|test|dummy|\$?\{.*\}|<.*>)$")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each fixed pattern; a match whose value is too short is consumed and dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    """0 to 1 for the sensitivity of a target name, by its parts in any casing style."""
    total = 0.0
    for part in {p.lower() for p in PART.findall(name)}:
        total += SENSITIVE.get(part) or max((SENSITIVE[s] for s in STRONG if part.startswith(s) and part[len(s) :] == "s" or part.endswith(s)), default=0.0)
    return min(1.0, total)


def literal_score(value: str) -> float:
    """0 to 1: long, mixed and uneven values look like secrets, words and placeholders don't."""
    if len(value) < 8 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * (0.25 + 0.25 * kinds)


class Value:
    """Literals put together: places in the text, and values of earlier statements.

    ``head`` holds the first places, which are scored; ``places`` gives those not given before, so
    that all statements together are linear in the text however they build on each other.
    """

    __slots__ = ("parts", "head", "given")

    def __init__(self, parts: list[tuple[int, int] | Value]):
        self.parts, self.given = parts, False
        head: list[tuple[int, int]] = []
        for p in parts:
            head += p.head if isinstance(p, Value) else [p]
            if len(head) >= MOST_SCORED:
                break
        self.head = tuple(head[:MOST_SCORED])

    def places(self) -> Iterator[tuple[int, int]]:
        todo: list = [self]
        while todo:
            p = todo.pop()
            if not isinstance(p, Value):
                yield p
            elif not p.given:
                p.given = True
                todo += p.parts


class Constants:
    """Values by name; a dotted name also goes by its last part."""

    def __init__(self) -> None:
        self.full: dict[str, Value] = {}
        self.last: dict[str, Value] = {}

    def put(self, name: str, value: Value) -> None:
        self.full[name] = self.last[name.rpartition(".")[2]] = value

    def get(self, name: str) -> Value | None:
        return self.full.get(name) or self.last.get(name.rpartition(".")[2])


def value_at(text: str, at: int, constants: Constants, bare: bool = True) -> tuple[Value | None, int]:
    """The value that starts at ``at``, and where it ends: literals and constants put together, or a
    bare value, which is no literal if it is a name."""
    parts: list = []
    quoted = False
    end = at
    if inside := OPENED.match(text, at):
        at = inside.end()
    while True:
        if m := QUOTED.match(text, at):
            start, end = m.span(m.lastgroup)
            if m.lastgroup not in ("double", "single"):
                inner = text[start:end]
                start, end = start + len(inner) - len(inner.lstrip()), start + len(inner.rstrip())
            parts += [(start, end)] if end > start else []
            quoted, end = True, m.end()
        elif quoted or not bare:
            if not (m := NAME.match(text, at)) or not (found := constants.get(m[0])):
                break
            parts.append(found)
            end = m.end()
        elif m := CALLED.match(text, at):
            return None, m.end()
        elif m := BARE.match(text, at):
            if name := IDENTIFIER.match(m[0]):
                found = constants.get(name[0])
                if not found and not RANDOM.match(name[0]):
                    return None, at + len(name[0])
                parts.append(found or (at, at + len(name[0])))
                end = at + len(name[0])
            else:
                closers = "".join(y for x, y in ("()", "[]", "{}") if x not in m[0])
                return Value([(at, at + max(1, len(m[0].rstrip(",;" + closers))))]), m.end()
        else:
            break
        joint = (CONTINUED if inside else CONCATENATED).match(text, end)
        if not joint or joint.end() == end and not quoted:
            break
        at = joint.end()
    return (Value(parts) if parts else None), end


def below(text: str, start: int, at: int, constants: Constants) -> tuple[Value | None, int]:
    """A value on the lines below its name, which starts at ``start``: quoted, or further in than the name's line."""
    if not (m := NEXT_LINE.match(text, at)):
        return None, at
    line = text.rfind("\n", 0, start) + 1
    indent = len(text[line:start]) - len(text[line:start].lstrip(" \t"))
    quoted = QUOTED.match(text, m.end())
    if ITEM.match(text, m.end()) or not quoted and len(m["indent"]) <= indent:
        return None, at
    value, end = value_at(text, m.end(), constants)
    return (value, end) if value else (None, at)


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) pairs in order.

    A bare value or argument that is the name of an earlier constant stands for its value, so a
    chain of names leads back to where the literals are written. A name such as ``value`` right
    after another one, or after one that ``key`` or ``name`` gives, takes that one's place.
    """
    constants, label, end = Constants(), (None, 0), 0
    while m := HEAD.search(text, end):
        start = m.start()
        if m["tag"]:
            end = m.end()
            inner = m["body"].strip()
            if inner:
                at = m.start("body") + m["body"].index(inner)
                yield m["tag"].rpartition(":")[2], Value([(at, at + len(inner))])
            continue
        if m["call"]:
            end = m.end()
            value, after = value_at(text, end, constants, bare=False)
            if not value:
                continue
            first = text[slice(*value.head[0])] if len(value.head) == 1 else ""
            if (comma := COMMA.match(text, after)) and IDENTIFIER.fullmatch(first):
                second, behind = value_at(text, comma.end(), constants, bare=False)
                if second:
                    yield first, second
                    end = behind
                    continue
            yield m["name"].rpartition(".")[2], value
            continue
        kind = TYPE.match(text, m.end()) if m["sign"] == ":" else None
        value, end = value_at(text, kind.end(), constants) if kind else (None, 0)
        if not end or end == kind.end():
            value, end = value_at(text, m.end(), constants)
        if end == m.end() and m["sign"] == ":":
            value, end = below(text, start, end, constants)
        name = m["name"]
        short = name.rpartition(".")[2].lower()
        if label[0] and short in STANDS_FOR and BETWEEN.fullmatch(text, label[1], start):
            name = label[0]
        label = (None, 0)
        if value is None:
            given = text[m.end() : end]
            label = (given if short in NAMING and IDENTIFIER.fullmatch(given) else name, end)
            continue
        if short in NAMING and len(value.head) == 1 and IDENTIFIER.fullmatch(given := text[slice(*value.head[0])]):
            label = (given, end)
        if not m["places"]:
            constants.put(name, value)
        yield name + (m["places"] or ""), value


def assigned_spans(text: str, threshold: float = 0.35) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants assigned before: each
    place of a value whose name and text, its first places put together, score ``threshold`` or more."""
    out = set()
    low = text.lower()
    if any(h in low for h in HINTS):
        for name, value in pairs(text):
            if (sensitive := name_score(name)) >= LEAST_NAME and sensitive * literal_score("".join(text[a:b] for a, b in value.head)) >= threshold:
                out.update(Span(a, 3, b) for a, b in value.places())
    return sorted(out)


def uncovered(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``spans`` that lie in none of ``base``; both are sorted."""
    out, i, reach = [], 0, -1
    for s in spans:
        while i < len(base) and base[i].start <= s.start:
            reach = max(reach, base[i].end)
            i += 1
        if s.end > reach:
            out.append(s)
    return out


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: with those of the lexer that no base span covers."""
    if not text:
        return [], []
    base = base_spans(text)
    more = uncovered(assigned_spans(text), base)
    return base, sorted(base + more) if more else base


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan_secrets(docs: DataFrame, text: str = "text", redact: str | None = None, batch_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end) by start, then kind as listed.

    Places are code points with exclusive ends. ``base`` holds the fixed patterns' spans; ``spans``
    adds kind ``literal`` from assignments. With ``redact``, every span in the text is replaced by
    that string and overlapping spans by a single one. Null and empty texts have no spans and stay.
    Very long texts are scanned whole, in a block of their own, in time linear in their length. Rows
    are independent, so repeated ones and null ids stay and no rows give none. Older columns named
    ``base`` or ``spans`` are replaced. Without ``redact`` the text itself is not returned.
    """
    docs = docs.drop("base", "spans")
    fields = [f for f in docs.schema.fields if redact is not None or f.name != text]
    schema = T.StructType([*fields, T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in blocks(batches, text, batch_bytes):
            texts = part.column(text).to_pylist()
            found = [find_secrets(t) for t in texts]
            columns = {n: part.column(n) for n in part.schema.names if n != text or redact is not None}
            if redact is not None:
                columns[text] = pa.array([replaced(t, spans, redact) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            for i, name in enumerate(("base", "spans")):
                columns[name] = pa.array([[(KINDS[s.kind], s.start, s.end) for s in x[i]] for x in found], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return arrow_rows(docs).mapInArrow(run, schema)


def replaced(text: str | None, spans: list[Span], by: str) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at : span.start], by]
        at = max(at, span.end)
    return "".join(out) + text[at:]

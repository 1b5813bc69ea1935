"""S-expressions of entity files: reading with positions, and the canonical printing.

A datum is an ``Atom`` or a ``List``; both know where they begin. What the entity format does not allow (dotted
pairs, quotes, nil, empty lists) is an error with a position, like any lexical mistake.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


class SyntaxFault(ValueError):
    def __init__(self, message: str, line: int, column: int):
        super().__init__(message)
        self.message, self.line, self.column = message, line, column


@dataclass(slots=True)
class Atom:
    kind: str  # symbol, real, integer, string or boolean
    value: object
    line: int = 0
    column: int = 0
    comments: list[str] = field(default_factory=list)


@dataclass(slots=True)
class List:
    items: list
    line: int = 0
    column: int = 0
    comments: list[str] = field(default_factory=list)
    trailing: list[str] = field(default_factory=list)

    @property
    def tag(self) -> str:
        return self.items[0].value if isinstance(self.items[0], Atom) and self.items[0].kind == "symbol" else ""


_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n\f]+)|(?P<line>;[^\n]*)|(?P<block>\#\|)|(?P<open>\()|(?P<close>\))|(?P<string>")"""
    r"""|(?P<boolean>\#(?:true|false|t|f)(?![^\s()";]))|(?P<word>[^\s()"';`,\#|]+)|(?P<other>.)""",
    re.S | re.X,
)
_NUMBER = re.compile(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$")
_NUMERIC_START = re.compile(r"[+-]*\.?\d")
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
MAX_DEPTH = 10_000


def parse(text: str) -> tuple[list[List], list[str]]:
    """The top-level forms of a file, and the comments after the last one."""
    after: list[str] = []
    return list(each(text, after)), after


def each(text: str, after: list[str] | None = None) -> Iterator[List]:
    """The top-level forms of a file one by one, so that a caller holds one at a time; the comments after the last go to ``after``."""
    if text.startswith("﻿"):
        raise SyntaxFault("a byte order mark", 1, 1)
    at, line, begin = 0, 1, 0
    stack: list[List] = []
    waiting: list[list[str]] = [[]]

    def put(datum) -> None:
        datum.comments = waiting[-1]
        waiting[-1] = []
        if stack:
            stack[-1].items.append(datum)
        else:
            raise SyntaxFault("a file holds forms only", datum.line, datum.column)

    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, column, start = m.lastgroup, at - begin + 1, line
        end = m.end()
        if kind == "line":
            waiting[-1].append(m.group().rstrip())
        elif kind == "block":
            depth, end = 1, at + 2
            while depth:
                nxt = re.compile(r"#\||\|#").search(text, end)
                if nxt is None:
                    raise SyntaxFault("a comment that is never closed", start, column)
                depth += 1 if nxt.group() == "#|" else -1
                end = nxt.end()
            waiting[-1].append(text[at:end])
        elif kind == "open":
            opened = List([], start, column)
            if len(stack) >= MAX_DEPTH:
                raise SyntaxFault("nested too deeply", start, column)
            opened.comments, waiting[-1] = waiting[-1], []
            stack.append(opened)
            waiting.append([])
        elif kind == "close":
            if not stack:
                raise SyntaxFault("a parenthesis that nothing opened", start, column)
            done = stack.pop()
            done.trailing = waiting.pop()
            if not done.items:
                raise SyntaxFault("an empty list", done.line, done.column)
            if stack:
                stack[-1].items.append(done)
            else:
                yield done
        elif kind == "string":
            out, end = [], at + 1
            while True:
                if end >= len(text):
                    raise SyntaxFault("a string that is never closed", start, column)
                ch = text[end]
                if ch == '"':
                    end += 1
                    break
                if ch == "\\":
                    nxt = text[end + 1 : end + 2]
                    if nxt == "u" and re.match(r"[0-9A-Fa-f]{4}", text[end + 2 : end + 6]):
                        out.append(chr(int(text[end + 2 : end + 6], 16)))
                        end += 6
                        continue
                    if nxt not in _ESCAPES:
                        raise SyntaxFault("an unknown escape", start, column)
                    out.append(_ESCAPES[nxt])
                    end += 2
                    continue
                out.append(ch)
                end += 1
            put(Atom("string", "".join(out), start, column))
        elif kind == "boolean":
            put(Atom("boolean", m.group()[1] == "t", start, column))
        elif kind == "word":
            word = m.group()
            if _NUMBER.match(word):
                real = any(c in word for c in ".eE")
                put(Atom("real" if real else "integer", float(word) if real else int(word), start, column))
            elif _NUMERIC_START.match(word):
                raise SyntaxFault(f"not a number: {word}", start, column)
            elif word == ".":
                raise SyntaxFault("a dotted pair", start, column)
            elif word == "nil":
                raise SyntaxFault("nil has no meaning here", start, column)
            else:
                put(Atom("symbol", word, start, column))
        elif kind == "other":
            raise SyntaxFault("a quotation has no meaning here" if m.group() in "'`," else f"unexpected {m.group()!r}", start, column)
        breaks = text.count("\n", at, end)
        if breaks:
            line, begin = line + breaks, text.rfind("\n", at, end) + 1
        at = end
    if stack:
        raise SyntaxFault("a list that is never closed", stack[-1].line, stack[-1].column)
    if after is not None:
        after += waiting[0]


# Printing.

# The order of top-level forms, and of the children of each form.
TOP_ORDER = ["project", "namespace", "type", "predicate", "tolerance", "frame", "route", "node", "vertex", "edge", "loop"]
CHILDREN = {
    "project": ["label", "globalid-namespace", "description"],
    "namespace": ["description"],
    "type": ["kind", "geometry", "description", "classification", "invariant"],
    "predicate": ["unit", "shape", "dimension", "claim-bearing", "strict", "description"],
    "tolerance": ["value", "description"],
    "frame": ["label", "unit", "parent", "transform"],
    "route": ["namespace", "kind", "type", "file", "description"],
    "node": ["label", "kind", "type", "geometry", "frame", "within", "member-of", "boundary", "observed-in", "retired"],
    "vertex": ["label", "frame", "observed-in"],
    "edge": ["label", "frame", "vertices", "backed-by", "observed-in"],
    "loop": ["label", "frame", "edges", "observed-in"],
    "retired": ["date", "reason", "superseded-by"],
    "transform": ["translation", "rotation", "scale"],
}
CLAIM_CHILDREN = ["id", "value", "source", "method", "accuracy", "date", "rank", "superseded-by"]
REQUIRED = {
    "project": {"globalid-namespace"},
    "namespace": {"description"},
    "type": {"kind", "geometry", "description"},
    "predicate": {"shape"},
    "tolerance": {"value"},
    "frame": {"unit"},
    "route": {"file"},
    "node": {"kind", "type"},
    "vertex": {"frame"},
    "edge": {"frame", "vertices"},
    "loop": {"frame", "edges"},
}
REPEATED = {"kind", "geometry", "classification", "invariant", "member-of", "boundary", "observed-in", "backed-by"}
DEFAULTS = {("rank", "normal"), ("claim-bearing", True), ("strict", False)}
CLAIM_HOLDERS = {"node", "vertex", "edge", "loop", "frame"}

_PRINTED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def real_text(value: float) -> str:
    """The shortest decimal that reads back, with a fraction or an exponent."""
    text = repr(float(value))
    return text if any(c in text for c in ".e") else text + ".0"


def atom_text(a: Atom) -> str:
    if a.kind == "string":
        return '"' + "".join(_PRINTED.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in a.value) + '"'
    if a.kind == "boolean":
        return "#t" if a.value else "#f"
    if a.kind == "real":
        return real_text(a.value)
    return str(a.value)


def inline(datum) -> str:
    return atom_text(datum) if isinstance(datum, Atom) else "(" + " ".join(map(inline, datum.items)) + ")"


def _default(child) -> bool:
    return isinstance(child, List) and len(child.items) == 2 and isinstance(child.items[1], Atom) and (child.tag, child.items[1].value) in DEFAULTS


def canonical(form: List) -> List:
    """The form with children in canonical order and without defaults."""
    tag = form.tag
    kept = [canonical(c) if isinstance(c, List) else c for c in form.items[1:] if not _default(c)]
    if tag in ("vertices", "edges", "value", "translation", "rotation", "scale"):
        ordered = kept
    elif tag == "accuracy":
        ordered = sorted(kept, key=inline)
    elif any(isinstance(c, List) for c in kept):
        listed = CHILDREN.get(tag) or (CLAIM_CHILDREN if any(isinstance(c, List) and c.tag == "source" for c in kept) else None)
        places = {name: k for k, name in enumerate(listed or [])}

        def key(c) -> tuple:
            if isinstance(c, Atom):
                return (-1, "")
            if listed is None:
                return (0, inline(c))
            if c.tag in places:
                return (places[c.tag], inline(c))
            return (len(places) + (c.tag == "assert"), inline(c))

        positional = [c for c in kept if isinstance(c, Atom)]
        ordered = positional + sorted((c for c in kept if isinstance(c, List)), key=key)
    else:
        ordered = kept
    return List([form.items[0], *ordered], form.line, form.column, form.comments, form.trailing)


def _commented(datum) -> bool:
    return isinstance(datum, List) and (bool(datum.trailing) or any(c.comments or _commented(c) for c in datum.items))


def _layout(datum, indent: int, closers: int) -> str:
    """``closers`` counts the parentheses that end on this datum's last line."""
    flat = inline(datum)
    if isinstance(datum, Atom) or (indent + len(flat) + closers <= 80 and not _commented(datum)):
        return flat
    pad = " " * (indent + 2)
    lines = ["(" + inline(datum.items[0])]
    for k, c in enumerate(datum.items[1:]):
        last = k == len(datum.items) - 2 and not datum.trailing
        lines += [pad + x for x in c.comments]
        lines.append(pad + _layout(c, indent + 2, closers + 1 if last else 0))
    if datum.trailing:
        lines += [pad + x for x in datum.trailing]
        return "\n".join(lines) + "\n" + " " * indent + ")"
    return "\n".join(lines) + ")"


def printed(forms: list[List], trailing: list[str] = ()) -> str:
    """The canonical text of a file."""
    order = {tag: k for k, tag in enumerate(TOP_ORDER)}
    done = sorted(map(canonical, forms), key=lambda f: (order.get(f.tag, len(order)), inline(f.items[1]).encode() if len(f.items) > 1 and isinstance(f.items[1], Atom) else b"", inline(f).encode()))
    out = [x for f in done for x in [*f.comments, _layout(f, 0, 0)]] + list(trailing)
    return "\n".join(out) + "\n" if out else ""


def formatted(text: str) -> str:
    return printed(*parse(text))


def distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close_to(name: str, known: list[str]) -> str | None:
    """The nearest known name, if it is near enough to be what was meant."""
    best = min(known, key=lambda k: (distance(name, k), k), default=None)
    return best if best is not None and distance(name, best) <= max(1, len(name) // 3) else None


def validate(forms: list[List]) -> list[tuple[int, int, str]]:
    """Faults of the shape of forms: unknown tags and children, arity, missing children."""
    out = []
    for form in forms:
        tag = form.tag
        if tag not in CHILDREN or tag in ("retired", "transform"):
            near = close_to(tag, TOP_ORDER)
            out.append((form.line, form.column, f"unknown form {tag}" + (f", did you mean {near}?" if near else "")))
            continue
        if tag != "project" and (len(form.items) < 2 or not isinstance(form.items[1], Atom)):
            out.append((form.line, form.column, f"{tag} has no name"))
        children = [c for c in form.items[1:] if isinstance(c, List)]
        for c in form.items[2 if tag != "project" else 1 :]:
            if isinstance(c, Atom):
                out.append((c.line, c.column, f"{tag} takes no plain value here"))
        seen: dict[str, List] = {}
        for c in children:
            if c.tag in CHILDREN[tag]:
                once = c.tag not in REPEATED or (tag != "type" and c.tag in ("kind", "geometry")) or tag == "route"
                if once and c.tag in seen:
                    out.append((c.line, c.column, f"{c.tag} is written twice in {tag}, first in line {seen[c.tag].line}"))
                seen.setdefault(c.tag, c)
            elif tag not in CLAIM_HOLDERS:
                near = close_to(c.tag, CHILDREN[tag])
                out.append((c.line, c.column, f"unknown child {c.tag} of {tag}" + (f", did you mean {near}?" if near else "")))
        out += [(form.line, form.column, f"{tag} lacks {name}") for name in sorted(REQUIRED[tag] - set(seen))]
    return out

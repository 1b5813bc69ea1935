"""Personal data: plain patterns, and disguised identifiers found through offset-preserving transducers.

The base patterns run on the source text. Then a chain of transducers rewrites the text: homoglyphs
become ASCII (one code point for one), runs of spelled digits become digits, and at/dot disguises become
``@`` and ``.``. Every rewritten character remembers the source range that it stands for, so that what the
same patterns find in the rewritten text maps back to source offsets. A span that touches a base span
is not added: base spans stay as they are.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; other
columns are ignored. Work is per row with no shuffle, so very long texts cost memory for one text only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import trimmed

KINDS = ("email", "ip", "card", "phone")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``_EMAIL.finditer``, but scanning only around each at sign."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns, by kind as listed, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Letters of other scripts that look like an ASCII letter, and their ASCII letters.
_LOOKS = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS "
    "οo αa ρp νv ιi ΟO ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΡP ΤT ΧX"
)
HOMOGLYPHS = {ord(pair[0]): pair[1] for pair in _LOOKS.split()}
HOMOGLYPHS |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
HOMOGLYPHS |= {zero + d: str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
HOMOGLYPHS |= {0xFE6B: "@", 0xFE52: ".", 0x2024: ".", 0x3002: ".", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x00A0: " "}
_GLYPH = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(HOMOGLYPHS)) + "]")

# The ten digits in English, German, French and Spanish.
_SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {word: str(d) for line in _SPELLED for d, word in enumerate(line.split())} | {"oh": "0"}
_DIGIT_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
#: Four spelled digits in a row at least, perhaps after a spelled plus.
_DIGIT_RUN = re.compile(rf"(?:(?<!\w)plus[ \t,.-]+)?(?<!\w)(?:{_DIGIT_WORD})(?:[ \t,-]+(?:{_DIGIT_WORD})){{3,}}(?!\w)", re.I)
_DIGIT_ONE = re.compile(rf"plus|{_DIGIT_WORD}", re.I)
_AT = r"[ \t]*[\[({<][ \t]*(?:at|@|arroba|klammeraffe)[ \t]*[\])}>][ \t]*"
_DOT = r"[ \t]*[\[({<][ \t]*(?:dot|punto|punkt|point|\.)[ \t]*[\])}>][ \t]*"
#: A bracketed at or dot, wherever it stands.
_BRACKET = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
#: Bare words count only in an address: labels and dots, an at, labels and dots, of which some are disguised.
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9._%+-]) at (?=[A-Za-z0-9-])|@", re.I)
_HOST = re.compile("[A-Za-z0-9-]+")
_WORD = re.compile(r"\w+")


class Rewritten:
    """A text with, for each character, the range of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.edits = text, None

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given ranges of the present text, which are in order and do not overlap."""
        if not edits:
            return
        starts, ends = self.edits or (range(len(self.text)), range(1, len(self.text) + 1))
        out, s, e, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:a])
            s.extend(starts[at:a])
            e.extend(ends[at:a])
            if new:
                out.append(new)
                s.extend([starts[a]] * len(new))
                e.extend([ends[b - 1]] * len(new))
            at = b
        self.text, self.edits = "".join(out), (s, e)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.edits is None else (self.edits[0][a], self.edits[1][b - 1])


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    if sum(map(_DIGITS.__contains__, _WORD.findall(text.lower()))) < 4:  # a run has four whole digit words at least
        return []
    out = []
    for m in _DIGIT_RUN.finditer(text):
        found = "".join("+" if w.lower() == "plus" else _DIGITS[w.lower()] for w in _DIGIT_ONE.findall(m.group()))
        out.append((m.start(), m.end(), found))
    return out


def _host_dots(text: str, at: int, dots: dict[int, int]) -> tuple[list[tuple[int, int]], bool]:
    """Bare dots of the host that begins at ``at``, and whether it has a label after a dot that is disguised or follows one."""
    bare, ends, disguised = [], _HOST.match(text, at), False
    while ends:
        k = ends.end()
        if k in dots:
            to, kind = dots[k], "bracket"
        elif text[k : k + 5].lower() == " dot ":
            to, kind = k + 5, "bare"
        elif text[k : k + 1] == ".":
            to, kind = k + 1, "plain"
        else:
            break
        ends = _HOST.match(text, to)
        if ends and kind != "plain":
            disguised = True
            if kind == "bare":
                bare.append((k, to))
    return bare, disguised


def _local_dots(text: str, at: int, dots: dict[int, int]) -> list[tuple[int, int]]:
    """Bare dots of the name that ends at ``at``; ``dots`` leads from the ends of bracketed dots to their starts."""
    bare = []
    while True:
        k = at
        while k and text[k - 1] in _LOCAL:
            k -= 1
        if k == at:
            return bare[:-1] if bare and bare[-1][0] == at else bare
        if k in dots:
            at = dots[k]
        elif k >= 5 and text[k - 5 : k].lower() == " dot ":
            bare.append((k - 5, k))
            at = k - 5
        else:
            return bare


def _sign_edits(text: str) -> list[tuple[int, int, str]]:
    found = {}
    if any(c in text for c in "[({<"):
        found = {m.span(): "@" if m["at"] else "." for m in _BRACKET.finditer(text)}
    low = text.lower()
    if found or " dot " in low:
        begins = {a: b for (a, b), new in found.items() if new == "."}
        ends = {b: a for a, b in begins.items()}
        signs = [(span, True) for span, new in found.items() if new == "@"]
        if " dot " in low or begins:
            signs += [(m.span(), m.group() == "@") for m in _BARE_AT.finditer(text)]
        for (a, b), sure in signs:
            bare, disguised = _host_dots(text, b, begins)
            if disguised or (sure and re.match(r"[A-Za-z0-9-]+\.[A-Za-z0-9-]", text[b : b + 300])):
                if not sure:
                    found[a, b] = "@"
                for span in bare + _local_dots(text, a, ends):
                    found[span] = "."
    out, end = [], 0
    for (a, b), new in sorted(found.items()):
        if a >= end:
            out.append((a, b, new))
            end = b
    return out


def _has_glyphs(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_GLYPH.search(text))
    return "\u00a0" in text


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """What the patterns find only after rewriting, as source spans that touch no base span."""
    rewritten = Rewritten(text.translate(HOMOGLYPHS) if _has_glyphs(text) else text)
    changed = rewritten.text is not text
    low = rewritten.text
    for edits in (_digit_edits, _sign_edits):
        found = edits(low)
        if found:
            rewritten.apply(found)
            low, changed = rewritten.text, True
    if not changed:
        return []
    taken = [(a, b) for _, a, b in base]
    out: list[Span] = []
    for kind, a, b in base_spans(rewritten.text):
        a, b = rewritten.source(a, b)
        if not any(a < y and x < b for x, y in taken):
            out.append((kind, a, b))
            taken.append((a, b))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    text = text or ""
    base = base_spans(text)
    return base, disguised_spans(text, base)


def joined(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge."""
    if text is None:
        return None
    base, added = find(text)
    out, at = [], 0
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts of base spans, their digest and all spans."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The documents with the spans of ``text_col`` replaced; all columns stay.

    ``size_col``, if given, gets the new number of characters of a text that was changed.
    """
    at, size = docs.columns.index(text_col), docs.columns.index(size_col) if size_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                old = batch.column(at).to_pylist()
                texts = [redact(t) for t in old]
                new = {at: texts}
                if size_col:
                    sizes = batch.column(size).to_pylist()
                    new[size] = [n if x == y else len(y) for n, x, y in zip(sizes, old, texts, strict=True)]
                arrays = [pa.array(new[n], batch.schema.field(n).type) if n in new else c for n, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)

"""Linear units and scalar expressions on ids, dates and hashes."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in one unit of each name.
METRES = {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "ft": 0.3048, "usft": 1200.0 / 3937.0}


def metres(unit: Column) -> Column:
    """Metres in one of a unit, null for a name that is no linear unit."""
    return F.create_map(*[F.lit(x) for pair in METRES.items() for x in pair])[unit]


def ratio(unit: Column, to: Column) -> Column:
    return F.when(unit == to, F.lit(1.0)).otherwise(metres(unit) / metres(to))


def namespace(id_: Column) -> Column:
    """What stands before the first colon, null if the id has none."""
    return F.when(F.instr(id_, ":") > 0, F.substring_index(id_, ":", 1))


def local(id_: Column) -> Column:
    return F.when(F.instr(id_, ":") > 0, F.substring(id_, F.instr(id_, ":") + 1, F.length(id_)))


def is_id(id_: Column) -> Column:
    """Namespace of ASCII letters, digits, - and _ that begins with a letter, a colon, and a local part."""
    return F.coalesce(id_.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:[^\s\"();']+$"), F.lit(False))


def full_date(text: Column) -> Column:
    """A date written as year-month-day in full, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def instant(text: Column) -> Column:
    """A timestamp with a stated offset, else null; -00:00 states none."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$") & ~text.endswith("-00:00")
    return F.when(shaped, F.try_to_timestamp(F.upper(text)))


def real(text: Column) -> Column:
    """A number written with a fraction or an exponent, else null."""
    shaped = text.rlike(r"^[+-]?\d+(\.\d+([eE][+-]?\d+)?|[eE][+-]?\d+)$")
    return F.when(shaped, text.try_cast("double"))


# The alphabet of 22-character global ids, in order.
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def compressed_uuid(raw: bytes) -> str:
    """128 bits as 22 characters, two bits first and six in each other."""
    value = int.from_bytes(raw, "big")
    return "".join(_ALPHABET[value >> shift & 63] for shift in range(126, -1, -6))


def global_id(url: str, id_: str) -> str:
    """The global id of an entity under a project's URL: a name-based UUID in a namespace made from the URL."""
    return compressed_uuid(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, url), id_).bytes)


def tree_digest(parts: list[tuple[str, bytes]]) -> str:
    """SHA-256 of files in path order, each path and content preceded by its length."""
    h = hashlib.sha256()
    for path, raw in sorted(parts):
        for piece in (path.encode(), raw):
            h.update(len(piece).to_bytes(8, "big") + piece)
    return h.hexdigest()

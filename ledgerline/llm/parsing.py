"""Repeated byte strings by prefix-free parsing and the suffix order that it gives.

A shard's segments are parsed into phrases that end where a rolling hash of ``TRIGGER`` bytes is 0 modulo
``MODULUS`` and overlap by those bytes. Suffixes are sorted in the dictionary of distinct phrases and in the
parse, both much shorter than repetitive text. No phrase suffix longer than the trigger is a proper prefix of
another, so the order of any two text positions is the order of their phrase suffixes and then, where those
are equal, of the parse behind them. In that corpus order equal strings stand side by side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ledgerline.llm import repeats, textvec
from ledgerline.llm.fmindex import suffix_order
from ledgerline.llm.segments import Routing

_U = np.uint64
WINDOW, TRIGGER, MODULUS = 400, 8, 48


def parse(data: np.ndarray, first: np.ndarray, trigger: int = TRIGGER, modulus: int = MODULUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (both in ``data``) and segment of every phrase, in text order.

    The last phrase of a segment ends with the segment's end, which counts as a symbol of its own; where a
    trigger stands there, that phrase is the trigger alone.
    """
    inside = np.flatnonzero(textvec.grams(data, trigger) % _U(modulus) == 0) + trigger
    # A trigger that reaches over a segment's start, or stands at its very start, ends no phrase.
    inside = inside[inside - trigger > first[np.searchsorted(first, inside, "left") - 1]]
    end = np.sort(np.concatenate([inside, first[1:]]))
    segment = np.searchsorted(first, end, "left") - 1
    fresh = np.concatenate([[True], segment[1:] != segment[:-1]])
    start = np.where(fresh, first[segment], np.concatenate([[0], end[:-1]]) - trigger)
    return start, end, segment


def _dictionary_ranks(symbols: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of phrases; position i has ``room[i]`` symbols to its phrase's end. Equal suffixes rank equal."""
    n, packed = len(symbols), 7
    key = np.zeros(n, np.uint64)
    for k in range(packed):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - k)] = symbols[k:]
        part[room <= k] = 0
        key = key << _U(9) | part
    order = np.argsort(key)
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)  # the place of the first of equals
    rank[order] = np.repeat(begin, size)
    # Only groups of equals of which one goes on are sorted further, each within its own places.
    step = packed
    live = order[np.repeat(size > 1, size)]
    while len(live):
        group = rank[live]
        on = room[live] > step
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, len(live)))
        keep = np.repeat(np.logical_or.reduceat(on, edge), size)
        live, group, on = live[keep], group[keep], on[keep]
        if not len(live):
            break
        following = np.zeros(len(live), np.int64)
        following[on] = rank[live[on] + step] + 1
        inner = np.argsort(group << 32 | following)
        live, group, following = live[inner], group[inner], following[inner]
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        fresh = opens | np.concatenate([[True], following[1:] != following[:-1]])
        at = np.arange(len(live))
        first, mine = np.flatnonzero(opens), np.flatnonzero(fresh)
        base = np.repeat(first, np.diff(np.append(first, len(live))))
        size = np.diff(np.append(mine, len(live)))
        rank[live] = group + np.repeat(at[mine], size) - base
        live = live[np.repeat(size > 1, size)]
        step *= 2
    return rank.astype(np.uint64)


def corpus_order(data: np.ndarray, first: np.ndarray, positions: np.ndarray, trigger: int = TRIGGER, modulus: int = MODULUS) -> np.ndarray:
    """``positions`` of ``data`` in the order of the suffixes of their segments; a segment's end ranks by position."""
    start, end, segment = parse(data, first, trigger, modulus)
    closing = np.concatenate([segment[1:] != segment[:-1], [True]])
    identity = textvec.range_hashes(data, start, end) << _U(1) | closing.astype(np.uint64)
    _, one, phrase = np.unique(identity, return_index=True, return_inverse=True)
    # The dictionary: bytes are 2 to 257, and a segment's end adds a 1 to its last phrase.
    size = end[one] - start[one] + closing[one]
    begin = np.concatenate([[0], np.cumsum(size)])
    which = np.repeat(np.arange(len(one)), size)
    offset = np.arange(begin[-1]) - begin[which]
    symbols = np.ones(begin[-1], np.uint64)
    real = offset < (end[one] - start[one])[which]
    symbols[real] = data[start[one][which[real]] + offset[real]].astype(np.uint64) + _U(2)
    rank = _dictionary_ranks(symbols, size[which] - offset)
    # The parse, with phrases in the order of the dictionary and a separator behind each segment.
    lead = rank[begin[:-1]]
    _, number = np.unique(lead, return_inverse=True)
    at = np.arange(len(phrase)) + segment
    text = np.zeros(len(phrase) + len(first) - 1, np.uint32)
    text[at] = number[phrase] + 1
    order = suffix_order(text)
    following = np.empty(len(text), np.uint64)
    following[order] = np.arange(len(text), dtype=np.uint64)
    # A position belongs to the phrase in which more than the trigger, or the segment's end, lies behind it.
    last = np.where(closing, end, end - trigger)
    own = np.searchsorted(last, positions, "right")
    key = rank[begin[phrase[own]] + positions - start[own]] << _U(32) | following[at[own] + 1]
    return positions[np.argsort(key)]


def repeated_spans(data: np.ndarray, first: np.ndarray, windows: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and end byte of the repeated ranges of a shard's segments."""
    row = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    positions = first[row] + at
    order = corpus_order(data, first, positions)
    content = textvec.grams(data, window)[order]  # neighbours with 400 bytes in common
    begin = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
    owner = np.searchsorted(first, order, "right") - 1
    total = np.add.reduceat(weights[owner], begin)
    twice = order[np.repeat(total > 1, np.diff(np.append(begin, len(order))))]
    hit = np.zeros(len(data) + 1, bool)
    hit[twice] = True
    hit = hit[positions]
    # Runs of repeated window starts within a segment.
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    opens = np.flatnonzero(hit & (fresh | ~np.concatenate([[False], hit[:-1]])))
    shuts = np.flatnonzero(hit & np.concatenate([fresh[1:] | ~hit[1:], [True]]))
    return row[opens], at[opens], at[shuts] + window


METHOD = repeats.Method(Routing(WINDOW, 32, 4 * WINDOW), False, repeated_spans, 3_000_000)


def method(window: int, gram: int = 32) -> repeats.Method:
    """The same for another window length."""

    def index(*shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return repeated_spans(*shard, window=window)

    return repeats.Method(Routing(window, min(gram, window), 4 * window), False, index, METHOD.shard_units)


def deduplicated(docs: DataFrame, m: repeats.Method = METHOD) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs and the digest of the bytes kept."""
    return repeats.digests(docs, m).withColumnRenamed("n_units", "n_bytes")

"""Content routing of repeated windows: equal windows of documents meet in one group without any pair of documents.

A window is ``window`` consecutive units (words or bytes). Its anchor is the least hash of the ``gram``-unit
strings inside it, so equal windows have equal anchors wherever they stand. A segment is a run of windows of
one document with one anchor; it is known by the hash of its units. This module finds the segments of Arrow
text columns; ``repeats`` routes them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ledgerline.llm import textvec

_U = np.uint64


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values, in logarithmically many passes."""
    span, now = 1, values
    while span * 2 <= n:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    return now if span == n else np.minimum(now[: len(values) - n + 1], now[n - span :])


@dataclass(frozen=True)
class Routing:
    window: int
    gram: int
    most: int  # windows of a segment at most


def segments(codes: np.ndarray, first: np.ndarray, r: Routing, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Anchor, segment hash, document, first unit in the document, number of windows and of anchors of every segment.

    ``codes`` are the units of some documents, document d having the units first[d] to first[d + 1], as 64-bit
    codes or bytes. Without ``hashed`` the segment hashes are 0. A segment in which the anchor stands more than
    once counts 2 anchors: it may repeat a window by itself.
    """
    n = len(codes) - r.window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    grams, width = textvec.grams(codes, r.gram), r.window - r.gram + 1
    # The first and the last place of the least gram of each window: places fill the low bits of the hashes.
    low = _U((1 << max(20, len(grams).bit_length())) - 1)
    places = np.arange(len(grams), dtype=np.uint64)
    high = grams & ~low
    first_place = (sliding_least(high | places, width) & low).astype(np.int64)
    last_place = (low - (sliding_least(high | (low - places), width) & low)).astype(np.int64)
    anchors = grams[first_place]
    row = textvec.row_of(first, len(codes))
    inside = row[:n] == row[r.window - 1 :]
    fresh = np.ones(n, bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (row[1:n] != row[: n - 1])
    at = np.flatnonzero(fresh & inside)
    begin = np.flatnonzero(fresh | ~inside)
    end = np.append(begin, n)[np.searchsorted(begin, at, "right")]
    size = end - at
    long = np.flatnonzero(size > r.most)
    if len(long):  # of very repetitive text
        parts = -(-size // r.most)
        which = np.repeat(np.arange(len(at)), parts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = at[which] + number * r.most
        size = np.minimum(r.most, end[which] - start)
        at = start
    hashes = np.zeros(len(at), np.uint64) if not hashed else textvec.range_hashes(codes, at, at + size + r.window - 1)
    doc = row[at]
    twice = first_place[at] != last_place[at + size - 1]
    return anchors[at], hashes, doc, at - first[doc], size, 1 + twice.astype(np.int64)

"""Repeated word passages by matching statistics over a compressed FM-index per shard.

The words of a shard's segments are indexed once. Then all segments are streamed against the index at the same
time: from an end, the match grows backwards through the wavelet ranks for as long as it has a second
occurrence (the weights of the suffixes in the interval say how many copies stand behind them). Its length is
the matching statistic of that end; every window inside a match of 35 words or more is repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ledgerline.llm import repeats
from ledgerline.llm.fmindex import FMIndex
from ledgerline.llm.segments import Routing

WINDOW = 35


def matching_spans(hashes: np.ndarray, first: np.ndarray, windows: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and end word of the repeated ranges of a shard's segments."""
    n = len(windows)
    vocabulary, coded = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(first))
    text = np.zeros(len(hashes) + n, np.uint32)  # one separator after each segment
    where = np.arange(len(hashes)) + row
    text[where] = coded + 1
    index = FMIndex(text, len(vocabulary) + 1, sample=0)
    weight = np.zeros(len(text), np.int64)
    weight[where] = weights[row]
    copies = np.concatenate([[0], np.cumsum(weight[index.order])])

    base = first[:-1] + np.arange(n)
    end = np.diff(first).astype(np.int64)
    depth, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(end >= window)
    while len(live):
        at = end[live] - depth[live]
        room = at > 0
        a, b = index.extend(text[base[live] + np.maximum(at - 1, 0)], low[live], high[live])
        grows = room & (copies[b] - copies[np.minimum(a, b)] >= 2)
        on = live[grows]
        low[on], high[on] = a[grows], b[grows]
        depth[on] += 1
        off = live[~grows]
        if len(off):
            enough = depth[off] >= window
            hit = off[enough]
            if len(hit):
                out.append((hit, end[hit] - depth[hit], end[hit]))
            # The next end whose window is not inside this match.
            end[off] -= np.where(enough, depth[off] - window + 1, 1)
            depth[off], low[off], high[off] = 0, 0, len(text)
            live = live[end[live] >= window]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


METHOD = repeats.Method(Routing(WINDOW, 8, 112), True, matching_spans, 1_500_000)


def method(window: int, gram: int = 8) -> repeats.Method:
    """The same for another window length."""

    def index(*shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return matching_spans(*shard, window=window)

    return repeats.Method(Routing(window, min(gram, window), 4 * window), True, index, METHOD.shard_units)


def deduplicated(docs: DataFrame, m: repeats.Method = METHOD) -> DataFrame:
    """One row per document: words, removed words and the digest of the words kept."""
    return repeats.digests(docs, m).select("doc_id", "n_units", "n_removed", "kept_sha256").withColumnRenamed("n_units", "n_words")

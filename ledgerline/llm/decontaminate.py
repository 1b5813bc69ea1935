"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow batch of documents. Its words are coded by the vocabulary of the benchmark; runs of
such words that are long enough for a window become the fragments of the shard's FM-index. Every distinct
benchmark window is searched backwards through the wavelet ranks, its occurrences are located by sampled
suffix positions, and the word ranges that they cover are merged into removal spans.

Nothing is shuffled: documents stay where they are read, and the coded benchmark goes to the executors.
Its size is checked first; a benchmark of more than ``BLOCK_BYTES`` of text is dealt to several blocks that
pass over the documents one after the other, so memory does not grow with it: a block has a window for about six
bytes of text, and some 50 bytes are held for each.

Defined results: null texts have no words; items without words have no windows; items of one id count
once; an item with a null id is called "null"; repeated documents give repeated rows; a very long text is part of
its shard whole; there are no ties, since every occurrence counts; all columns of the documents stay, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import textvec
from ledgerline.llm.common import trimmed, unused
from ledgerline.llm.fmindex import FMIndex, expanded

WINDOW = 8
BLOCK_BYTES = 16 << 20
_SIEVE = 16


class Phrases:
    """The distinct windows of some items, coded by the items' own vocabulary (symbols from 1)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, bounds = textvec.flat(pa.array([t for _, t in items], pa.string()))
        words = textvec.Words(data, bounds, textvec.NON_ALNUM, lower=True)
        self.vocabulary, coded = np.unique(words.hashes, return_inverse=True)
        self.sigma = len(self.vocabulary) + 1
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[self.vocabulary & np.uint64((1 << _SIEVE) - 1)] = True
        self.items = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        owner = np.array([number[name] for name, _ in items], np.int32)[textvec.row_of(words.first, len(coded))]
        coded = (coded + 1).astype(np.uint32)
        sizes, row = np.minimum(words.counts, window), textvec.row_of(words.first, len(coded))
        self.windows = []  # of each length: patterns, and the items of each pattern as offsets and numbers
        for size in np.unique(sizes[sizes > 0]).tolist():
            n = len(coded) - size + 1
            at = np.flatnonzero((sizes[row[:n]] == size) & (row[:n] == row[size - 1 :]))
            found = np.lib.stride_tricks.sliding_window_view(coded, size)[at]
            order = np.lexsort([owner[at], *found.T[::-1]])
            found, mine = found[order], owner[at][order]
            fresh = np.concatenate([[True], (found[1:] != found[:-1]).any(1)])
            once = fresh | np.concatenate([[True], mine[1:] != mine[:-1]])
            begin = np.flatnonzero(fresh[once])
            self.windows.append((found[fresh], np.append(begin, int(once.sum())), mine[once]))
        self.least = min((p.shape[1] for p, _, _ in self.windows), default=0)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for those that no item has."""
        out = np.zeros(len(hashes), np.uint32)
        maybe = np.flatnonzero(self.sieve[hashes & np.uint64((1 << _SIEVE) - 1)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes[maybe]
        out[maybe[known]] = at[known] + 1
        return out


def occurrences(phrases: Phrases, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one shard: words per document; merged spans (document, first word, end word, first byte, end byte); pairs (document, item)."""
    data, bounds = textvec.flat(column)
    n_words = np.zeros(len(column), np.int64)
    texts, docs, places, first, last = [], [], [], [], []
    for a, b in textvec.slices(bounds):
        words = textvec.Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], textvec.NON_ALNUM, lower=True)
        n_words[a:b] = words.counts
        if not phrases.least or not len(words.hashes):
            continue
        coded, row = phrases.code(words.hashes), textvec.row_of(words.first, len(words.hashes))
        broken = np.concatenate([[True], (row[1:] != row[:-1]) | (coded[:-1] == 0)]) | (coded == 0)
        starts = np.flatnonzero(broken)
        ends = np.append(starts[1:], len(coded))
        good = (coded[starts] > 0) & (ends - starts >= phrases.least)
        at, which = expanded(starts[good], ends[good])
        if not len(at):
            continue
        where = np.arange(len(at)) + which  # one separator before each further fragment
        text, back = np.zeros(where[-1] + 2, np.uint32), np.full(where[-1] + 2, -1, np.int64)
        text[where], back[where] = coded[at], at
        held = np.maximum(back, 0)
        texts.append(text)
        docs.append(row[held] + a)
        places.append(held - words.first[row[held]])
        first.append(words.starts[held] + bounds[a] - bounds[row[held] + a])
        last.append(words.ends[held] + bounds[a] - bounds[row[held] + a])
    empty = np.zeros((0, 5), np.int64)
    if not texts:
        return n_words, empty, [np.zeros((0, 2), np.int64)]
    docs, places, first, last = (np.concatenate(x) for x in (docs, places, first, last))
    index = FMIndex(np.concatenate(texts), phrases.sigma)
    spans, pairs = [empty[:, :4]], [np.zeros((0, 2), np.int64)]
    for patterns, offsets, items in phrases.windows:
        low, high = index.search(patterns)
        rows, which = expanded(low, high)
        if not len(rows):
            continue
        at = index.locate(rows)
        end = at + patterns.shape[1] - 1
        spans.append(np.stack([docs[at], places[at], at, end], 1))
        owner, of = expanded(offsets[which], offsets[which + 1])
        pairs.append(np.unique(np.stack([docs[at][of], items[owner]], 1), axis=0))
    found = np.concatenate(spans)
    if not len(found):
        return n_words, empty, pairs
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    ends = found[:, 1] + found[:, 3] - found[:, 2] + 1
    reach = np.maximum.accumulate(found[:, 0] * (1 << 40) + ends)  # the furthest end so far, within the document
    begin = np.concatenate([[True], found[1:, 0] * (1 << 40) + found[1:, 1] > reach[:-1]])
    group = np.flatnonzero(begin)
    stop = np.append(group[1:], len(found)) - 1
    furthest = group + np.array([int(np.argmax(ends[x : y + 1])) for x, y in zip(group, stop, strict=True)], np.int64)
    merged = np.stack([found[group, 0], found[group, 1], ends[furthest], first[found[group, 2]], last[found[furthest, 3]]], 1)
    return n_words, merged, pairs


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """Number, count and items of blocks of about ``block_bytes`` of text, which the driver holds one at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield k, n, [(r.name, r.text) for r in part.toLocalIterator()]


#: What ``scan`` adds, under these names or, where documents have them, under others like them (``unused``).
ADDED = ("decon_words", "decon_hits", "decon_items")


Finish = Callable[[pa.RecordBatch], pa.RecordBatch]


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, finish: tuple[Finish, T.StructType] | None = None
) -> DataFrame:
    """The documents with three more columns (``ADDED``): words, merged hit spans (of words and of UTF-8 bytes), and sorted item names.

    ``finish`` is a last step on the batches, in the same Python process, and its schema.
    """
    spark = docs.sparkSession
    names = unused(docs, *ADDED)
    spans = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("first", T.IntegerType()), ("end", T.IntegerType()), ("byte_first", T.LongType()), ("byte_end", T.LongType()))]))
    added = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), spans, T.ArrayType(T.StringType())), strict=True)]
    at = docs.columns.index(text_col)
    out = docs
    for number, blocks, items in _blocks(benchmark, item_col, text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Phrases(items, window))
        last = finish if number == blocks - 1 else None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=bool(number), last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _added(shared.value, batch, at, later, names)
                yield last[0](found) if last else found

        out = out.mapInArrow(trimmed(run), last[1] if last else T.StructType([*docs.schema.fields, *added]))
    return out


def _added(phrases: Phrases, batch: pa.RecordBatch, at: int, later: bool, added: list[str]) -> pa.RecordBatch:
    """A batch with its hits, or, for a later block of items, with more hits than before."""
    n_words, merged, pairs = occurrences(phrases, batch.column(at))
    hits: list[list] = [[] for _ in range(batch.num_rows)]
    names: list[set] = [set() for _ in range(batch.num_rows)]
    for doc, *span in merged.tolist():
        hits[doc].append(span)
    for found in pairs:
        for doc, item in found.tolist():
            names[doc].add(phrases.items[item])
    if later:
        for k, (old, more) in enumerate(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
            hits[k] = _union([*map(list, (tuple(h.values()) for h in old)), *hits[k]])
            names[k] |= set(more)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("byte_first", pa.int64()), ("byte_end", pa.int64())]))
    keys = ("first", "end", "byte_first", "byte_end")
    own = [
        pa.array(n_words),
        pa.array([[dict(zip(keys, s, strict=True)) for s in h] for h in hits], kind),
        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
    ]
    before = batch.columns[: batch.num_columns - 3 * later]
    return pa.RecordBatch.from_arrays([*before, *own], [*batch.schema.names[: len(before)], *added])


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            if span[1] > out[-1][1]:
                out[-1][1], out[-1][3] = span[1], span[3]
        else:
            out.append(span)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, their digest and the verdict."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("decon_hits", F.lit(0).cast("long"), lambda total, h: total + (h["end"] - h["first"]))
    return found.select(
        "doc_id",
        F.col("decon_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decon_items", ","), 256).alias("items_sha256"),
        (F.size("decon_items") >= least_items).alias("contaminated"),
    )


def removed(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_items: int | None = None, size_col: str | None = None) -> DataFrame:
    """The documents with every removal span cut out of the text; all columns stay.

    With ``drop_items``, documents in which windows of so many items occur are dropped whole, and so are those
    of which no word is left. ``size_col``, if given, gets the new number of characters of a text that was cut.
    """
    at, size = docs.columns.index(text_col), docs.columns.index(size_col) if size_col else -1

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, hits, items = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
        counts = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        keep = np.ones(batch.num_rows, bool) if drop_items is None else counts < drop_items
        touched = np.flatnonzero(keep & (counts > 0))
        new: dict[int, list] = {at: [], size: []}
        for k in touched.tolist():
            raw, to, out, gone = batch.column(at)[k].as_py().encode(), 0, [], 0
            for h in hits[k].as_py():
                out.append(raw[to : h["byte_first"]])
                to, gone = h["byte_end"], gone + h["end"] - h["first"]
            new[at].append(b"".join([*out, raw[to:]]).decode())
            new[size].append(len(new[at][-1]))
            keep[k] = drop_items is None or gone < words[k].as_py()
        mask = np.zeros(batch.num_rows, bool)
        mask[touched] = True
        kinds = [c for c in (at, size) if c >= 0]
        columns = batch.columns[:-3]
        for c in kinds:
            columns[c] = pc.replace_with_mask(columns[c], pa.array(mask), pa.array(new[c], columns[c].type))
        return pa.RecordBatch.from_arrays(columns, batch.schema.names[:-3]).filter(pa.array(keep))

    return scan(docs, benchmark, text_col, finish=(cut, docs.schema))


def kept(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, text_col: str = "text") -> DataFrame:
    """The documents in which windows of fewer than ``least_items`` items occur; all columns stay."""
    added = unused(docs, *ADDED)
    return scan(docs, benchmark, text_col).where(F.size(added[2]) < least_items).drop(*added)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

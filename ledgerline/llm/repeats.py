"""Removal of long repeated passages: windows that occur twice anywhere in the corpus.

Documents become segments (see ``segments``) of which only hashes are exchanged at first. Anchors that stand
once are done with. Of the others, equal segments are added up, and the units of one copy of each go to the
shard of its anchor, where an index of the shard finds the windows that occur more than once; the index is a
parameter (an FM-index over words, or suffix order from prefix-free parsing over bytes). What it finds goes
back to all copies, and every document is cut once.

An anchor with more different segments than a shard is meant to hold, such as the words before and after a
passage that a large share of all documents quote, is not sent to one shard: its windows are told apart by their hashes,
which are added up before they are exchanged. So no group is held by one task, whatever the corpus.

Texts are exchanged once, by 128 bits of hashes of id and text, for both the fetch of units and the final cut.
Hashes of segments and windows have 64 bits beside their anchor's 64; none is a polynomial, so texts made of
self-similar words (Thue-Morse) are told apart like any others.

Defined results: a null text counts as empty; repeated rows count as occurrences of each other; null ids and
further columns do not matter, and columns of the names used here are not read; a very long text is cut into
segments like any other, so no task holds more than the text itself and one shard; where windows tie for the
least gram the first place counts, in every copy alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import segments, textvec
from ledgerline.llm.common import row_keys, written

#: Shard contents: code of every unit, first unit of every segment, windows and weight (1 or 2) of every segment.
#: Returns arrays (segment, first unit, end unit) of repeated ranges.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Method:
    routing: segments.Routing
    words: bool
    index: Index
    shard_units: int
    hot: int | None = None

    @property
    def most_segments(self) -> int:
        """Different segments of one anchor that a shard takes: as many as fit it, at two windows' length each."""
        return self.hot if self.hot is not None else self.shard_units // (2 * self.routing.window)


def _units(column: pa.Array, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a column: first row, unit codes, first unit of each row, and byte starts and ends of units in the slice's bytes."""
    data, bounds = textvec.flat(column)
    for a, b in textvec.slices(bounds):
        part, edges = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        if words:
            found = textvec.Words(part, edges, textvec.SPACE, lower=False)
            yield a, part, found.hashes, found.first, np.stack([found.starts, found.ends])
        else:
            yield a, part, part, edges, np.zeros((2, 0), np.int64)


def find_anchors(texts: DataFrame, m: Method) -> DataFrame:
    """Rows (anchor, anchors) of the segments of (text), summed over the rows of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, codes, first, _ in _units(batch.column(0), m.words):
                anchor, _, _, _, _, anchors = segments.segments(codes, first, m.routing, hashed=False)
                if len(anchor):
                    own, where = np.unique(anchor, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(where, anchors).astype(np.int64))], ["anchor", "anchors"])

    return texts.select("text").mapInArrow(run, "anchor long, anchors long")


def find_segments(texts: DataFrame, m: Method) -> DataFrame:
    """Rows (key, key2, anchor, seg, start, n) of the segments of (key, key2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, _, codes, first, _ in _units(batch.column(2), m.words):
                anchor, seg, doc, start, n, _ = segments.segments(codes, first, m.routing)
                if len(doc):
                    columns = keys[a + doc], more[a + doc], anchor.view(np.int64), seg.view(np.int64), start.astype(np.int32), n.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "key2", "anchor", "seg", "start", "n"])

    return texts.select("key", "key2", "text").mapInArrow(run, "key long, key2 long, anchor long, seg long, start int, n int")


def _cut(fetched: DataFrame, m: Method) -> DataFrame:
    """Rows (anchor, seg, copies, n, units) from texts and their wanted segments; words are joined by one space."""
    window = m.routing.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                for text, wanted in zip(*(batch.column(k).slice(at, 256).to_pylist() for k in (0, 1)), strict=True):
                    raw = (text or "").encode()
                    units = raw.split() if m.words else raw
                    for w in wanted:
                        own = units[w["start"] : w["start"] + w["n"] + window - 1]
                        rows.append((w["anchor"], w["seg"], w["copies"], w["n"], b" ".join(own) if m.words else own))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "seg", "copies", "n", "units"])

    # The id goes along, so that this exchange of the texts is the one of the final cut.
    return fetched.select("text", "wanted", "id").mapInArrow(run, "anchor long, seg long, copies long, n int, units binary")


_SPANS = "anchor long, seg long, spans array<struct<first:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _span_rows(anchor: np.ndarray, seg: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row of each segment that has spans; ``row`` is the segment of each span."""
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order].astype(np.int32), end[order].astype(np.int32)
    own, begin = np.unique(row, return_index=True)
    items = pa.StructArray.from_arrays([pa.array(first), pa.array(end)], ["first", "end"])
    lists = pa.ListArray.from_arrays(np.append(begin, len(row)).astype(np.int32), items)
    return pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(seg[own]), lists.cast(_SPAN_TYPE)], ["anchor", "seg", "spans"])


def _indexed(payload: DataFrame, m: Method) -> DataFrame:
    """Spans of the segments, found by indexes of whole anchors with about ``shard_units`` units each."""

    def shard(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.concat_batches(rows)
        anchor, seg, copies, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        _, once = np.unique(np.stack([anchor, seg]), axis=1, return_index=True)  # a text that stands twice was fetched twice
        once.sort()
        batch, anchor, seg, copies, n = batch.take(pa.array(once)), anchor[once], seg[once], copies[once], n[once].astype(np.int64)
        data, bounds = textvec.flat(batch.column(4))
        if m.words:
            parts = []
            for a, b in textvec.slices(bounds):
                found = textvec.Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], textvec.SPACE, lower=False)
                parts.append((found.hashes, found.counts))
            codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = np.concatenate([[0], np.cumsum(counts)])
        else:
            codes, first = data, bounds
        row, start, end = m.index(codes, first, n, np.minimum(copies, 2))
        if len(row):
            yield _span_rows(anchor, seg, row, start, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                units = part.column(3).to_numpy(zero_copy_only=False) + m.routing.window - 1
                if size + units.sum() > m.shard_units and held:
                    edge = int(np.argmax(np.append(keys != last, True)))  # the first row of another anchor
                    if edge:
                        held.append(part.slice(0, edge))
                    if edge < part.num_rows:
                        yield from shard(held)
                        held, size = [], 0
                    part, keys, units = part.slice(edge), keys[edge:], units[edge:]
                if part.num_rows:
                    held.append(part)
                    size, last = size + int(units.sum()), keys[-1]
        if held:
            yield from shard(held)

    return payload.repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(run, _SPANS)


def _counted(payload: DataFrame, m: Method) -> DataFrame:
    """Spans of the segments of hot anchors, by the sums of equal windows."""
    window = m.routing.window

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, codes, first, _ in _units(batch.column(4), m.words):
                n = np.diff(first) - window + 1
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = first[row] + at
                keys = textvec.grams(codes, window)[begin].view(np.int64)
                columns = [batch.column(k).to_numpy(zero_copy_only=False)[a + row] for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(at.astype(np.int32)), pa.array(keys)], ["anchor", "seg", "copies", "at", "content"])

    # Not a written table: within one plan the exchange of the texts is shared. Windows are made twice, and summed before an exchange.
    once = payload.dropDuplicates(["anchor", "seg"])
    found = once.mapInArrow(windows, "anchor long, seg long, copies long, at int, content long")
    twice = found.groupBy("anchor", "content").agg(F.sum("copies").alias("all")).where("all > 1").select("anchor", "content")
    span = F.struct(F.col("at").alias("first"), (F.col("at") + window).cast("int").alias("end"))
    return found.join(twice, ["anchor", "content"], "left_semi").groupBy("anchor", "seg").agg(F.collect_list(span).alias("spans"))


def repeated(docs: DataFrame, m: Method, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, found): for every row of ``docs`` its repeated ranges of units, as first units and their spans, or null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(*row_keys(id_col, text_col), F.col(id_col).alias("id"), text.alias("text"))
    shared = find_anchors(texts, m).groupBy("anchor").agg(F.sum("anchors").alias("c")).where("c > 1").select("anchor")
    held = written(find_segments(texts, m).join(shared, "anchor", "left_semi"), "segments")
    kinds = written(held.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("key", "key2", "start", "n")).alias("at")), "kinds")
    crowded = kinds.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > m.most_segments).select("anchor")
    by_key = texts.repartition("key", "key2")

    def payload(chosen: DataFrame) -> DataFrame:
        wanted = chosen.groupBy(F.col("at.key").alias("key"), F.col("at.key2").alias("key2")).agg(F.collect_list(F.struct("anchor", "seg", "copies", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("wanted"))
        return _cut(by_key.join(wanted, ["key", "key2"]), m)

    if crowded.head(1):
        spans = _indexed(payload(kinds.join(crowded, "anchor", "left_anti")), m).unionAll(_counted(payload(kinds.join(crowded, "anchor", "left_semi")), m))
    else:
        spans = _indexed(payload(kinds), m)
    found = held.join(spans, ["anchor", "seg"]).groupBy("key", "key2").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    return by_key.join(found, ["key", "key2"], "left").select("id", "text", "found")


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges of units in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((f["start"] + s["first"], f["start"] + s["end"]) for f in found or () for s in f["spans"]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]], words: bool) -> tuple[bytes, int, int]:
    """What is kept of a text, its number of units and the number removed."""
    units = raw.split() if words else raw
    at, parts = 0, []
    for a, b in [*spans, (len(units), len(units))]:
        parts.append(units[at:a])
        at = b
    kept = b" ".join([w for p in parts for w in p]) if words else b"".join(parts)
    return kept, len(units), sum(b - a for a, b in spans)


def digests(docs: DataFrame, m: Method) -> DataFrame:
    """Rows (doc_id, n_units, n_removed, n_spans, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = _merged(found)
                kept, n, removed = cut(text.encode(), spans, m.words)
                rows.append((n, removed, len(spans), hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return repeated(docs, m).mapInArrow(run, f"doc_id {kind}, n_units long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, m: Method, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, kept, spans): what is kept of every text, and the removed ranges of units.

    Bytes that are no whole characters after a cut become replacement characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merged(f) for f in batch.column(2).to_pylist()]
            kept = [cut(t.encode(), s, m.words)[0].decode("utf-8", "replace") for t, s in zip(batch.column(1).to_pylist(), spans, strict=True)]
            lists = pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), lists], ["id", "kept", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return repeated(docs, m, id_col, text_col).mapInArrow(run, f"id {kind}, kept string, spans array<struct<first:int,end:int>>")

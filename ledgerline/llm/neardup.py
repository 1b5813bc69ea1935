"""Near-duplicate documents: MinHash bands propose, odd sketches verify, full shingle sets confirm.

1. Every document gets the size and a 128-bit digest of its shingle set, ``BANDS`` band keys of ``ROWS``
   MinHash values each, and an odd sketch: the parities of its samples, folded into ``SKETCH`` bits. Two
   documents with a Jaccard similarity of 0.85 share no band with a probability below 1e-7.
2. Documents of one set are one class, known by its smallest id and the digest of the set (its node); from here
   on only one row stands for it. Rows are known by 128 bits of hashes of id and text, never by their id alone.
3. In each bucket of a band that has several members, a hub is chosen by aggregation, and every member is
   compared with the hub, so a bucket of n members gives n pairs. Pairs whose sketches rule them out are
   dropped; the rest are confirmed by the full sets, and components are formed.
4. Members of one bucket that are in different components by now are compared with each other, in blocks of
   bounded size: by size, by sketch and by the full sets, and only links leave a task, at most one for two
   components. So no link between different components is lost, while a group of near copies, most of which
   has become one component in step 3, is not compared pair by pair again.

Components grow by alternating large-star and small-star steps over written tables. Nothing but counts
reaches the driver.

Defined results: a null or empty text has no shingles and is its own component; a document with fewer words
than a shingle has its whole sequence as the one shingle; rows with a null id link with nothing and have a
null component, kept false; repeated rows get the same answer; rows that share an id are one document to
``duplicates``, which joins what any of their texts is linked with, and rows of their own to ``kept``; a very
long text is one set, held by one task; a tie for the smallest of a component cannot be, as ids with digests
are unique; ids keep their type; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import textvec
from ledgerline.llm.common import row_keys, trimmed, unused, written
from ledgerline.operators.components import components

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    percent: int = 85
    bands: int = 28
    rows: int = 5
    sketch: int = 512
    block: int = 512

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def slack(self) -> float:
        """The least similarity that a sketch may show: the threshold less five standard errors of the samples."""
        p = self.percent / 100
        return p - 5 * math.sqrt(p * (1 - p) / self.samples) - 0.02


DEFAULT = Settings()


def _sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and their offsets; hashes keep 52 bits."""
    words = textvec.Words(data, bounds, textvec.SPACE, lower=True)
    n, counts = len(words.hashes), words.counts
    rows, values = [], []
    if n >= k:
        row = textvec.row_of(words.first, n)
        inside = row[: n - k + 1] == row[k - 1 :]
        rows.append(row[: n - k + 1][inside])
        values.append(textvec.grams(words.hashes, k)[inside])
    for few in range(1, k):
        at = np.flatnonzero(counts == few)
        if len(at):
            first = words.first[at]
            value = np.full(len(at), few, np.uint64)
            for j in range(few):
                value = textvec.mix(value * _U(0x9E3779B97F4A7C15) + words.hashes[first + j])
            rows.append(at)
            values.append(value)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    row, value = np.concatenate(rows), np.concatenate(values)
    key = np.sort(row.astype(np.uint64) << _U(52) | value >> _U(12))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _U((1 << 52) - 1), np.searchsorted(key >> _U(52), np.arange(len(bounds), dtype=np.uint64))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: the first row, the sets' values and their offsets."""
    data, bounds = textvec.flat(column)
    for a, b in textvec.slices(bounds):
        yield a, *_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], k)


def _samplers(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(21))
    return g.integers(0, 2**32, n, dtype=np.uint32), g.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)


def minhashes(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples of each set; sets without values get the largest value."""
    out = np.full((n, len(first) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        starts, short = first[full], (textvec.mix(values) >> _U(32)).astype(np.uint32)
        room = np.empty_like(short)
        for k, (flip, odd) in enumerate(zip(*_samplers(n), strict=True)):
            np.bitwise_xor(short, flip, out=room)
            room *= odd
            room ^= room >> np.uint32(15)
            room *= np.uint32(0x2C1B3C6D)
            out[k, full] = np.minimum.reduceat(room, starts)
    return out


def band_keys(samples: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key of each band, with the band's number folded in."""
    out = np.empty((s.bands, samples.shape[1]), np.uint64)
    for band in range(s.bands):
        key = np.full(samples.shape[1], band + 1, np.uint64)
        for row in samples[band * s.rows : (band + 1) * s.rows]:
            key = textvec.mix(key * _U(0x9E3779B97F4A7C15) ^ row.astype(np.uint64))
        out[band] = key
    return out


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of the numbered samples, as bytes."""
    n = samples.shape[1]
    out = np.zeros((n, bits), np.uint8)
    who = np.arange(n)
    for k, row in enumerate(samples):
        at = (textvec.mix(row.astype(np.uint64) << _U(16) | _U(k)) % _U(bits)).astype(np.int64)
        out[who, at] ^= 1
    return np.packbits(out, axis=1)


def most_different_bits(s: Settings) -> int:
    """The population count of an XOR at which the estimate falls to the slack.

    Of n samples n (1 - J) differ, 2 n (1 - J) elements are in one set only, and they leave
    bits (1 - exp(-2 x / bits)) / 2 odd positions (Mitzenmacher, Pagh and Pham 2014).
    """
    apart = 2 * s.samples * (1 - s.slack)
    return math.ceil(s.sketch * (1 - math.exp(-2 * apart / s.sketch)) / 2)


def signatures(docs: DataFrame, s: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, key, key2, n_shingles, set_a, set_b, bands, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, values, first in shingle_sets(batch.column(3), s.shingle):
                n = len(first) - 1
                samples = minhashes(values, first, s.samples)
                digests = []
                for salt in (1, 2):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(textvec.mix(values * _U(2) + _U(salt)) * _U(2 * salt + 1), out=total[1:])
                    digests.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
                bands = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * s.bands, np.ascontiguousarray(band_keys(samples, s).T).view(np.int64).ravel())
                sketch = pa.array([row.tobytes() for row in odd_sketches(samples, s.sketch)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, n) for k in range(3)), pa.array(np.diff(first)), *digests, bands, sketch], names)

    names = ["id", "key", "key2", "n_shingles", "set_a", "set_b", "bands", "sketch"]
    rows = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), f"id {rows.schema['id'].dataType.simpleString()}, key long, key2 long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


def _pairs_schema(node: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("a", node), T.StructField("b", node)])


def _confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has (id, text)."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = np.zeros(part.num_rows, bool)
                left, right = (_columns(part.column(k), s.shingle) for k in (2, 3))
                for k, (x, y) in enumerate(zip(left, right, strict=True)):
                    good[k] = _similar(x, y, s)
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), _pairs_schema(pairs.schema["a"].dataType))


def _columns(column: pa.Array, k: int) -> list[np.ndarray]:
    return [values[first[i] : first[i + 1]] for _, values, first in shingle_sets(column, k) for i in range(len(first) - 1)]


def _close(a: Column, b: Column, s: Settings) -> Column:
    """Whether two sketches leave the pair possible: population count of their XOR, eight bytes at a time."""
    parts = [F.bit_count(F.conv(F.substring(F.hex(a), 15 * k + 1, 15), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(F.hex(b), 15 * k + 1, 15), 16, 10).cast("long"))) for k in range(-(-s.sketch // 60))]
    return reduce(lambda x, y: x + y, parts) <= most_different_bits(s)


def _compared(members: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between members of one bucket and different components.

    ``members`` has (bucket, id, component, n_shingles, bands, sketch, text). A bucket is dealt to blocks of
    about ``block`` members; every two blocks meet in a group of their own, so no task holds more than two
    blocks of a bucket at a time. Two members are compared in the first bucket that they share only: sizes
    and sketches first, then the full sets. A link joins two components for the rest of the group, so a group
    gives fewer links than it has members.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    n = F.ceil(F.col("size") / s.block).cast("int")
    dealt = members.join(sizes, "bucket").withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda other: F.struct(F.least(other, "block").alias("x"), F.greatest(other, "block").alias("y")))
    spread = dealt.withColumn("meet", F.explode(meets)).select("bucket", F.col("meet.x").alias("x"), F.col("meet.y").alias("y"), "block", "id", "component", "n_shingles", "bands", "sketch", "text")
    limit = most_different_bits(s)

    def edges_of(rows: pa.RecordBatch) -> np.ndarray:
        keys = np.stack([rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
        return np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                edges = edges_of(part)
                opens = held and any(held[-1].column(k)[held[-1].num_rows - 1] != part.column(k)[0] for k in range(3))
                if opens:
                    yield from groups(held)
                    held = []
                if len(edges):
                    yield from groups([*held, part.slice(0, int(edges[-1]))])
                    held, part = [], part.slice(int(edges[-1]))
                held.append(part)
        if held:
            yield from groups(held)

    def groups(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_batches(parts)
        edges = edges_of(rows)
        for a, b in zip(np.concatenate([[0], edges]), np.concatenate([edges, [rows.num_rows]]), strict=True):
            group = rows.slice(int(a), int(b - a))
            links = linked(group)
            if links:
                yield pa.RecordBatch.from_arrays([group.column(4).take(pa.array(c)) for c in zip(*links, strict=True)], ["a", "b"])

    def linked(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        bucket, x, y, block, sizes = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 6))
        component = rows.column(5)
        parts = component.field("id").dictionary_encode().indices, component.field("tag")
        kinds = np.unique(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in parts]), axis=1, return_inverse=True)[1].ravel()
        bands = rows.column(7).flatten().to_numpy().reshape(rows.num_rows, -1)
        raw = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        band = int(np.argmax(bands[0] == bucket[0]))
        left = np.flatnonzero(block == x[0])
        right = left if x[0] == y[0] else np.flatnonzero(block == y[0])
        sets, out = None, []
        for i in left.tolist():
            near = right[kinds[right] != kinds[i]]
            if right is left:
                near = near[near > i]
            near = near[100 * np.minimum(sizes[near], sizes[i]) >= s.percent * np.maximum(sizes[near], sizes[i])]
            near = near[np.bitwise_count(raw[near] ^ raw[i]).sum(1) <= limit]
            near = near[~(bands[near, :band] == bands[i, :band]).any(1)]
            for j in near.tolist():
                if kinds[i] == kinds[j]:
                    continue
                if sets is None:
                    sets = _columns(rows.column(9), s.shingle)
                if _similar(sets[i], sets[j], s):
                    out.append((i, j))
                    kinds[kinds == kinds[j]] = kinds[i]
        return out

    return spread.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(trimmed(run), _pairs_schema(members.schema["id"].dataType))


def _similar(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= s.percent * (len(x) + len(y) - shared)


def _joined(docs: DataFrame, s: Settings, id_col: str, text_col: str, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The signatures, and the classes with their node, the keys of the row that stands for them, and their component.

    A node is (id, tag), the smallest id of a class and half of its set's digest, so the least node of a component has its
    smallest id. With ``by_id`` the classes of the texts of one id are linked.
    """
    sig = written(signatures(docs, s, id_col, text_col), "signatures")
    known = sig.where("id is not null and n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    least = known.groupBy(*same).agg(F.min(F.struct("id", "key", "key2")).alias("row"))
    classes = written(least.select(*same, F.struct(F.col("row.id").alias("id"), F.col("set_a").alias("tag")).alias("node"), "row.key", "row.key2"), "classes")
    reps = known.join(classes.select("key", "key2", F.col("node")), ["key", "key2"]).dropDuplicates(["key", "key2"]).withColumn("id", F.col("node"))
    buckets = reps.select(F.explode("bands").alias("bucket"), "id")
    hubs = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", "bucket").alias("order"), F.col("id"))).alias("hub")).where("size > 1")
    members = written(buckets.join(hubs.select("bucket", F.col("hub.id").alias("hub")), "bucket"), "members")
    chosen = written(members.select("id").distinct(), "chosen")
    wanted = reps.join(chosen, "id", "left_semi").select("id", "key", "key2", "n_shingles", "bands", "sketch")
    texts = written(docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")).join(wanted, ["key", "key2"]).dropDuplicates(["key", "key2"]).drop("key", "key2"), "texts")

    stars = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    stars = stars.join(texts.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    stars = stars.where(_close(F.col("sketch_a"), F.col("sketch_b"), s)).select("a", "b")
    links = written(_confirmed(stars, texts.select("id", "text"), s), "links")
    first = written(components(links), "components")

    labelled = members.select("bucket", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    rest = written(labelled.join(mixed, "bucket", "left_semi"), "mixed")
    more = written(_compared(rest.join(texts, "id"), s).distinct(), "links")
    if by_id:
        twice = known.groupBy("id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x <> y").select("id")
        own = known.join(twice, "id", "left_semi").join(classes.select(*same, "node"), same).select("id", "node").distinct()
        hub = own.groupBy("id").agg(F.min("node").alias("a"))
        more = written(more.unionAll(own.join(hub, "id").where("a <> node").select("a", F.col("node").alias("b"))), "links")
    final = components(links.unionAll(more)) if more.head(1) else first
    return sig, classes.join(final.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def duplicates(docs: DataFrame, s: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the smallest id with the same set."""
    sig, joined = _joined(docs, s, id_col, text_col, by_id=True)
    same = ["n_shingles", "set_a", "set_b"]
    out = sig.join(joined.select(*same, "node", "component"), same, "left").withColumn("component_id", F.coalesce(F.when(F.col("id").isNotNull(), F.col("component.id")), "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.coalesce("node.id", "id").alias("class_id"))


def kept(docs: DataFrame, s: Settings = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id; all columns stay.

    A row goes only for a row that it is a near copy of, or reaches by near copies: rows of one id whose texts are not
    alike all stay, as do rows without an id or without words; of rows equal in id and text one stays.
    """
    _, joined = _joined(docs, s, id_col, text_col, by_id=False)
    key, key2, first = unused(docs, "key", "key2", "first")
    decided = joined.where("node = component").select(F.col("key").alias(key), F.col("key2").alias(key2))
    rows = docs.withColumns(dict(zip((key, key2), row_keys(id_col, text_col), strict=True))).join(decided, [key, key2], "left_semi")
    one = rows.withColumn(first, F.row_number().over(Window.partitionBy(key, key2).orderBy(id_col))).where(F.col(first) == 1)
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return one.select(*docs.columns).unionAll(docs.where(F.col(id_col).isNull() | wordless))

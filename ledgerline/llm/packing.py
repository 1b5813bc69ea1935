"""Best-fit packing of token sequences by the linear grouping scheme.

Documents become token pieces; only the histogram of piece lengths (at most ``capacity`` rows, whatever the
corpus) reaches the driver. There a plan is made of runs: so many pieces of one length, so many to a
sequence, from this sequence number and this offset on. Executors then place every piece by its rank among
the pieces of its length, with no further exchange of texts.

The plan: lengths above a share of the capacity are grouped in equal numbers and rounded up within a group;
a configuration programme over those few sizes is solved by column generation and rounded down; the actual
lengths replace the rounded ones; what is left, and all smaller lengths, go longest first to the sequence
with the least room that still takes them. Several shares and group counts are tried, and the plan of the
fewest sequences is kept.

Defined results: a null text is empty and holds the end token alone; repeated rows are pieces of their own;
null ids stay null; an empty table gives no pieces; a very long text is tokenized whole and cut into full
sequences and one rest; pieces of equal length are ranked by a hash of id and piece, so ties change nothing but who
goes where; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import trimmed, written

CAPACITY, END = 4096, 1
#: Words that a worker keeps with their ids, in each of two generations; about 200 bytes each.
KEEP = 700_000
_CONTROL = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers use for each byte: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class Coder:
    """Token ids of texts as little-endian bytes, with the words of recent texts kept.

    The vocabulary's pre-tokenizer never joins across white space, so a text's ids are those of its words
    one after the other. Words of Latin letters go to the merges directly, many in one call, and are told
    apart by their word-end tokens; all others pass through the whole tokenizer. Two generations of little
    more than ``keep`` words bound the memory. A text with one of the four control characters that only
    Python counts as white space is encoded whole.
    """

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.letters = _byte_letters()
        self.keep, self.new, self.old = keep, {}, {}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of Latin letters."""
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        joined = [" ".join(spelled[k : k + 1000]) for k in range(0, len(spelled), 1000)]
        found = [np.array(x.ids, "<u4") for x in self.merges.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):
            return self._encode(words)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, missing: set[str]) -> None:
        """Ids of new words: known but for case or one mark at the end, or else encoded."""
        new, old = self.new, self.old
        derived: list[tuple[str, str, str]] = []
        plain, other = set(), set()
        for word in missing:
            held = old.get(word)
            if held is not None:
                new[word] = held
                continue
            mark = word[-1] if word[-1] in ".," and len(word) > 1 and word[-2].isalpha() else ""
            stem = word[:-1] if mark else word
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                stem = stem.lower()
                if stem not in new:
                    plain.add(stem)
                derived.append((word, stem, mark))
            else:
                other.add(word)
        for mark in ".,":
            if mark not in new:
                other.add(mark)
        for words, encode in ((plain, self._encode_plain), (other, self._encode)):
            words = list(words)
            for word, ids in zip(words, encode(words) if words else [], strict=True):
                new[word] = ids
        for word, stem, mark in derived:
            new[word] = new[stem] + new[mark] if mark else new[stem]

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {}
        lists = [t.split() for t in texts]
        missing = set(chain.from_iterable(lists)).difference(self.new)
        if missing:
            self._learn(missing)
        out = [b"".join(map(self.new.__getitem__, words)) for words in lists]
        for k, text in enumerate(texts):
            if any(c in text for c in _CONTROL):
                out[k] = self._encode([text])[0]
        return out


_CODERS: dict[str, Coder] = {}


def coder(path: str, keep: int) -> Coder:
    """The worker's own coder for a vocabulary file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    _CODERS[path].keep = keep
    return _CODERS[path]


def forget(path: str) -> None:
    """Give up the worker's coder; a function of the module, as a pickled closure has its own copy of globals."""
    _CODERS.pop(path, None)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = 1024, with_ids: bool = False, keep: int = KEEP, release: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]) of every document's token ids and the end token.

    With ``release`` a worker gives up the coder and its words at the end of a task, as it may live on for other work.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                rows = []
                for k, raw in enumerate(code.ids([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[a : a + 4 * capacity]
                        rows.append((k, p, a // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True))
                ids = part.column(0).take(pa.array(columns[0]))
                arrays = [ids, *(pa.array(c, t) for c, t in zip(columns[1:], types[1:], strict=True))][: len(names)]
                yield pa.RecordBatch.from_arrays(arrays, names)
        if release:
            del code
            forget(path)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run) if release else run, schema)


# The plan, made of runs.


class Plan:
    """Sequences as runs of equal fill, and the placements that filled them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, number)
        self.sizes: list[int] = []
        self.taken: dict[int, int] = {}  # of each length, the pieces placed
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, number, first sequence, a sequence, offset

    def open(self, number: int) -> int:
        first = self.sequences
        self.sequences += number
        return first

    def place(self, length: int, number: int, first: int, each: int, room: int) -> None:
        rank = self.taken.get(length, 0)
        self.rows.append((length, rank, number, first, each, self.capacity - room))
        self.taken[length] = rank + number

    def leave(self, room: int, first: int, number: int) -> None:
        if room and number:
            if room not in self.rooms:
                self.rooms[room] = []
                insort(self.sizes, room)
            self.rooms[room].append((first, number))

    def best_fit(self, length: int, number: int) -> None:
        """Pieces of one length, each to the sequence with the least room that takes it."""
        while number:
            k = bisect_left(self.sizes, length)
            if k == len(self.sizes):
                room, first, count = self.capacity, self.sequences, -(-number // (self.capacity // length))
                self.open(count)
            else:
                room = self.sizes[k]
                first, count = self.rooms[room].pop()
                if not self.rooms[room]:
                    del self.rooms[room]
                    self.sizes.pop(k)
            each = room // length
            full = min(count, number // each)
            if full:
                self.place(length, full * each, first, each, room)
                self.leave(room - each * length, first, full)
                number -= full * each
            if full < count:
                rest, used = first + full, 0
                if number < each and number:
                    self.place(length, number, rest, number, room)
                    self.leave(room - number * length, rest, 1)
                    number, used = 0, 1
                self.leave(room, rest + used, count - full - used)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of each configuration of few sizes: the covering programme by column generation, rounded down."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, back = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = np.where(sizes <= room, value[np.maximum(room - sizes, 0)] + prices, 0)
            k = int(np.argmax(fits))
            value[room], back[room] = (fits[k], k) if fits[k] > value[room - 1] + 1e-12 else (value[room - 1], -1)
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if back[room] < 0:
                room -= 1
            else:
                column[back[room]] += 1
                room -= int(sizes[back[room]])
        amounts, change = np.linalg.solve(basis, np.column_stack([demand, column])).T
        ratio = np.where(change > 1e-9, amounts / np.maximum(change, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amounts = np.linalg.solve(basis, demand.astype(float))
    return [(int(a + 1e-6), basis[:, k].astype(int)) for k, a in enumerate(amounts) if a >= 1]


def grouped_plan(histogram: dict[int, int], capacity: int, share: float, groups: int) -> Plan:
    """The plan with lengths above ``share`` of the capacity in ``groups`` groups of equal numbers."""
    plan = Plan(capacity)
    left = {n: c for n, c in histogram.items() if n < capacity}
    if whole := histogram.get(capacity, 0):
        plan.place(capacity, whole, plan.open(whole), 1, capacity)
    large = sorted((n for n in left if n > share * capacity), reverse=True)
    total = sum(left[n] for n in large)
    if total and groups:
        # Runs (length, number) of each group, longest first; groups of one rounded size are one group.
        parts: list[list[list[int]]] = []
        room = 0
        for n in large:
            count = left[n]
            while count:
                if room == 0:
                    room = -(-total // groups)
                    if not parts or parts[-1][0][0] != n:
                        parts.append([])
                take = min(room, count)
                parts[-1].append([n, take])
                room -= take
                count -= take
        sizes = np.array([p[0][0] for p in parts])
        demand = np.array([sum(c for _, c in p) for p in parts])
        for amount, column in configurations(sizes, demand, capacity):
            amount = min([amount, *(sum(c for _, c in parts[g]) // int(k) for g, k in enumerate(column) if k)])
            if not amount or not column.any():
                continue
            runs = [(plan.open(amount), amount, capacity)]  # first sequence, number, room
            for g in np.repeat(np.arange(len(column)), column):
                following = []
                for first, count, room in runs:
                    while count:
                        run = parts[g][0]
                        take = min(count, run[1])
                        plan.place(run[0], take, first, 1, room)
                        left[run[0]] -= take
                        following.append((first, take, room - run[0]))
                        first, count = first + take, count - take
                        run[1] -= take
                        if not run[1]:
                            parts[g].pop(0)
                runs = following
            for first, count, room in runs:
                plan.leave(room, first, count)
    for n in sorted(left, reverse=True):
        plan.best_fit(n, left[n])
    return plan


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = None
    for share, groups in ((0.25, 24), (0.5, 32), (0.34, 24), (0.17, 20), (1.0, 0)):
        plan = grouped_plan(histogram, capacity, share, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= least:
            break
    return best


def ranked(df: DataFrame, group: str, key: list[str], out: str, buckets: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each value of ``group``, dealt to buckets so that no task numbers a large one alone."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(group, "_bucket").orderBy(*key)
    numbered = df.withColumn("_rank", F.row_number().over(inner) - 1).join(offsets, [group, "_bucket"])
    return numbered.withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_before", "_rank")


def placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows with ``length`` and their ``rank`` in it get ``sequence_id`` and ``offset``; the plan's runs are bounded by the capacity."""
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "rank") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 3] + at // row[:, 4], row[:, 5] + at % row[:, 4] * length
            kept = [(n, c) for n, c in zip(names, batch.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(sequence), pa.array(offset)], [*(n for n, _ in kept), "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep: int = KEEP, release: bool = False) -> DataFrame:
    """Every piece of every document with the sequence and the offset where it stands."""
    rows = written(pieces(docs, path or vocabulary(), capacity, keep=keep, release=release), "pieces")
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = best_plan(histogram, capacity)
    buckets = max(256, max(histogram.values(), default=0) // 100_000)  # full pieces are one length and may be most of all
    order = ranked(rows, "length", ["doc_id", "piece", "ids_crc32", "start"], "rank", buckets)
    return placed(order, plan).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

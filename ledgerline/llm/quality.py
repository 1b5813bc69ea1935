"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into chunks, and each chunk is compressed with the dictionary of good text and with that of bad
text. The difference of the two compressed sizes over their sum says which dictionary explains the text better.
It is taken from three views: the bytes, their shape (runs of letters become one letter, digits one digit), which
shows layout and junk whatever the words, and their rhythm (one byte a word: how often in a row it
repeats the word before, or else its length). A logistic curve turns the three differences into a score between 0 and 1.

All of it is fitted on a bounded sample: of each label the ``per_label`` rows with the smallest hash of their id.
Dictionaries are trained on ``pieces`` stretches of ``piece`` bytes of every sampled text, evenly over its whole
length. The curve is fitted to the differences of whole sampled texts, which are made where the texts are read:
the sample is dealt to two folds, and each text is measured by the dictionaries of the other fold. The final
dictionaries come from all sampled rows. Scoring reads every whole text.

Defined results: null and empty texts are scored as empty; without rows of both labels every score is the
share of good labels (0.5 without labels); rows with a null id are scored and never learned from; repeated
rows get equal scores; a very long text is compressed chunk by chunk to its end; of rows whose ids have equal
hashes the smaller id is sampled; other columns of either table are ignored, and stay where rows are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import textvec
from ledgerline.llm.common import trimmed, unused

FOLDS, THRESHOLD = 5, 0.3


@dataclass(frozen=True)
class Settings:
    per_label: int = 2000
    dictionary: int = 65536
    piece: int = 600
    pieces: int = 6
    chunk: int = 256
    level: int = 9


DEFAULT = Settings()

#: Letters of either case, bytes above 127 and digits stand for their class; every other byte stays.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_LETTER = np.zeros(256, bool)
_LETTER[[ord("a"), ord("A")]] = True


def shape(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shapes of some texts, which stand one after the other."""
    kind = _SHAPE[data]
    keep = np.ones(len(kind), bool)
    if len(kind):
        keep[1:] = (kind[1:] != kind[:-1]) | ~_LETTER[kind[1:]]
    keep[bounds[:-1][bounds[:-1] < len(kind)]] = True
    return kind[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def rhythm(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a word: its length, up to 60, or how often it has repeated the word before it in a row.

    The counts of a run differ from each other, so only a dictionary that has seen such runs makes them short.
    """
    words = textvec.Words(data, bounds, textvec.SPACE, lower=True)
    out = np.minimum(words.ends - words.starts, 60).astype(np.uint8)
    again = np.zeros(len(out), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.first[:-1][words.first[:-1] < len(out)]] = False
    at = np.arange(len(out))
    run = at - np.maximum.accumulate(np.where(again, 0, at))
    out[again] = (61 + (run[again] - 1) % 192).astype(np.uint8)
    return out, words.first


VIEWS = 3


def _views(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield data, bounds
    yield shape(data, bounds)
    yield rhythm(data, bounds)


class Classifier:
    """Dictionaries (bad and good, of each view), and the logistic curve over their differences."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]], settings: Settings, prior: float):
        self.dictionaries, self.settings, self.prior = dictionaries, settings, prior
        self.mean = self.scale = self.weights = None

    def _compressors(self) -> list[tuple[zstandard.ZstdCompressor, ...]]:
        level = self.settings.level

        def of(raw: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=held, write_dict_id=False, write_content_size=False)

        return [(of(bad), of(good)) for bad, good in self.dictionaries]

    def figures(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The normalised size difference of each text in each view."""
        out = np.zeros((len(bounds) - 1, len(self.dictionaries)))
        step = self.settings.chunk
        compressors = self._compressors()
        for a, b in textvec.slices(bounds):
            part = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            for v, (raw, edges) in enumerate(_views(*part)):
                bad, good = compressors[v]
                held = memoryview(np.ascontiguousarray(raw))
                for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    chunks = [held[at : min(at + step, y)] for at in range(x, y, step)]
                    of_bad, of_good = (sum(len(c.compress(p)) for p in chunks) for c in (bad, good))
                    out[a + k, v] = (of_bad - of_good) / (of_bad + of_good + 1)
        return out

    def calibrate(self, figures: np.ndarray, labels: np.ndarray, rounds: int = 60) -> None:
        """Logistic regression by Newton steps with a light ridge."""
        self.mean, self.scale = figures.mean(0), figures.std(0) + 1e-9
        x = np.column_stack([(figures - self.mean) / self.scale, np.ones(len(figures))])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
            w += np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * w)
        self.weights = w

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bounds) - 1, self.prior)
        x = (self.figures(data, bounds) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def stretches(data: np.ndarray, bounds: np.ndarray, s: Settings) -> list[list[bytes]]:
    """Of each text up to ``pieces`` stretches of ``piece`` bytes, evenly from its start to its end; texts that are shorter give all."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = min(s.pieces, -(-(b - a) // s.piece))
        starts = [a + (b - a - s.piece) * k // (n - 1) for k in range(n)] if n > 1 else [a] * n
        out.append([data[max(a, x) : min(b, x + s.piece)].tobytes() for x in starts])
    return out


def dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A trained zstandard dictionary; where there is too little to train on, the samples themselves, or none."""
    whole, long = b"".join(samples), [x for x in samples if len(x) >= 8]
    if len(whole) < 8:
        return None
    total = sum(map(len, long))
    if len(long) < 8 or total < 4096:  # the trainer is not made for less
        return whole[-size:]
    try:
        return zstandard.train_dictionary(min(size, total // 8), long, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def _sampled(labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, label, fold) of the sample: a row of a label is in it by the hash of its id, and in a fold by its place."""
    usable = labels.select("doc_id", F.col("quality").alias("label")).where((_remainder("doc_id") != 0) & F.col("label").isin(0, 1))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("label = 0").orderBy(*order).limit(s.per_label).unionAll(usable.where("label = 1").orderBy(*order).limit(s.per_label))
    return chosen.distinct().withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))


def _trained(rows: list, s: Settings) -> list[tuple[bytes, bytes]] | None:
    """Dictionaries of each view from rows (label, view, pieces), or none if a label has too little text."""
    made = [tuple(dictionary([p for r in rows if r.label == label and r.view == view for p in r.pieces], s.dictionary) for label in (0, 1)) for view in range(VIEWS)]
    return None if any(d is None for pair in made for d in pair) else made


def _remainder(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> Classifier:
    """A classifier from the labelled rows outside the held-out fold; of at most 2 x ``per_label`` rows stretches and figures reach the driver."""
    s = settings
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    found = docs.select("doc_id", text).join(F.broadcast(_sampled(labels, s)), "doc_id")  # per_label bounds the sample
    found = found.groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text"))  # of rows that share an id the smallest text

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for view, part in enumerate(_views(*textvec.flat(batch.column(3)))):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([view] * batch.num_rows, pa.int32()), pa.array(stretches(*part, s), pa.list_(pa.binary()))], ["doc_id", "label", "fold", "view", "pieces"])

    kinds = dict(found.dtypes)
    found = found.select("doc_id", "label", "fold", "text")
    rows = found.mapInArrow(trimmed(pieces), f"doc_id {kinds['doc_id']}, label {kinds['label']}, fold int, view int, pieces array<binary>").collect()
    rows.sort(key=lambda r: (r.view, r.label, str(r.doc_id)))
    good = [r.label for r in rows if r.view == 0]
    made = Classifier([], s, sum(good) / len(good) if good else 0.5)
    by_fold = [_trained([r for r in rows if r.fold != fold], s) for fold in (0, 1)]
    final = _trained(rows, s)
    if final is None or None in by_fold:
        return made
    shared = docs.sparkSession.sparkContext.broadcast([Classifier(d, s, 0.5) for d in by_fold])

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for k, classifier in enumerate(shared.value):
                own = batch.filter(pa.array(fold == k))
                values = classifier.figures(*textvec.flat(own.column(3)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(v) for v in values.T)], ["doc_id", "label", *columns])

    columns = [f"view{k}" for k in range(VIEWS)]
    measured = found.mapInArrow(trimmed(figures), f"doc_id {kinds['doc_id']}, label {kinds['label']}, " + ", ".join(f"{c} double" for c in columns)).collect()
    measured.sort(key=lambda r: (r.label, str(r.doc_id)))
    made.dictionaries = final
    made.calibrate(np.array([[r[c] for c in columns] for r in measured]), np.array([r.label for r in measured]))
    return made


def scored(docs: DataFrame, classifier: Classifier, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with their score in a further column ``out``."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shared.value.scores(*textvec.flat(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per document: held_out, score and the predicted label."""
    found = scored(docs.select("doc_id", "text"), fitted(docs, labels, settings))
    held_out = F.coalesce(_remainder("doc_id") == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The documents that the classifier does not reject; all columns stay."""
    (out,) = unused(docs, "quality_score")
    return scored(docs, fitted(docs, labels, settings), out=out).where(F.col(out) >= THRESHOLD).drop(out)

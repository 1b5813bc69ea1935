"""Audio columns: polyphase resampling, log-mel filterbanks and hysteresis energy segmentation.

A payload is stored as an 8-bit mono WAV file, byte for byte, and features are computed from the bytes
read back. The log-mel frames are cut into patches of one fixed shape, each with its time span, and held as a
fixed-shape Arrow tensor column (``tensors``); what ``digests`` states is read from that column. ``patches``
gives the rows of all patches, and ``tensor_table`` makes the tensor column of rows that Spark has handed over.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal values, because
every document is computed alone with shapes that depend on nothing else; other columns are ignored. Long
signals are resampled and transformed block by block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64


@dataclass(frozen=True)
class Settings:
    rate: int = 6000
    up: int = 2
    down: int = 3
    taps: int = 16
    frame: int = 256
    hop: int = 128
    mels: int = 24
    patch: int = 32
    on_db: float = -14.0
    off_db: float = -17.0

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


DEFAULT = Settings()


def encode(payload: bytes, rate: int = DEFAULT.rate) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; a data chunk of odd length is padded as RIFF asks."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def decode(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of such a file, whatever other chunks it holds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("the file has no data")


@lru_cache(8)
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass as one row of ``taps`` coefficients per phase."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * up * np.hamming(n)
    phases = h.reshape(taps, up).T
    return np.ascontiguousarray(phases / phases.sum(1, keepdims=True), np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = 16, block: int = 1 << 16) -> np.ndarray:
    """Rate change by up/down: each output sample uses only the filter phase it falls on."""
    phases, n = _filter(up, down, taps), -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(taps, np.float32)])
    out = np.empty(n, np.float32)
    for p in range(up):  # outputs m with (m * down) % up == phase
        first = np.arange(p, n, up)
        if not len(first):
            continue
        phase, at = (p * down) % up, (first * down) // up
        for k in range(0, len(first), block):
            at_k = at[k : k + block]
            view = np.lib.stride_tricks.sliding_window_view(padded[at_k[0] : at_k[-1] + taps], taps)
            step = at_k[1] - at_k[0] if len(at_k) > 1 else 1
            out[first[k : k + block]] = view[::step] @ phases[phase][::-1]
    return out


@lru_cache(8)
def _mel(frame: int, mels: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise, fall = (bins - low) / (mid - low), (high - bins) / (high - mid)
    return np.ascontiguousarray(np.maximum(0, np.minimum(rise, fall)).T, np.float32)


def log_mel(x: np.ndarray, s: Settings = DEFAULT, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies in dB of overlapping frames; the last frame is padded with zeros."""
    n = max(1, -(-max(0, len(x) - s.frame) // s.hop) + 1)
    padded = np.zeros((n - 1) * s.hop + s.frame, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, s.frame)[:: s.hop]
    window, bank = np.hanning(s.frame).astype(np.float32), _mel(s.frame, s.mels, s.out_rate)
    mel, energy = np.empty((n, s.mels), np.float32), np.empty(n, np.float32)
    for k in range(0, n, block):
        part = frames[k : k + block]
        power = np.abs(np.fft.rfft(part * window, axis=1)).astype(np.float32) ** 2
        mel[k : k + block] = np.log10(power @ bank + 1e-6)
        energy[k : k + block] = 10 * np.log10((part * part).mean(1) + 1e-9)
    return mel, energy


def segments(energy: np.ndarray, on_db: float, off_db: float) -> list[tuple[int, int]]:
    """Runs of frames that begin at ``on_db`` or more and last until a frame below ``off_db``."""
    high, low = energy >= on_db, energy < off_db
    marks = np.where(high, 1, np.where(low, -1, 0))
    last = np.maximum.accumulate(np.where(marks != 0, np.arange(len(marks)), -1))
    state = np.where(last >= 0, marks[np.maximum(last, 0)] == 1, False)
    edge = np.diff(np.concatenate(([0], state.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def signal(samples: bytes) -> np.ndarray:
    return (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128


def features(samples: bytes, s: Settings = DEFAULT) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Log-mel rows and the time spans, in seconds, of the louder parts."""
    mel, energy = log_mel(resample(signal(samples), s.up, s.down, s.taps), s)
    step = s.hop / s.out_rate
    spans = [(a * step, ((b - 1) * s.hop + s.frame) / s.out_rate) for a, b in segments(energy, s.on_db, s.off_db)]
    return mel, spans


@dataclass(frozen=True)
class Patches:
    """The patches of one signal: a fixed-shape tensor column, their time spans in seconds and their frames."""

    log_mel: pa.FixedShapeTensorArray
    t0: np.ndarray
    t1: np.ndarray
    n_frames: np.ndarray


def tensors(mel: np.ndarray, s: Settings = DEFAULT) -> Patches:
    """Log-mel rows as patches of ``patch`` x ``mels`` values, the last one padded with zeros."""
    n = -(-len(mel) // s.patch)
    full = np.zeros((n, s.patch, s.mels), np.float32)
    full.reshape(-1, s.mels)[: len(mel)] = mel
    held = np.minimum(len(mel) - np.arange(n) * s.patch, s.patch)
    t0 = np.arange(n) * s.patch * s.hop / s.out_rate
    return Patches(pa.FixedShapeTensorArray.from_numpy_ndarray(full), t0, t0 + ((held - 1) * s.hop + s.frame) / s.out_rate, held)


def described(found: Patches, spans: list[tuple[float, float]]) -> str:
    """Number and shape of the patches, frames, mean of each band, end of the last patch, and number and total time of the spans."""
    values = found.log_mel.to_numpy_ndarray()
    means = ",".join(f"{v:.3f}" for v in values.sum((0, 1), dtype=np.float64) / found.n_frames.sum())
    shape = "x".join(map(str, values.shape))
    return f"{shape};{found.n_frames.sum()};{means};{found.t1[-1]:.3f};{len(spans)};{sum(b - a for a, b in spans):.3f}"


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def digests(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row per document that proves the round trip and states the features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def row(text: bytes | None) -> tuple:
        media = encode(payload_of(text or b""), s.rate)
        back, _ = decode(media)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        mel, spans = features(back, s)
        return len(text or b""), len(back), sha(back), zlib.crc32(back[-BLOCK:]), len(media), sha(media), described(tensors(mel, s), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = [row(t) for t in _binary(batch.column(1)).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patches(media: DataFrame, id_col: str, media_col: str, s: Settings = DEFAULT) -> DataFrame:
    """Rows (id, patch, t0, t1, n_frames, log_mel) of ``patch`` x ``mels`` values each, the last one padded with zeros."""
    kind = dict(media.dtypes)[id_col]
    schema = f"{id_col} {kind}, patch int, t0 double, t1 double, n_frames int, log_mel array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in enumerate(batch.column(1).to_pylist()):
                if file is None:
                    continue
                found = tensors(features(decode(file)[0], s)[0], s)
                n = len(found.n_frames)
                ids = pa.array([batch.column(0)[k].as_py()] * n, batch.schema.field(0).type)
                values = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * s.patch * s.mels, found.log_mel.storage.flatten())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(n, dtype=np.int32)), pa.array(found.t0), pa.array(found.t1), pa.array(found.n_frames.astype(np.int32)), values], [id_col, "patch", "t0", "t1", "n_frames", "log_mel"])

    return media.select(id_col, media_col).mapInArrow(run, schema)


def tensor_table(table: pa.Table, s: Settings = DEFAULT) -> pa.Table:
    """The same rows with ``log_mel`` as a fixed-shape tensor column."""
    column = table.column("log_mel").combine_chunks()
    values = column.flatten().cast(pa.float32())
    storage = pa.FixedSizeListArray.from_arrays(values, s.patch * s.mels)
    tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (s.patch, s.mels)), storage)
    return table.set_column(table.schema.get_field_index("log_mel"), "log_mel", tensor)

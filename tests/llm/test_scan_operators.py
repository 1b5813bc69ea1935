"""Operators that read each document alone: sharding, audio features and personal data."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import audio, pii, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, key_hash string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, None, None, None, "x", 1, "y") for k, t in texts], SCHEMA)


def brute_jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_matches_the_published_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    found = sharding.jump(keys, 16)
    assert found.tolist() == [brute_jump(int(k), 16) for k in keys]
    grown = sharding.jump(keys, 17)
    assert ((grown == found) | (grown == 16)).all() and 60 < (grown == 16).sum() < 190


def test_assignment_is_gapless_and_defined_for_nulls_and_repeats(spark):
    rows = [(k, "ä" * (k % 7)) for k in range(300)] + [(5, "again"), (5, "again"), (None, None), (7, None)]
    found = sharding.assignment(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    by = {(r.doc_id, r.size, r.text_crc32) for r in found}
    assert (None, 1, 0) in by and (3, 7, zlib.crc32("äää".encode())) in by
    assert all(r.grown_shard in (r.shard, 16) for r in found)
    assert sharding.assignment(docs(spark, [])).count() == 0


def test_audio_round_trip_and_equal_values(spark):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (5, "é" * 50000), (6, "x" * 64)]
    found = {r.doc_id: r for r in audio.digests(docs(spark, texts)).collect()}
    for k, t in texts:
        payload = audio.payload_of((t or "").encode())
        media = audio.encode(payload)
        assert found[k].n_bytes == len((t or "").encode()) and found[k].payload_bytes == len(payload) == len(media) - 44
        assert found[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert found[k].media_sha256 == hashlib.sha256(media).hexdigest()
        assert found[k].tail_crc32 == zlib.crc32(payload[-64:])
    assert found[1].feature == found[4].feature and found[2].feature == found[3].feature
    assert found[6].payload_bytes == 64
    assert audio.digests(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3)])
def test_resampling_matches_the_direct_sum(up, down):
    x = np.random.default_rng(2).normal(size=500).astype(np.float32)
    taps, phases = 16, audio._filter(up, down, 16)
    padded = np.concatenate([np.zeros(taps - 1), x, np.zeros(taps)])
    n = math.ceil(len(x) * up / down)
    want = [sum(phases[m * down % up][j] * padded[m * down // up + taps - 1 - j] for j in range(taps)) for m in range(n)]
    assert np.allclose(audio.resample(x, up, down, 16, block=37), want, atol=1e-4)


def test_segments_and_tensors(spark):
    energy = np.array([-30, -10, -16, -16, -20, -16, -10, -30], float)
    assert audio.segments(energy, -14, -17) == [(1, 4), (6, 7)]
    tone = (128 + 100 * np.sin(np.arange(40000) * 0.5)).astype(np.uint8).tobytes()
    media = spark.createDataFrame([(1, bytearray(audio.encode(tone))), (2, None), (3, bytearray(audio.encode(b"\x80" * 64)))], "id long, media binary")
    rows = audio.patches(media, "id", "media").toArrow()
    table = audio.tensor_table(rows)
    assert table.schema.field("log_mel").type.shape == [32, 24]
    assert isinstance(table.column("log_mel").type, pa.FixedShapeTensorType)
    one = [r for r in rows.to_pylist() if r["id"] == 1]
    assert [r["patch"] for r in one] == list(range(len(one))) and one[-1]["t1"] >= 5 and one[1]["t0"] == 32 * 128 / 4000


def plain_feature(payload, s=audio.DEFAULT):
    """The feature of a payload from the definitions, sample by sample and frame by frame."""
    x = [(b - 128) / 128 for b in payload]
    taps, n_out = s.taps, math.ceil(len(x) * s.up / s.down)
    h = [np.sinc((k - (taps * s.up - 1) / 2) / max(s.up, s.down)) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (taps * s.up - 1))) for k in range(taps * s.up)]
    y = []
    for m in range(n_out):
        phase, at = m * s.down % s.up, m * s.down // s.up
        own = h[phase :: s.up]
        y.append(sum(c * x[at - j] for j, c in enumerate(own) if 0 <= at - j < len(x)) / sum(own))
    n = max(1, math.ceil(max(0, len(y) - s.frame) / s.hop) + 1)
    y += [0.0] * ((n - 1) * s.hop + s.frame - len(y))
    to_mel, of_mel = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [of_mel(to_mel(s.out_rate / 2) * k / (s.mels + 1)) for k in range(s.mels + 2)]
    rows, loud, state = [], [], False
    for f in range(n):
        part = np.array(y[f * s.hop : f * s.hop + s.frame])
        k = np.arange(s.frame)
        shaped = part * (0.5 - 0.5 * np.cos(2 * np.pi * k / (s.frame - 1)))
        power = [abs((shaped * np.exp(-2j * np.pi * q * k / s.frame)).sum()) ** 2 for q in range(s.frame // 2 + 1)]
        bins = [q * s.out_rate / s.frame for q in range(s.frame // 2 + 1)]
        rows.append([math.log10(sum(p * max(0, min((b - lo) / (mid - lo), (hi - b) / (hi - mid))) for p, b in zip(power, bins)) + 1e-6) for lo, mid, hi in zip(edges, edges[1:], edges[2:])])
        db = 10 * math.log10((part**2).mean() + 1e-9)
        state = db >= s.on_db or (state and db >= s.off_db)
        loud.append(state)
    begins = [f for f in range(n) if loud[f] and (f == 0 or not loud[f - 1])]
    ends = [f for f in range(n) if loud[f] and (f == n - 1 or not loud[f + 1])]
    total = sum((b * s.hop + s.frame - a * s.hop) / s.out_rate for a, b in zip(begins, ends))
    last = (n - 1) % s.patch
    end = ((n - 1 - last) * s.hop + last * s.hop + s.frame) / s.out_rate
    return [math.ceil(n / s.patch), s.patch, s.mels, n, *np.mean(rows, axis=0), end, len(begins), total]


@pytest.mark.parametrize("text", ["", "short words", "the river went down to the mill and " * 140, "\x00\x7f~" * 900 + "zzz" * 700])
def test_features_match_their_definitions(text):
    payload = audio.payload_of(text.encode())
    mel, spans = audio.features(payload)
    found = audio.tensors(mel)
    assert isinstance(found.log_mel.type, pa.FixedShapeTensorType) and found.log_mel.type.shape == [32, 24]
    shape, n, means, end, count, total = audio.described(found, spans).split(";")
    got = [*map(float, shape.split("x")), float(n), *map(float, means.split(",")), float(end), float(count), float(total)]
    assert np.allclose(got, plain_feature(payload), atol=2e-3)


def slow_base(text):
    out = []
    for kind, pattern in zip(pii.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
                if not 13 <= len(digits) <= 19 or odd % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.@+1234 ()-é0", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == slow_base(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to bob [at] mail (dot) example [dot] com now", [("email", "bob [at] mail (dot) example [dot] com")]),
        ("write to bob at example dot com now", [("email", "bob at example dot com")]),
        ("call plus four nine, one two three four five six seven eight.", [("phone", "plus four nine, one two three four five six seven eight")]),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("mail а.b＠example．com", [("email", "а.b＠example．com")]),
        ("éé 10.0.0.1 and two three", []),
        ("we met at noon on the dot of nine", []),
    ],
)
def test_disguises_map_back_to_the_source(text, want):
    base, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == want
    assert base == slow_base(text)


def test_base_spans_stay_and_rows_are_defined(spark):
    texts = [(1, "a@b.co and c [at] d.org"), (2, None), (3, ""), (1, "a@b.co and c [at] d.org"), (4, "x" * 300000 + " +1 (555) 123-4567")]
    found = pii.detect(docs(spark, texts)).collect()
    one = [r for r in found if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1]
    assert one[0].n_email == 1 and one[0].spans == "email:0:6,email:11:23"
    assert one[0].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert next(r for r in found if r.doc_id == 4).n_phone == 1
    assert next(r for r in found if r.doc_id == 2).spans == ""
    red = {r.doc_id: r.text for r in pii.redacted(docs(spark, texts)).collect()}
    assert red[1] == "<email> and <email>" and red[2] is None
    assert pii.detect(docs(spark, [])).count() == 0


def test_mixed_and_longer_disguises_are_found_whole():
    for text in (
        "joe at mail dot example dot com", "joe at example dot co dot uk", "john dot smith at example dot com", "joe [at] example dot com",
        "joe at example [dot] com", "john dot smith (at) mail.example dot com", "j dot r [dot] smith at a (dot) b dot org",
    ):
        assert pii.redact(f"write to {text}, or not") == "write to <email>, or not"
    assert pii.redact("call +49 555 one two three four.") == "call <phone>."
    for text in ("we look at example.com today", "noon at a dot", "see [x] dot at y"):
        assert pii.find(text) == ([], [])

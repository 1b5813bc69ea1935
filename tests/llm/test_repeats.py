"""Repeated passages, of words and of bytes, against direct counts of all windows."""

import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import parsing, repeats, substring, textvec
from ledgerline.llm.segments import Routing
from ledgerline.llm import segments as seg
from tests.llm.test_neardup import thue_morse


def brute(rows, window, words):
    units = [(t or "").encode().split() if words else (t or "").encode() for _, t in rows]
    count = Counter(bytes(b" ".join(u[k : k + window])) if words else u[k : k + window] for u in units for k in range(len(u) - window + 1))
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        hit = [False] * len(u)
        for k in range(len(u) - window + 1):
            if count[bytes(b" ".join(u[k : k + window])) if words else u[k : k + window]] > 1:
                hit[k : k + window] = [True] * window
        kept = [x for x, h in zip(u, hit, strict=True) if not h]
        spans = sum(h and (not k or not hit[k - 1]) for k, h in enumerate(hit))
        out.append((i, len(u), sum(hit), spans, hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, scale=1):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Stone", "été", "x1", "a", "b", "c", "run", "go.", "END"]
    prose = lambda n: " ".join(r.choice(vocabulary) + str(r.randint(0, 9)) * r.randint(0, 2) for _ in range(n))
    passages = [prose(n * scale) for n in (5, 12, 20, 45)]
    rows = []
    for k in range(60):
        parts = [prose(r.randint(0, 30 * scale))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), prose(r.randint(0, 15 * scale))]
        rows.append((k, r.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), rows[4], (None, rows[5][1]), (102, None), (103, ""), (104, "go " * 4000), (105, "ab" * 3000)]
    for k, n in enumerate((36, 40, 44, 60, 80)):  # short periods that stand in one document only
        rows.append((200 + k, f"u{k} " + f"only{k} " * n + "v"))
        rows.append((300 + k, f"x{k}. " + f"p{k} q{k} r{k} " * n + "y"))
    rows += [(106, passages[3]), (107, passages[3] + " x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in rows], "doc_id long, text string, key int, anchor string, found binary")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("window", [7, 35])
def test_words_match_brute_force(spark, window, hot):
    rows = corpus(1, 1 if window == 7 else 3)
    m = replace(substring.method(window, 3), hot=hot, shard_units=600)
    assert found(repeats.digests(frame(spark, rows), m)) == brute(rows, window, True)


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("window", [40, 400])
def test_bytes_match_brute_force(spark, window, hot):
    rows = corpus(2, 1 if window == 40 else 10)
    m = replace(parsing.method(window, 16), hot=hot, shard_units=5000)
    assert found(repeats.digests(frame(spark, rows), m)) == brute(rows, window, False)


def test_production_settings_and_columns(spark):
    rows = corpus(3, 5)
    words = substring.deduplicated(frame(spark, rows))
    assert words.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert found(words) == [(i, n, x, d) for i, n, x, _, d in brute(rows, 35, True)]
    bytes_ = parsing.deduplicated(frame(spark, rows))
    assert bytes_.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found(bytes_) == brute(rows, 400, False)
    assert substring.deduplicated(frame(spark, [])).count() == 0 == parsing.deduplicated(frame(spark, [])).count()


def test_kept_texts_and_spans(spark):
    rows = [(1, "a b c d e f"), (2, "x b c d y"), (3, None)]
    got = {r.id: (r.kept, [(s.first, s.end) for s in r.spans]) for r in repeats.kept_texts(frame(spark, rows), substring.method(3, 2)).collect()}
    assert got == {1: ("a e f", [(1, 4)]), 2: ("x y", [(1, 4)]), 3: ("", [])}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=8))
def test_corpus_order_is_the_suffix_order(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    keep = np.concatenate([[True], np.diff(first) > 0])
    first = first[keep]
    if len(data) == 0:
        return
    positions = np.arange(len(data))
    got = parsing.corpus_order(data, first, positions, trigger=2, modulus=3)
    end = first[np.searchsorted(first, positions, "right")]
    text = data.tobytes()
    suffix = [text[p : end[p]] for p in positions]
    assert [suffix[p] for p in got] == sorted(suffix)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=5), st.integers(2, 9))
def test_segments_cover_every_window_once(docs, window):
    codes = textvec.mix(np.array([x + 1 for d in docs for x in d], np.uint64))
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    anchor, _, doc, start, n, anchors = seg.segments(codes, first, Routing(window, 2, 7))
    got = sorted((d, s + k) for d, s, m in zip(doc, start, n, strict=True) for k in range(m))
    assert got == [(d, k) for d, x in enumerate(docs) for k in range(len(x) - window + 1)]
    by = {}
    for a, d, s, m in zip(anchor.tolist(), doc, start, n, strict=True):
        for k in range(s, s + m):
            by.setdefault(tuple(docs[d][k : k + window]), set()).add(a)
    assert all(len(v) == 1 for v in by.values())
    for d, s, m, a in zip(doc, start, n, anchors, strict=True):  # a window that a segment holds twice is announced
        own = [tuple(docs[d][k : k + window]) for k in range(s, s + m)]
        assert a == 2 or len(set(own)) == len(own)


@pytest.mark.parametrize("k", [10, 11, 12])
def test_self_similar_texts_match_brute_force(spark, k):
    """Thue-Morse words and their complements, which collide under any polynomial hash modulo a power of two."""
    x, y = thue_morse(k)
    shared = " ".join(f"s{j}" for j in range(40))
    rows = [(1, f"{x} {shared}"), (2, f"{y} {shared}"), (3, " ".join(x)), (4, " ".join(y)), (5, x), (6, y)]
    got = found(substring.deduplicated(frame(spark, rows)))
    assert got == [(i, n, c, d) for i, n, c, _, d in brute(rows, 35, True)] and got[0][2] == 40
    assert found(parsing.deduplicated(frame(spark, rows))) == brute(rows, 400, False)


def test_hot_anchors_exchange_no_text_again(spark):
    """The texts are exchanged as often with hot anchors as without; only the segments of hot anchors are more."""
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    passage = noise(60)
    rows = [(k, noise(20_000) + passage + noise(50)) for k in range(100)]
    # Read by path, as a table is: a table made of Python rows is another plan each time.
    path = f"{spark.conf.get('spark.checkpoint.dir')}/texts-of-hot-anchors"
    frame(spark, rows).write.mode("overwrite").parquet(path)
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved(hot):
        before = store.executorList(False).apply(0).totalShuffleWrite()
        out = found(repeats.digests(spark.read.parquet(path), replace(parsing.method(40, 16), hot=hot)))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return out, store.executorList(False).apply(0).totalShuffleWrite() - before

    (cold, least), (hot, most) = moved(2000), moved(2)
    assert hot == cold and sum(x[2] for x in hot) >= 60 * 100
    assert most < least + 1_000_000, (least, most)

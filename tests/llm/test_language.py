"""The language model: base score by brute force, gradients by differences, held-out gain over the base."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerline.llm import language

SMALL = language.Settings(top=32, classes=4, hidden=8, window=8, train_lanes=8, score_lanes=5, train_share=1.0, rounds=2)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def corpus(n=300):
    r = random.Random(6)
    kinds = [["the", "Of", "and", "stone", "river", "bank", "low"], ["der", "die", "und", "stein", "fluß", "tal", "weit"]]
    rows = [(k, " ".join(r.choice(kinds[k % 2]) + ("" if r.random() < 0.9 else str(r.randint(0, 99))) for _ in range(r.randint(3, 60)))) for k in range(n)]
    return rows + [(900, None), (901, ""), (None, "the stone"), (5, rows[5][1]), (902, "the bank " * 9000)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores_and_the_models_gain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "b", True) for i, t in rows], "doc_id long, text string, key int, block string, held_out boolean")
    got = language.scores(docs, SMALL).collect()
    train = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    total, distinct = sum(train.values()), len(train)
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), None]), total, round(sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in [*words(t), None]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    outside = [r for r in got if r.held_out]
    assert sum(r.score for r in outside) > 0.85 * sum(r.base_score for r in outside)
    one = [r.score for r in got if r.doc_id == 5]
    assert len(one) == 2 and abs(one[0] - one[1]) < 1e-3
    again = {r.doc_id: r.score for r in language.scores(docs.coalesce(1), language.Settings(**{**SMALL.__dict__, "block_bytes": 4000, "rounds": 0})).collect()}
    flat = {r.doc_id: r.score for r in language.scores(docs.coalesce(1), language.Settings(**{**SMALL.__dict__, "rounds": 0})).collect()}
    assert all(abs(again[k] - flat[k]) < 1e-3 * max(1, abs(flat[k])) for k in flat)
    assert language.scores(docs.limit(0), SMALL).count() == 0


def vocabulary(s):
    return language.Vocabulary([(k + 5, k % 3, 40 - k) for k in range(20)], {0: (400, 30), 1: (300, 25), 2: (300, 20)}, 30, s)


def test_probabilities_sum_to_one():
    v = vocabulary(SMALL)
    net = language.Network.initial(SMALL, v)
    state = np.random.default_rng(1).normal(size=(1, 8)).astype(np.float32)
    symbols = np.arange(SMALL.symbols)
    logp, _ = net.log_probabilities(np.repeat(state, SMALL.symbols, 0), symbols)
    assert abs(np.exp(logp).sum() - 1) < 1e-4
    assert np.allclose((v.tail_counts + (v.tail_room - v.tail_counts - 1) + 1) / v.tail_room, 1)


def test_gradients_match_differences():
    s = language.Settings(top=6, classes=2, hidden=3, window=4)
    net = language.Network.initial(s, vocabulary(language.Settings(top=20)).__class__([(1, 0, 9), (2, 1, 5)], {0: (20, 5), 1: (9, 3)}, 4, s))
    g = np.random.default_rng(2)
    net.values += g.normal(0, 0.3, len(net.values)).astype(np.float32)
    symbols = g.choice([0, 1, 5, 6, 7, s.symbols - 1], (5, 3))
    fresh, live = g.random((5, 3)) < 0.3, g.random((5, 3)) < 0.9
    state = g.normal(size=(3, 3)).astype(np.float32)
    grads, _, _ = net.gradients(symbols, fresh, live, state)
    for k in g.choice(np.flatnonzero(np.abs(grads.values) > 1e-3), 40):
        side = []
        for step in (1e-2, -1e-2):
            values = net.values.copy()
            values[k] += step
            side.append(language.Network(s, values).gradients(symbols, fresh, live, state)[2])
        assert abs((side[0] - side[1]) / 2e-2 - grads.values[k]) < 2e-3 + 0.02 * abs(grads.values[k])


def test_state_is_carried_over_windows():
    s = language.Settings(top=32, classes=4, hidden=8, window=4, score_lanes=3)
    net = language.Network.initial(s, vocabulary(s))
    symbols = np.random.default_rng(3).integers(0, s.symbols, 200)
    first = np.array([0, 90, 91, 150, 200])
    whole = language.Network(language.Settings(**{**s.__dict__, "window": 1000}), net.values)
    assert np.allclose(language.score_stream(net, symbols, first), language.score_stream(whole, symbols, first), atol=1e-3)


def test_tail_classes_are_in_range():
    found = [t for _, _, t, _ in language.tokens(pa.array(["abc É. 12 x, zé ! aß", None]))]
    assert found[0].tolist()[0] == 3 and all(0 <= t < language.TAILS for t in found[0])


def test_every_round_reads_every_training_row(spark, monkeypatch):
    rows = [(k, f"word{k % 9} stone") for k in range(400)] + [(None, "the stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(language, "_averaged", lambda sample, net, v, done: seen.append(sorted(r.text for r in sample.collect())) or net)
    language.scores(docs)
    want = sorted(t for i, t in rows if not held(i))
    assert language.DEFAULT.train_share == 1 and seen == [want] * language.DEFAULT.rounds


def test_every_token_of_long_documents_is_learned():
    s = language.DEFAULT
    g = np.random.default_rng(5)
    for lengths in ([5] * 95 + [1000], [200] * 60 + [20_000], [200] * 300 + [20_000] * 2, [1]):
        first = np.concatenate([[0], np.cumsum(lengths)])
        symbols = g.integers(0, s.symbols, first[-1])
        begin = language.Network.initial(s, vocabulary(s))
        net, learned = language.train_replica(language.Network(s, begin.values.copy()), symbols, first)
        assert learned == first[-1] and np.isfinite(net.values).all() and (net.values != begin.values).any()


def test_parts_hold_every_document():
    s = language.Settings(train_tokens=3)
    column, v = pa.array([f"a{k} the stone " * (k % 5) for k in range(60)] + [None, ""]), vocabulary(s)
    parts = list(language._parts(column, v, s))
    symbols, first, _ = language._coded(column, v, s)
    assert len(parts) > 5 and np.array_equal(np.concatenate([x for x, _ in parts]), symbols)
    assert np.array_equal(np.concatenate([np.diff(f) for _, f in parts]), np.diff(first))


def plain_score(net, v, hashes, kinds, counts):
    """Token by token, in double precision, as the model is defined."""
    s, h = net.s, net.s.hidden
    rank = {int(x): int(k) for x, k in zip(v.hashes, v.order, strict=True)}
    state, total = np.zeros(h), 0.0
    for key, kind in [*zip(hashes, kinds, strict=True), (None, None)]:
        symbol = s.symbols - 1 if key is None else rank.get(int(key), s.top + int(kind))
        logits = state @ net.wc.astype(float) + net.bc
        out = symbol // s.per_class if symbol < s.top else symbol - s.top + s.classes
        total += logits[out] - np.log(np.exp(logits).sum())
        if symbol < s.top:
            inner = state @ net.ww[out].astype(float) + net.bw[out]
            total += inner[symbol % s.per_class] - np.log(np.exp(inner).sum())
        elif key is not None:
            total += np.log((counts.get(int(key), 0) + 1) / v.tail_room[kind])
        x, u = net.x[symbol].astype(float), state @ net.u.astype(float)
        z, r = (1 / (1 + np.exp(-(x[a : a + h] + u[a : a + h]))) for a in (0, h))
        new = np.tanh(x[2 * h :] + r * u[2 * h :])
        state = new + z * (state - new)
    return total / np.log(10)


def test_scores_match_a_plain_model():
    s = language.Settings(top=20, classes=4, hidden=8, window=4, score_lanes=3)
    texts = ["the stone went down the river " * 9, None, "", "x", "The tail of rare words 12 é", "the " * 70]
    column = pa.array(texts)
    seen = Counter()
    coded = {}
    for a, h, kinds, first in language.tokens(column):
        for k in range(len(first) - 1):
            coded[a + k] = h[first[k] : first[k + 1]], kinds[first[k] : first[k + 1]]
            seen.update(coded[a + k][0].tolist())
    top = [(int(np.array([x], np.uint64).view(np.int64)[0]), 0, c) for x, c in seen.most_common(7)]
    v = language.Vocabulary(top, {t: (900, 60) for t in range(language.TAILS)}, 40, s)
    net = language.Network.initial(s, v)
    net.values += np.random.default_rng(8).normal(0, 0.3, len(net.values)).astype(np.float32)
    keys = np.sort(np.array(list(seen), np.uint64))
    counts = np.array([seen[int(k)] for k in keys])
    got = language.scored_part(net, v, column, keys, counts)[4]
    want = [plain_score(net, v, *coded[k], seen) for k in range(len(texts))]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_self_similar_words_are_known_apart(spark):
    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    ids = [k for k in range(60) if not held(k)][:3], [k for k in range(60) if held(k)][0]
    rows = [(k, f"{x} stone") for k in ids[0]] + [(ids[1], f"{y} stone")]
    got = {r.doc_id: r for r in language.scores(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()}
    assert got[ids[1]].n_known == 2 and got[ids[0][0]].n_known == 3


def test_a_run_of_windows_learns_as_its_windows_do():
    s = language.Settings(top=32, classes=4, hidden=8, window=6)
    net, g = language.Network.initial(s, vocabulary(s)), np.random.default_rng(9)
    symbols, fresh, live = g.integers(0, s.symbols, (24, 5)).astype(np.int16), g.random((24, 5)) < 0.1, g.random((24, 5)) < 0.9
    state = begin = g.uniform(-1, 1, (5, 8)).astype(np.float32)
    want = np.zeros_like(net.values)
    for t in range(0, 24, 6):
        at = slice(t, t + 6)
        grads, state, _ = net.gradients(symbols[at], fresh[at], live[at], state)
        want += grads.values * live[at].sum()
    grads = language.Network(s)
    last, _ = net.add_gradients(grads, symbols, fresh, live, begin, 4)
    assert np.allclose(last, state, atol=1e-5) and np.allclose(grads.values, want, rtol=1e-3, atol=1e-3)


def test_windows_of_few_lanes_are_learned_and_scored_together(monkeypatch):
    s, passes, steps = language.DEFAULT, [], []
    net = language.Network.initial(s, vocabulary(s))
    kept, moved = language.Network.log_probabilities, language.Adam.move
    monkeypatch.setattr(language.Network, "log_probabilities", lambda self, *a: passes.append(1) or kept(self, *a))
    monkeypatch.setattr(language.Adam, "move", lambda self, *a: steps.append(1) or moved(self, *a))
    for lengths in ([20_000], [200] * 60 + [20_000], [3000] * 300):
        first = np.concatenate([[0], np.cumsum(lengths)])
        symbols = np.random.default_rng(5).integers(0, s.symbols, first[-1])
        stream, want, cells = language.Stream(symbols, first, s.train_lanes, s.symbols - 1), 0, 0
        for at in range(0, len(stream.live), s.window):
            cells += stream.live[at : at + s.window].sum()
            if cells >= s.window * s.train_lanes / 4:
                want, cells = want + 1, 0
        passes.clear(), steps.clear()
        language.train_replica(language.Network(s, net.values.copy()), symbols, first)
        assert len(steps) == want + (cells > 0)
        assert len(passes) <= len(steps) + 10
        passes.clear()
        language.score_stream(net, symbols, first)
        assert len(passes) <= first[-1] / (s.window * s.score_lanes / 2) + 12

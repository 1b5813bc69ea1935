"""Tokens against the tokenizer itself, plans against their definition and a lower bound."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


@pytest.fixture(scope="module")
def whole():
    return tokenizer()


MARKS = st.text(alphabet="aZéÉ.,'sdT1 \t\n\x1d ΣσßİÁ<|endoftext|>!?-世　", max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(MARKS, min_size=1, max_size=4))
def test_ids_are_the_tokenizers(whole, texts):
    texts = [*texts, "don't stop, It's 12.5 <|endoftext|>x"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.coder(packing.vocabulary(), packing.KEEP).ids(texts)]
    assert got == want


def test_a_small_memory_gives_the_same_ids(whole):
    r = random.Random(1)
    code = packing.Coder(packing.vocabulary(), keep=40)
    for _ in range(20):
        texts = [" ".join(r.choice("abcdefg") * r.randint(1, 5) + r.choice(["", ".", ","]) for _ in range(30)) for _ in range(3)]
        assert [np.frombuffer(b, "<u4").tolist() for b in code.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def check_plan(plan, histogram, capacity):
    assert plan.taken == {n: c for n, c in histogram.items() if c}
    held = {}
    for length, rank, number, first, each, offset in plan.rows:
        for i in range(number):
            held.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert sorted(held) == list(range(plan.sequences))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25), st.sampled_from([0.17, 0.25, 0.5, 1.0]), st.sampled_from([1, 3, 8]))
def test_every_plan_is_gapless_and_whole(histogram, share, groups):
    check_plan(packing.grouped_plan(histogram, 64, share, groups), histogram, 64)


def test_plans_come_near_the_lower_bound():
    r = np.random.default_rng(3)
    lengths = np.minimum(4096, r.lognormal(6.2, 0.9, 30000).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.best_plan(histogram)
    check_plan(plan, histogram, 4096)
    assert plan.sequences <= -(-int(lengths.sum()) // 4096) + 2
    hard = {1366: 300, 1365: 300, 2000: 99, 2049: 50, 1300: 77}
    check_plan(packing.best_plan(hard), hard, 4096)
    assert packing.best_plan({}).sequences == 0


def test_configurations_beat_rounding_alone():
    sizes, demand = np.array([45, 36, 31, 14]), np.array([97, 610, 395, 211])  # the classic cutting-stock case
    amounts = packing.configurations(sizes, demand, 100)
    assert 448 <= sum(a for a, _ in amounts) <= 453
    assert all((sizes * c).sum() <= 100 for _, c in amounts)


def test_documents_are_packed_whole(spark, whole):
    r = random.Random(2)
    texts = [(k, " ".join(r.choice(["tree", "Don't", "été", "x1.", "go,"]) for _ in range(r.randint(0, 400)))) for k in range(120)]
    texts += [(500, None), (501, ""), (7, texts[7][1]), (None, "tree"), (502, "walk the long way " * 4000)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id long, text string, length int, rank int")
    found = packing.packed(docs).collect()
    by = {}
    for row in found:
        by.setdefault(row.doc_id, []).append(row)
    for k, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
        assert set(want) == {(x.piece, x.start, x.length, x.ids_crc32) for x in by[k]}
    assert len(by[7]) == 2 and len(found) == sum(len(v) for v in by.values())
    held = {}
    for x in found:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 4096
    assert len(held) <= -(-sum(x.length for x in found) // 4096) + 1
    assert packing.packed(docs.limit(0)).count() == 0


def test_released_workers_hold_no_coder(spark):
    """A worker that lives on after packing has given up the tokenizer and its words."""

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._CODERS)])], ["n"])

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string").repartition(8)
    spark.range(8).repartition(8).mapInArrow(lambda batches: batches, "id long").count()
    assert packing.pieces(docs, packing.vocabulary(), release=True).count() == 40
    assert {r.n for r in spark.range(32).repartition(8).mapInArrow(held, "n long").collect()} == {0}

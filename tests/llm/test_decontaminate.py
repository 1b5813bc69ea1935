"""FM-index and benchmark decontamination against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import decontaminate, textvec
from ledgerline.llm.fmindex import FMIndex, expanded, suffix_order


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=5))
def test_search_and_locate_match_brute_force(text, patterns):
    text = np.array([*text, 0], np.uint32)
    index = FMIndex(text, 5, sample=4)
    low, high = index.search(np.array(patterns, np.uint32))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [k for k in range(len(text) - 2) if text[k : k + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_order_of_random_text():
    text = np.random.default_rng(1).integers(1, 3, 500).astype(np.uint32)
    order = suffix_order(text)
    assert order.tolist() == sorted(range(500), key=lambda k: text[k:].tolist())


def words_of(text):
    raw = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return raw.translate(bytes(32 if textvec.NON_ALNUM[k] else k for k in range(256))).split(b" ") if raw else []


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = [x for x in words_of(text) if x]
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(name) if name is not None else "null")
    out = []
    for doc, text in docs:
        w = [x for x in words_of(text) if x]
        hit, names = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), decontaminate.digest(list(names)), len(names) >= 2))
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(k, t, 1, None) for k, t in docs], "doc_id long, text string, items int, hits string")
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, lang string")
    return d, b


rng = np.random.default_rng(5)
POOL = ["the", "OF", "Été", "a", "b", "c1", "and", "Zeta"]


def prose(n):
    return " ".join(rng.choice(POOL, n)).replace(" a ", "-a, ")


ITEMS = [(k, prose(n)) for k, n in enumerate([12, 9, 8, 5, 20, 3])] + [(4, prose(11)), (None, prose(10)), (9, None), (10, " .. ")]
DOCS = [(k, prose(int(n))) for k, n in enumerate(rng.integers(0, 60, 80))]
DOCS += [(200 + k, prose(20) + "\n" + (t or "") + " " + prose(15)) for k, (_, t) in enumerate(ITEMS)] + [(300, None), (301, ""), (302, prose(3000)), (None, ITEMS[0][1])] + DOCS[:2]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_matches_brute_force(spark, block_bytes, monkeypatch):
    d, b = frames(spark, DOCS, ITEMS)
    scanned = decontaminate.scan
    monkeypatch.setattr(decontaminate, "scan", lambda docs, bench, **k: scanned(docs, bench, block_bytes=block_bytes, **k))
    found = [tuple(r) for r in decontaminate.contamination(d, b).collect()]
    assert sorted(found, key=str) == sorted(brute(DOCS, ITEMS), key=str)


def test_small_slices_and_empty_tables(spark, monkeypatch):
    d, b = frames(spark, DOCS, ITEMS)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    none = decontaminate.contamination(d, b.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.n_hit for r in none)


def test_removal_keeps_the_rest_byte_for_byte(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota"
    d, b = frames(spark, [(1, f"é start; {item}! end é"), (2, "nothing here"), (3, None)], [(1, item)])
    found = {r.doc_id: r.text for r in decontaminate.removed(d, b).collect()}
    assert found == {1: "é start; ! end é", 2: "nothing here", 3: None}
    assert [r.doc_id for r in decontaminate.kept(d, b).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.kept(d, b).columns == decontaminate.removed(d, b).columns == d.columns


def test_expanded_ranges():
    values, which = expanded(np.array([3, 5, 9]), np.array([5, 5, 10]))
    assert values.tolist() == [3, 4, 9] and which.tolist() == [0, 0, 2]


def test_columns_of_internal_names_stay(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"start {item} end", 7, "x"), (2, "clean words", 8, "y")], "doc_id long, text string, decon_words int, Decon_Items string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for blocks in (1 << 20, 8):
        out = {r.doc_id: r for r in decontaminate.removed(docs, benchmark).collect()}
        assert out[1].text == "start  end" and (out[1].decon_words, out[2].Decon_Items) == (7, "y")
        left = decontaminate.kept(docs, benchmark)
        assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean words", 8, "y")]
        assert decontaminate.scan(docs, benchmark, block_bytes=blocks).columns[:4] == docs.columns

"""Near duplicates against all pairs, and the parts of the method against their definitions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import neardup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, k=3):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=85, k=3):
    sets = [(i, shingles(t, k)) for i, t in rows]
    ids = [i for i, _ in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, id int, bucket string, component int")


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(25):  # families: copies with a few words changed, chained so that ends may be far apart
        text = [r.choice(vocabulary) for _ in range(r.choice([6, 20, 60, 150]))]
        for _ in range(r.randint(1, 9)):
            rows.append((n, " ".join(text)))
            n += 1
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
    r.shuffle(rows)
    rows = [(1000 - i, t) for i, t in rows]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "Solo"), (2004, "solo"), (2005, "two words"), (2006, "TWO\twords"), (2007, "words two")]
    rows += [(None, rows[0][1]), rows[1], (2008, "long tail " * 30000), (2009, "Long tail " * 29999)]
    return rows


def test_components_match_all_pairs(spark):
    rows = corpus()
    assert found(neardup.duplicates(frame(spark, rows))) == brute(rows)


def test_five_word_shingles_at_four_fifths(spark):
    rows = corpus(9)
    s = neardup.Settings(shingle=5, percent=80, bands=40)
    assert found(neardup.duplicates(frame(spark, rows), s)) == brute(rows, 80, 5)


def test_links_that_no_hub_has_are_found(spark):
    """A group whose members are linked in pairs only: few of them are similar to any one hub."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(40):
        text = list(base)
        for j in r.sample(range(200), 14):
            text[j] = f"u{k}-{j}"
        rows += [(2 * k, " ".join(text))]
        text[r.randrange(200)] = "tiny"
        rows += [(2 * k + 1, " ".join(text))]
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) >= 20
    assert found(neardup.duplicates(frame(spark, rows), neardup.Settings(block=16))) == want


def test_empty_table(spark):
    assert neardup.duplicates(frame(spark, [])).count() == 0
    assert found(neardup.duplicates(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(60)], [(9, k) for k in range(40)], [(5, 5)], [], [(1, 2), (3, 4), (2, 3), (9, 8)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    rows = brute([(i, f"{i}") for i in sorted({x for e in edges for x in e})])
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert {r.id: r.component for r in neardup.components(df).collect()} == want


def test_sketches_estimate_similarity():
    s = neardup.DEFAULT
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**52, 2000, dtype=np.uint64)
    for shared, wanted in ((1850, True), (1400, False)):
        a, b = np.sort(pool[:shared]), None
        b = np.sort(np.concatenate([pool[: shared - 75], r.integers(0, 2**52, 75, dtype=np.uint64)])) if wanted else np.sort(r.integers(0, 2**52, 1400, dtype=np.uint64))
        samples = neardup.minhashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), s.samples)
        x, y = neardup.odd_sketches(samples, s.sketch)
        assert (int(np.bitwise_count(x ^ y).sum()) <= neardup.most_different_bits(s)) == wanted
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((samples[:, 0] == samples[:, 1]).mean() - true) < 0.12


def test_equal_sets_are_one_class_wherever_they_stand(spark):
    r = random.Random(11)
    texts = [" ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(50, 900))) for _ in range(120)]
    rows = [(k, texts[k % 120]) for k in range(360)]
    got = {x.doc_id: x.class_id for x in neardup.duplicates(frame(spark, rows).coalesce(1)).collect()}
    assert got == {k: k % 120 for k in range(360)}


def test_sets_are_distinct_and_counted():
    for _, values, first in neardup.shingle_sets(pa.array(["a b c a b c", "", None, "A b", "a b"]), 3):
        assert np.diff(first).tolist() == [3, 0, 0, 1, 1] and values[3] == values[4]


def test_rows_of_one_id_are_joined_in_either_order_and_kept_apart(spark):
    r = random.Random(2)
    long, other = (" ".join(r.choice(["ash", "birch", "cedar", "fir", "oak", "pine", "yew"]) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(2))
    rows = [(5, long), (9, long + " end"), (9, other), (12, other)]
    for order in (rows, [rows[0], rows[2], rows[1], rows[3]], rows[::-1]):
        df = frame(spark, order).coalesce(1)
        assert {(x.doc_id, x.component_id) for x in neardup.duplicates(df).collect()} == {(5, 5), (9, 5), (12, 5)}
        assert sorted((x.doc_id, x.text) for x in neardup.kept(df).collect()) == sorted([(5, long), (9, other)])
    again = [(1, "x y z w"), (1, "x y z w"), (1, None), (1, ""), (None, "x y z w")]
    assert sorted(map(str, ((x.doc_id, x.text) for x in neardup.kept(frame(spark, again)).collect()))) == sorted(map(str, [(1, "x y z w"), (1, None), (1, ""), (None, "x y z w")]))


def test_names_that_clash_and_text_ids(spark):
    rows = [("b", "one two three four"), ("a", "One two three four"), ("c", "other words stand here")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id string, text string, _id int, key int, KEY2 int, first int, bands int")
    out = neardup.kept(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == ["a", "c"]
    assert {(x.doc_id, x.component_id) for x in neardup.duplicates(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def thue_morse(k):
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("k", [10, 11, 12])
def test_self_similar_words_are_different(spark, k):
    x, y = thue_morse(k)
    rows = [(1, f"{x} p q"), (2, f"{y} p q"), (3, f"p {y} q"), (4, f"p {y} q")]
    got = neardup.duplicates(frame(spark, rows)).collect()
    assert found(neardup.duplicates(frame(spark, rows))) == brute(rows)
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 3}

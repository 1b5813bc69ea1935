"""The compression classifier: held-out accuracy, defined results and independence of batches."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from ledgerline.llm import quality, textvec

SMALL = quality.Settings(per_label=150, dictionary=8192, piece=400)


def prose(r, good):
    words = ["stone", "river", "walk", "green", "the", "of", "and", "window", "hill"]
    text = [r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(r.randint(20, 120))]
    return " ".join(text) if good else "###".join(w.upper() + "$$%" for w in text)


def corpus(n=400):
    r = random.Random(4)
    return [(k, prose(r, k % 3 > 0), int(k % 3 > 0)) for k in range(n)]


def frames(spark, rows, labels):
    d = spark.createDataFrame([(k, t, "x", 0.5) for k, t in rows], "doc_id long, text string, quality string, score double")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_defined_rows(spark):
    rows = corpus()
    texts = [(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (None, "stone river"), (3, rows[3][1]), (1002, "stone walk, " * 40000)]
    labels = [(k, y, 0, "z") for k, _, y in rows] + [(5000, None, 1, "z"), (None, 1, 0, "z"), (1003, 7, 0, "z")]
    d, lab = frames(spark, texts, labels)
    found = quality.scores(d, lab, SMALL).collect()
    assert len(found) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    by = {r.doc_id: r for r in found}
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)
    held = [(by[k].predicted, y) for k, _, y in rows if by[k].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert by[1000].score == by[1001].score
    assert len({r.score for r in found if r.doc_id == 3}) == 1
    kept = quality.kept(d, lab, SMALL)
    assert kept.columns == d.columns and 0 < kept.count() < len(texts)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows = corpus(200)
    d, lab = frames(spark, [(k, t) for k, t, _ in rows], [(k, y, 0, "z") for k, _, y in rows])
    flipped = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y, 1, "q") for k, _, y in rows], lab.schema)
    a = {r.doc_id: r.score for r in quality.scores(d, lab, SMALL).collect()}
    b = {r.doc_id: r.score for r in quality.scores(d.drop("score").repartition(3), flipped, SMALL).collect()}
    assert a == b


def test_tables_without_rows_or_labels(spark):
    d, lab = frames(spark, [(1, "a"), (2, None)], [(1, 1, 0, "z")])
    assert {r.score for r in quality.scores(d, lab.limit(0)).collect()} == {0.5}
    assert quality.scores(d.limit(0), lab).count() == 0
    assert quality.scores(d, lab).count() == 2


def test_shape_keeps_documents_apart():
    data, bounds = textvec.flat(pa.array(["abC 12é!", "", "aa", "AAb"]))
    got, edges = quality.shape(data, bounds)
    assert [got[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [b"aA 00a!", b"", b"a", b"Aa"]


def plain_views(text):
    """Bytes, shape and rhythm of a text, symbol by symbol."""
    raw = text.encode()
    kinds = ["a" if 97 <= b < 123 or b >= 128 else "A" if 65 <= b < 91 else "0" if 48 <= b < 58 else chr(b) for b in raw]
    shape = "".join(k for n, k in enumerate(kinds) if not (k in "aA" and n and kinds[n - 1] == k)).encode()
    rhythm, before, run = bytearray(), None, 0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        low = bytes(b + 32 if 65 <= b < 91 else b for b in word)
        run = run + 1 if low == before else 0
        rhythm.append(61 + (run - 1) % 192 if run else min(len(word), 60))
        before = low
    return raw, shape, bytes(rhythm)


def plain_score(classifier, text):
    s, figures = classifier.settings, []
    for view, pair in zip(plain_views(text), classifier.dictionaries, strict=True):
        sizes = []
        for own in pair:
            compressor = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(own), write_dict_id=False, write_content_size=False)
            sizes.append(sum(len(compressor.compress(view[k : k + s.chunk])) for k in range(0, len(view), s.chunk)))
        figures.append((sizes[0] - sizes[1]) / (sizes[0] + sizes[1] + 1))
    z = sum(w * (f - m) / d for w, f, m, d in zip(classifier.weights, figures, classifier.mean, classifier.scale, strict=False)) + classifier.weights[-1]
    return 1 / (1 + np.exp(-z))


def test_scores_match_a_plain_version(spark):
    rows = corpus(240)
    texts = [(k, t) for k, t, _ in rows] + [(900, ""), (901, "Go go go GO é é 12 12,"), (902, "river " * 3000)]
    d, lab = frames(spark, texts, [(k, y, 0, "z") for k, _, y in rows])
    classifier = quality.fitted(d, lab, SMALL)
    assert classifier.weights is not None and len(classifier.dictionaries) == quality.VIEWS
    got = {r.doc_id: r.score for r in quality.scores(d, lab, SMALL).collect()}
    assert all(abs(got[k] - plain_score(classifier, t)) < 1e-9 for k, t in texts)


def test_a_column_of_the_scores_name_stays(spark):
    rows = corpus(60)
    d, lab = frames(spark, [(k, t) for k, t, _ in rows], [(k, y, 0, "z") for k, _, y in rows])
    clash = d.withColumn("quality_score", d.score)
    kept = quality.kept(clash, lab, SMALL)
    assert kept.columns == clash.columns and {r.quality_score for r in kept.collect()} == {0.5}


def test_stretches_reach_both_ends():
    s = quality.Settings(piece=4, pieces=3)
    data, bounds = textvec.flat(pa.array(["abcdefghijklmnop", "abc", "", "abcde"]))
    assert quality.stretches(data, bounds, s) == [[b"abcd", b"ghij", b"mnop"], [b"abc"], [], [b"abcd", b"bcde"]]


def test_scoring_holds_a_slice_of_a_batch():
    """The views of a large batch are made slice by slice, so their memory does not grow with it."""
    r = random.Random(2)
    column = pa.array([" ".join(prose(r, k % 2) for _ in range(20)) for k in range(40)] * 25)
    data, bounds = textvec.flat(column)
    assert len(data) > 6 << 20
    words = [prose(r, k % 2).encode() for k in range(400)]
    made = quality.Classifier([(b" ".join(words[::2]), b" ".join(words[1::2]))] * quality.VIEWS, quality.Settings(chunk=1 << 20), 0.5)
    tracemalloc.start()
    whole = made.figures(data, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    few = column.slice(0, 40)
    assert np.array_equal(whole, np.tile(made.figures(*textvec.flat(few)), (25, 1)))

"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import random
import re

import corpus_pipeline
from ledgerline.llm import pii
from tests.llm.test_decontaminate import words_of
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_quality import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(1, "who walked along the silver road before the morning bells rang"), (2, "seven lamps were lit beside the quiet harbour on that winter night")]


def tables(spark, path):
    r = random.Random(8)
    rows = [(k, prose(r, k % 3 > 0)) for k in range(300)]
    labels = [(k, int(k % 3 > 0), 0) for k, _ in rows]
    base = prose(r, True) + " " + prose(r, True)
    rows += [(400, base), (401, base + " end"), (402, base)]
    rows += [(500, prose(r, True) + " " + ITEMS[0][1].upper() + " " + prose(r, True)), (501, f"{ITEMS[0][1]} stone {ITEMS[1][1]} stone river"), (502, ITEMS[0][1] + ".")]
    rows += [(600, prose(r, True) + " write to a.b@c.org or +1 (555) 123-4567 now"), (700, None), (701, "")]
    docs = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_stages_decide_as_their_plain_versions(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = {d[0]: d for d in tables(spark, path)}
    frame = spark.read.parquet(f"{path}/documents.parquet")
    seen, kept = frame, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, path).cache()
        assert seen.schema == frame.schema
        kept.append({r.doc_id: tuple(r) for r in seen.collect()})
    good, one, clean, safe = kept[1:]
    bad = [k for k in range(300) if k % 3 == 0]
    assert sum(k in good for k in bad) <= 3
    assert sum(k in good for k in docs if k < 300 and k % 3) >= 195
    assert {400, 401, 402, 500, 501, 600} <= set(good)
    want = {i for i, _, _, stays in near_brute([(i, d[1]) for i, d in good.items()], 80, 5) if stays}
    assert set(one) == want and 401 not in one and 402 not in one
    assert 501 not in clean and 502 not in clean
    assert set(clean) == set(one) - {501, 502}
    for k, row in clean.items():
        text = " ".join(w.decode() for w in words_of(row[1]) if w)
        assert not any(" ".join(item.split()[a : a + 8]) in text for _, item in ITEMS for a in range(len(item.split()) - 7))
        assert row == one[k] or k == 500 and row[4] == len(row[1]) < one[k][4]
    for k, row in safe.items():
        assert row[1] == pii.redact(clean[k][1]) and (row[1] is None or row[4] == len(row[1]))
    assert re.search(r"write to <email> or <phone> now$", safe[600][1])
    found = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in found} == set(safe)


def test_empty_documents(spark, tmp_path):
    path = f"file://{tmp_path}"
    tables(spark, f"{path}/full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/full/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``. Between stages the documents are a table in the shared folder.

* quality: documents that the compression classifier rejects go.
* near_dedup: of each component of near duplicates (five-word shingles, similarity 0.8 or more) the
  document with the smallest id stays.
* decontaminate: documents with windows of two benchmark items or more go; from the others every occurrence
  of a benchmark window is cut, and a document of which no word is left goes too.
* pii: personal data becomes a mark of its kind.
* pack: token pieces in sequences of 4096.

``n_chars`` follows the text where a stage changes it. Null texts and null ids pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, neardup, packing, pii, quality
from ledgerline.llm.common import table, written

#: Words that packing keeps in a worker: fewer than on its own, since the workers have done the other stages.
KEEP = 100_000
NEAR = neardup.Settings(shingle=5, percent=80, bands=40)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept(docs, NEAR)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"), drop_items=2, size_col="n_chars")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, size_col="n_chars")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, keep=KEEP, release=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("PII", pii_stage),
    ("best-fit packing", pack_stage),
]

#: No stage of these is plain SQL: compression, MinHash with components, tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs

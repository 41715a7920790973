"""From raw documents to packed sequences: five stages, each written and read again.

1. quality classifier: documents scored below the acceptance threshold go;
2. line dedup: lines with an earlier match go; so does a document of which they
   leave no character but white space;
3. near-dedup: of each group of documents linked by their SimHash fingerprints, or by
   a Jaccard similarity of 0.8 or more of their five-word shingles, one stays;
4. benchmark decontamination: documents that hold a benchmark window go;
5. packing: the rest is tokenized and cut into power-of-two pieces.

All but the last return the columns of ``documents``.  A null text is an empty
text to every stage; it has no words to reject, repeat or leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, linededup, neardedup, packing, quality, simhash
from tidemark.llm.common import staged, table


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, into="_score")
    return scored.where(F.col("_score") >= quality.ACCEPT).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(docs)
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.where((F.size("removed_lines") == 0) | left)
    chars = F.when(F.size("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardedup.keep_one(docs, also=lambda rows: simhash.near_duplicates(rows, "row", "text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", accepted),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The classifier, hashes and tokenizer have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = staged(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)

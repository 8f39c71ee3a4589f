"""From raw documents to sampled token ids, in five stages; each reads what the one before wrote.

1. language_id: documents that have no letters, or that no learned language explains, go.
2. line_dedup: lines that match an earlier line go, and documents of which no word is left.
3. near_dedup: of each group of near copies one document stays.
4. mixing: sources are mixed to their target weights; a document that is taken twice is there twice.
5. sentencepiece: each text is segmented by sampling, and decoded again to show that nothing was lost.

Defined results, of each stage and so of all: an empty table gives none but its columns; a document with a null or empty text, or
one without letters, goes in the first stage, so later ones see none of these from it (alone they take a null text as empty);
a null doc_id, lang or source is a value like others; repeated rows are judged each, and near_dedup keeps one of them; texts are
worked on whole, however long; columns besides those of documents pass through all stages untouched, whatever their names (the last
stage's ids, n_pieces and lossless get underscores after their names where the table has such columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.llm._common import documents, fresh_path
from tracegraph.llm.lang_id import reject_languages
from tracegraph.llm.line_dedup import dedup_lines
from tracegraph.llm.mixing import mixed_documents
from tracegraph.llm.pieces import encode_sampled
from tracegraph.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = encode_sampled(docs, check="lossless")
    ids = made.columns[len(docs.columns)]
    taken = {c.lower() for c in made.columns}
    name = next(n for n in ("n_pieces" + "_" * k for k in range(len(taken) + 1)) if n not in taken)
    return made.withColumn(name, F.size(ids).cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Trained models, hashes and sampled segmentations have no SQL; test_pipeline holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

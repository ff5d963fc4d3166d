"""The corpus pipeline: documents in, token ids out.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of :mod:`colloquy.llm`.  It works on all rows
that the stage before kept; all but the last return the columns of ``documents``.  Each stage's result is written as
Parquet to the shared folder and reread.

For every stage: ``docs`` needs ``doc_id`` and ``text``; all other columns pass through the first four as they are,
whatever their names (columns of the stages' own get names that ``docs`` doesn't have).  A null text counts as empty, a
text is never cut, and an empty table gives an empty table.  A document is a row's doc_id *and* text: rows that share a
doc_id, or have none, are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import bpe, decontam, exact, jaccard, quality
from colloquy.llm.shared import forget, hinted, rows_of, written


def _own(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns that ``docs`` doesn't have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _without(docs: DataFrame, gone: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Rows of ``docs`` whose keys (column of docs, column of gone; null equals null) are not in ``gone``."""
    gone = hinted(gone)
    same = [docs[a].eqNullSafe(gone[b]) for a, b in keys]
    return docs.join(gone, [*same], "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.3); the labels are those of ``sf_dir``.

    Each row is judged by its text alone, so repeated rows go or stay together; an empty or null text has a score like any
    other.  A row without doc_id has no label and is judged all the same.
    """
    (score,) = _own(docs, "quality_score")
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), column=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal after lower-casing A-Z, one: that with the largest doc_id (a null is less than any).

    Of several rows with that doc_id and an equal text the one whose columns come first as JSON stays.  Empty and null
    texts are equal to each other, so one of them stays.
    """
    key, one = _own(docs, "dedup_key", "dedup_row")
    found = written(exact.dedup(docs.select("doc_id", "text")).select("doc_id", F.col("text_sha256").alias("dedup_sha"), "kept"), "copies")
    docs = docs.withColumn(key, F.sha2(exact.normalised(F.col("text")), 256))
    gone = written(found.where("NOT kept").select(F.col("doc_id").alias("dedup_id"), "dedup_sha").distinct(), "gone")
    left = _without(docs, gone, ("doc_id", "dedup_id"), (key, "dedup_sha"))
    again = written(found.where("kept").groupBy("dedup_sha").count().where("count > 1").select("dedup_sha"), "again")
    if not rows_of(again):
        return left.drop(key)
    again = hinted(again)
    repeated = left.join(again, left[key] == again["dedup_sha"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != key])
    once = repeated.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias(one)).select(f"{one}.*")
    return left.join(again, left[key] == again["dedup_sha"], "left_anti").drop(key).unionByName(once)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest doc_id (rows without one come
    last; then the smaller hash of doc_id and text).

    Repeated rows of the document that stays all stay.  Texts without words link with nothing and stay.
    """
    (key,) = _own(docs, "near_key")
    row = jaccard.row_key(docs)
    found = written(jaccard.groups(docs.select("doc_id", "text"), row=row).where("root IS NOT NULL").select("doc_id", "row", "root"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    first = found.groupBy("root").agg(F.min(place).alias("first"), F.max("row").alias("last"), F.min("row").alias("least")).where("least < last").select(F.col("root"), F.col("first.row").alias("stays"))
    first = written(first, "first")
    gone = written(found.join(hinted(first), "root").where("row <> stays").select("row").distinct(), "near")
    forget(found, first)
    return _without(docs.withColumn(key, row[0]), gone, (key, "row")).drop(key)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Rows are judged by their texts alone, so repeated rows go or stay together; a text without words is clean.
    """
    (key,) = _own(docs, "leak_key")
    found = decontam.find_items(docs.select(F.xxhash64("text").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(found.where("n_hit > 0").select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return _without(docs.withColumn(key, F.xxhash64("text")), gone, (key, "leak")).drop(key)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with the digests of the ids and of the text decoded from them.

    One row for each row of ``docs``, repeated or without doc_id too; an empty or null text has no tokens.
    """
    return bpe.encode_decode(docs.select("doc_id", "text"), bpe.vocabulary()).drop("decoded")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokenized),
]

#: Classifier and tokenizer are beyond SQL: tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        forget(before)
    return docs

"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import decontaminate, mixing, neardup, quality, tokenfiles
from marlpit.llm.queries import tokenizer_path
from marlpit.llm.shared import NO_ID, discard, id_key, scratch, shared_dir, table, trim, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; its labels are those of the documents at hand.

    A null or empty text is judged by its statistics, a text of any length
    whole; repeated rows are judged alike; without labels all stay; an empty
    table stays empty; other columns, of any name, are kept.
    """
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id, among rows that share it the first by text.

    Null texts and texts without words all stay; a missing doc_id counts as the
    largest; repeated rows are a group; texts are compared whole; an empty
    table stays empty; other columns, of any name, are kept.
    """
    groups = neardup.similar_groups(docs).filter("n_shingles > 0")
    first = groups.groupBy("group_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.col("text_hash").alias("k2"))).alias("x")).select("x.*")
    keyed = docs.select(F.struct("*").alias("row"), id_key().alias("k1"), F.xxhash64("text").alias("k2"), F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)).alias("words"))
    kept = keyed.filter("words").join(first.distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.unionByName(keyed.filter("not words")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null texts and texts without words stay; items without an id count, items
    without words don't; repeated rows are judged alike, long texts whole; an
    empty table stays empty; other columns, of any name, are kept.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, in mixed order.

    A missing source is one of its own; null texts and texts without words have
    no tokens and follow their place; repeated rows get as many copies each; an
    empty table stays empty; other columns, of any name, are kept.
    """
    return mixing.realised(docs, entropy=0.97, repeats=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the token files, which keep the order in which ``docs`` was written.

    Tables that aren't read from files are taken in order of doc_id. A null
    text only has the end id; repeated rows come once each; texts are encoded
    whole; an empty table gives no rows; other columns don't matter.
    """
    order = ("doc_id",)
    try:
        docs, order = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")), ("file", "row")
    except AnalysisException:  # no files
        pass
    return tokenfiles.read_tokens(tokenfiles.write_tokens(docs, tokenizer_path(), order=order))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]
#: A trained model, an iterative join and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet to the shared folder and read again.

    What a stage stores for itself, and the result of the one before, is
    removed once its own result is written.
    """
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        discard(spark, *last)
        trim()
        last = [path]
    return docs

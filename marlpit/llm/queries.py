"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlpit.llm import decontaminate, fingerprints, fixity, identifiers, mixing, neardup, oracles, quality, rules, substrings, tokenfiles
from marlpit.llm.shared import table


def tokenizer_path() -> str:
    """The public tokenizer that the token queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "documents")).drop("text_hash", "group_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.find_personal_data(table(spark, sf_dir, "documents"))


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.remove_seen(table(spark, sf_dir, "documents"), batches=4, fan_in=2).drop("kept_text")


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_tokens(tokenfiles.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), entropy=0.97, repeats=2.0).select("doc_id", "source", "tokens", "weight", "quota", "copies", "place")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True).drop("items", "longest", "located")


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(fixity.warc_records(pages, unnamed=True), fixity.warc_records(fixity.damaged(pages), unnamed=True))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_quality_classifier, op3_personal_data, op4_fingerprint_index, op5_token_planes,
        op6_source_mixing, op7_suffix_array_dedup, op8_decontamination, op9_merkle_fixity, op10_quality_rules,
    )
}
#: The others are trained, iterated or tokenised; they are tested against plain versions.
SQL = {
    "op1_jaccard_join": oracles.JACCARD,
    "op4_fingerprint_index": oracles.FINGERPRINTS,
    "op7_suffix_array_dedup": oracles.SUBSTRINGS,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op9_merkle_fixity": oracles.FIXITY,
}

"""Queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from priorline.llm import chat_format, divergence, fingerprints, html_text, language, media, mixing, ngram_join, packing, repair_ids, sentence_pieces, suffix_dedup, word_runs
from priorline.llm.common import table
from priorline.session import materialize


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut(table(spark, sf_dir, "documents")).selectExpr(*suffix_dedup.DIGESTS, suffix_dedup.TEXT)


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = chat_format.with_control_case(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_segments(source))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.read_ids(repair_ids.write_ids(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.collapse(table(spark, sf_dir, "documents"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_closed_syncmers": op2_closed_syncmers,
    "op3_chat_format": op3_chat_format,
    "op4_source_mixing": op4_source_mixing,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_repair_ids": op6_repair_ids,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_tag_path_ratios": op9_tag_path_ratios,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_source_divergence": op11_source_divergence,
    "op12_word_runs": op12_word_runs,
    "op13_sentence_pieces": op13_sentence_pieces,
}
ORACLE_SQL = {
    "op4_source_mixing": mixing.ORACLE.replace("select doc_id, source, size, source_size", "select doc_id, size, source_size"),
    "op11_source_divergence": divergence.ORACLE,
}

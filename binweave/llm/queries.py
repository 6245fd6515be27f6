"""One query per numbered operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import WORDS, dedup_documents

    return dedup_documents(table(spark, sf_dir, "documents"), words=WORDS)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languages import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(spark, table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join_documents

    return join_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"), tokenizer_path())


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_suffixes": op2_suffixes,
    "op3_licenses": op3_licenses,
    "op4_languages": op4_languages,
    "op5_warc": op5_warc,
    "op6_jaccard": op6_jaccard,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_spotsigs": op10_spotsigs,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_chat": op12_chat,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {"op3_licenses": oracles.licenses(), "op5_warc": oracles.WARC, "op10_spotsigs": oracles.fingerprints(), "op11_conversation_repair": oracles.repair(), "op12_chat": oracles.chats(), "op13_resampling": oracles.resampling()}

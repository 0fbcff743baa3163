"""The training-data operators applied to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import exact_dedup as exact
from lodestar.llm import substring_dedup as substring
from lodestar.llm.common import read_table
from lodestar.llm.decontaminate import contaminated
from lodestar.llm.katz import katz_scores
from lodestar.llm.language_id import identify
from lodestar.llm.packing import pack_documents
from lodestar.llm.rans import token_files
from lodestar.llm.sharding import minimax_shards
from lodestar.llm.simhash import simhash_dedup
from lodestar.llm.token_counts import token_counts

WORD_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark, _docs(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), vocabulary(WORD_TOKENIZER))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(spark, _docs(spark, sf_dir))


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, _docs(spark, sf_dir), vocabulary(WORD_TOKENIZER))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, _docs(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_docs(spark, sf_dir), vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark, _docs(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(spark, _docs(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(spark, _docs(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, _docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_katz_scoring, op2_packing, op3_substring_dedup, op4_rans_tokens, op5_decontamination, op6_token_counts, op7_simhash, op8_exact_dedup, op9_sharding, op10_language_id)}

ORACLES: dict[str, str] = {"op3_substring_dedup": substring.ORACLE, "op8_exact_dedup": exact.ORACLE}

"""Queries over the test tables, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import learn_from, quality_rules, train

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels"), learn_from()))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_binary import digests, token_file

    return digests(token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digests

    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pu_quality import scores, train

    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels"))[0])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scores, train

    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, formatted, with_probe

    return digests(formatted(with_probe(table(spark, sf_dir, "conversations"))))


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import scores

    return scores(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items(), key=lambda x: int(x[0][2:].split("_")[0]) if x[0].startswith("op") else 0) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import chat_format, decontaminate, substring_dedup

    return {"op3_substring_dedup": substring_dedup.ORACLE_SQL, "op4_decontaminate": decontaminate.ORACLE_SQL, "op9_chat_format": chat_format.ORACLE_SQL}

"""Queries of this subpackage, with the SQL they must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import (
    conversations, decision_list, exact, language, lexical, licenses, lines, mixing, order_minhash, ordinal, packing, sentences,
    url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return url_rules.judge(pages, labels)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.select(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_documents(spark, sf_dir))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer(), keep_ids=False).drop("ids")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.classes(_documents(spark, sf_dir))
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    rows = language.predict(docs, model)
    return rows.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decision_list.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *counts, "base_failed", "kept", "reason")


def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup(_documents(spark, sf_dir))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.labels(licenses.scan(_documents(spark, sf_dir)))
    joined = (F.array_join(c, ",").alias(c) for c in ("base_labels", "labels"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.cleaned(_documents(spark, sf_dir))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conversations.damage)


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": url_filter,
        "op2_quality_classifier": quality_classifier,
        "op3_near_dedup": near_dedup,
        "op4_mixture_packing": mixture_packing,
        "op5_exact_dedup": exact_dedup,
        "op6_language_id": language_id,
        "op7_source_mix": source_mix,
        "op8_quality_rules": quality_rules,
        "op9_sentence_dedup": sentence_dedup,
        "op10_license_scan": license_scan,
        "op11_lexical_search": lexical_search,
        "op12_line_dedup": line_dedup,
        "op13_conversation_repair": conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": exact.SQL,
        "op7_source_mix": mixing.SQL,
        "op11_lexical_search": lexical.SQL,
        "op12_line_dedup": lines.SQL,
        "op13_conversation_repair": conversations.SQL,
    }

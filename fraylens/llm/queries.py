"""The operators as registered queries over whole tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraylens.llm import chat, collocations, decontamination, licenses, mixing, packing, phrases, prefix_trie, quality, secret_scans, simhash, suffixes, topk
from fraylens.llm.common import documents, read, sha256_hex, staged
from fraylens.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Template strings that a text may hold; the chat query adds a conversation that says them.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    """The word vocabulary's file: FRAYLENS_TOKENIZER, or the installed public tokenizers."""
    given = os.environ.get("FRAYLENS_TOKENIZER")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    out = quality.judged(docs, rules)
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return out.select("doc_id", *[F.col("stats").getField(n).alias(n) for n in shown])


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.read_back(chat.examples(said.unionByName(own)))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.deduplicated(documents(spark, sf_dir), kept=False)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


@query
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scans.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secret_scans.written(base).cast("binary"), 256).alias("base_sha256"), secret_scans.written(F.col("found")).alias("spans"),
    )


@query
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known_licenses(spark))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path())


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicated(documents(spark, sf_dir), kept=False)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = staged(documents(spark, sf_dir).select("doc_id", "lang", "source", mixing.tokens(F.col("text")).alias("words")))
    out = mixing.mixed(counted, mixing.Mix(), n_tokens=F.col("words"))
    return out.select("row.doc_id", "mix_.*")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(documents(spark, sf_dir).select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    items = F.array_join("leak.items", ",")
    return out.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), sha256_hex(items).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated")
    )


@query
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(read(spark, sf_dir, "conversations"))

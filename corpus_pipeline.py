"""A training corpus from raw documents: quality rules, near-dedup, secret scans, mixing, packing.

``STAGES`` lists the stages; ``run`` applies them to the documents table, each
writing Parquet that the next one reads. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm import mixing, packing, quality, secret_scans, simhash
from fraylens.llm.common import documents, read, staged
from fraylens.llm.queries import tokenizer_path

#: The mix of the corpus: as many tokens as there are, at most four epochs of a document.
MIX = mixing.Mix(domains={}, languages={"en": 3}, share=1.0, epochs=4)

#: No SQL: learned rules, fingerprints and packing are beyond it; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judged(docs, rules, "quality_").where("quality_.kept").select(*docs.columns)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    stands = simhash.components(docs).where("stands").select(_id(), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), _id(), F.xxhash64("text").alias("text_hash"))
    equal = Window.partitionBy("id", "text_hash").orderBy("row.lang", "row.source", "row.n_chars")  # the join's own partitioning
    kept = rows.join(stands, ["id", "text_hash"], "left_semi").withColumn("nth", F.row_number().over(equal))
    return kept.where("nth = 1").select("row.*")


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret replaced; n_chars follows."""
    found, _ = secret_scans.scan(docs)
    hits = found.where(F.size("found") > 0).select(F.col("path").alias("doc_id"), "blob", "found").select(_id(), "blob", "found").dropDuplicates(["id", "blob"])
    rows = docs.select(F.struct("*").alias("row"), _id(), secret_scans.sha256_hex(F.col("text")).alias("blob"))
    out = rows.join(hits, ["id", "blob"], "left")  # by id too: the copies of one text stay spread
    hit = F.col("found").isNotNull()
    text = F.when(hit, secret_scans.redacted(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(hit, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, once for each epoch that takes them."""
    return mixing.mixed(docs, MIX).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets_masked),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

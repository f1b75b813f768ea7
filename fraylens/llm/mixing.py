"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is root, domain, language, source. A token budget goes down it: the
children of a node share by weight, none beyond its capacity (its tokens times
``epochs``); what a child cannot take goes to its siblings first, because a
subtree only hands tokens up when all of it is full. Shares are the water level
of a sorted running sum, so a level is two windows over tree nodes.

A leaf takes its documents in seeded epochs: whole epochs first, then the prefix
of one more in the order of MD5(seed:epoch:doc_id) that begins below what is left
of its budget; the document at the edge stays whole. Prefix sums run over buckets
of that order first and inside buckets then, so a leaf of any size is spread.

Defined cases: null parts of the tree are the part ''; a null text has no tokens;
nodes of weight 0 get nothing; repeated rows are documents of their own; shares
are rounded down; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fraylens.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: A bucket of the seeded order is named by so many hexadecimal digits.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """``share`` of all tokens is the budget; a document is used in at most ``epochs`` epochs."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    share: float = 0.5
    epochs: int = 3
    seed: int = 42


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def domain_of(source: Column) -> Column:
    """Four domains by the number at the end of a source's name, 'd-' without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("d-")).otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


def _weight(value: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(value == name, weight).otherwise(out)
    return out.cast("long")


def _shared(nodes: DataFrame, parent: list[str], key: str, given: str) -> DataFrame:
    """``nodes`` (with ``cap``, ``weight`` and the parent's budget ``given``) with their ``budget``."""
    among = Window.partitionBy(*parent)
    filling = among.orderBy(F.col("cap") / F.col("weight"), key)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(given) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(among) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = nodes.where("weight > 0").withColumn("level", left.cast("double") / open_weight).withColumn("all_caps", F.sum("cap").over(among))
    top = leveled.withColumn("level", F.max("level").over(among))
    budget = F.when(F.col(given) >= F.col("all_caps"), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("weight") * F.col("level")).cast("long")))
    return top.withColumn("budget", budget).drop("level", "all_caps")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, available and budget of every leaf, from (domain, lang, source, available)."""
    caps = leaves.withColumn("cap", F.col("available") * mix.epochs)
    total = caps.groupBy().agg(F.floor(F.sum("available") * mix.share).cast("long").alias("total"))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.lit(1).alias("root")).join(total.withColumn("one", F.lit(1)), F.col("root") == F.col("one"))
    domains = _shared(domains.withColumn("weight", _weight(F.col("domain"), mix.domains)), ["root"], "domain", "total")
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains.select("domain", F.col("budget").alias("given")), "domain")
    langs = _shared(langs.withColumn("weight", _weight(F.col("lang"), mix.languages)), ["domain"], "lang", "given")
    leaf = caps.join(langs.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"])
    leaf = _shared(leaf.withColumn("weight", _weight(F.col("source"), mix.sources)), ["domain", "lang"], "source", "given")
    return leaf.select("domain", "lang", "source", "available", "budget")


def mixed(docs: DataFrame, mix: Mix, n_tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """The chosen rows: ``row`` (all columns of ``docs``), ``mix_`` (domain, lang, source, epoch, n_tokens), once an epoch."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n_tokens = tokens(F.col("text")) if n_tokens is None else n_tokens
    domain = domain_of(F.col("source")) if domain is None else domain
    leaf = ["domain", "lang", "source"]
    keyed = docs.select(
        F.struct("*").alias("row"), domain.alias("domain"), part("lang").alias("lang"), part("source").alias("source"), n_tokens.alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
    )
    totals = staged(keyed.groupBy(*leaf).agg(F.sum("n_tokens").alias("available")))
    plan = budgets(totals.where("available > 0"), mix)
    plan = plan.select(
        *leaf, F.expr("budget div available").alias("whole"), (F.col("budget") % F.col("available")).alias("rest"),
    )
    plan = staged(plan.where("whole > 0 OR rest > 0"))
    return _prefixes(keyed, plan, leaf, mix)


def _prefixes(keyed: DataFrame, plan: DataFrame, leaf: list[str], mix: Mix) -> DataFrame:
    # The order depends on the epoch, the epoch only on the leaf: every possible last epoch's order is one hash of a row.
    ordered = keyed.join(plan, leaf).withColumn("order", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), "id").cast("binary")))
    ordered = ordered.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = ordered.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    base = F.sum("in_bucket").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    based = sums.select(*leaf, "bucket", F.coalesce(base, F.lit(0)).alias("base"))
    inside = Window.partitionBy(*leaf, "bucket").orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(based, [*leaf, "bucket"]).where("whole > 0 OR base < rest")
    placed = placed.withColumn("begins", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    times = F.col("whole") + F.when(F.col("begins") < F.col("rest"), 1).otherwise(0)
    return placed.where(times > 0).select(
        "row", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("epoch"), *leaf, "n_tokens"
    ).select("row", F.struct(*leaf, F.col("epoch"), F.col("n_tokens")).alias("mix_"))

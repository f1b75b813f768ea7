"""Characters seen in logs and characters linked to users.

A character is a (player_id, server_id) pair; an unknown server is a value of
its own, so the joins compare null-safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.sources.catalog import latest_per_key


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    match = left["player_id"] == right["player_id"]
    match = match & left["server_id"].eqNullSafe(right["server_id"])
    for key in keys:
        match = match & (left[key] == right[key])
    return match


def seen_characters(uploaded: DataFrame, live: DataFrame) -> DataFrame:
    """Characters of uploads and live sessions; the live entry, then the later one, wins."""
    both = uploaded.withColumn("__source", F.lit(0)).unionByName(live.withColumn("__source", F.lit(1)))
    keyed = both.withColumn("__server", F.coalesce("server_id", F.lit("")))
    latest = latest_per_key(keyed, ["owner_id", "player_id", "__server"], [F.col("__source"), F.col("seen_order")])
    return latest.drop("__server", "__source", "seen_order")


def available_characters(seen: DataFrame, linked: DataFrame) -> DataFrame:
    """Seen characters the owner has not linked yet."""
    mine = linked.select(F.col("user_id").alias("owner_id"), "player_id", "server_id")
    return seen.join(mine, _same(seen, mine, "owner_id"), "left_anti")


def claimed_by_others(claims: DataFrame, linked: DataFrame) -> DataFrame:
    """Claims on a character some other user has already linked."""
    owners = linked.select("user_id", "player_id", "server_id")
    return claims.join(owners, _same(claims, owners) & (claims["user_id"] != owners["user_id"]), "left_semi")


def proven_claims(claims: DataFrame, seen: DataFrame) -> DataFrame:
    """Claims on a character that appeared in the claimant's own uploads or sessions."""
    own = seen.select(F.col("owner_id").alias("user_id"), "player_id", "server_id")
    return claims.join(own, _same(claims, own, "user_id"), "left_semi")

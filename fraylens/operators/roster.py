"""Scheduled operations and their signups.

Signups are (operation_id, user_id, display_name, character_name, status,
responded_at); operations are (operation_id, guild_id, title, scheduled_for,
difficulty, group_size, cancelled_at, ...).  Places are given in response order,
scanned in blocks of a day so that one crowded operation spreads over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraylens.functions import text
from fraylens.operators import scan
from fraylens.sources.catalog import latest_per_key

STATUSES = ("tank", "healer", "dps", "bench", "declined")
PLACED = ("tank", "healer", "dps")


def day_block(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date")).cast("bigint")


def latest_signups(answers: DataFrame, order: list[str]) -> DataFrame:
    """Last answer per operation and user; ``order`` makes answers of one instant comparable."""
    return latest_per_key(answers, ["operation_id", "user_id"], [F.col(c) for c in order])


def place_signups(signups: DataFrame, operations: DataFrame, tie_break: str = "user_id") -> DataFrame:
    """Signups with their place in the role's queue and whether it is confirmed or waitlisted."""
    queued = scan.running(
        signups, ["operation_id", "status"], ["responded_at", tie_break], day_block("responded_at"),
        {"place": scan.total(F.lit(1).cast("bigint"))},
    )
    limits = operations.select("operation_id", text.limits(F.col("group_size")).alias("__limits"))
    joined = queued.join(limits, "operation_id")
    role_limit = (
        F.when(F.col("status") == "tank", F.col("__limits.tanks")).when(F.col("status") == "healer", F.col("__limits.healers"))
        .when(F.col("status") == "dps", F.col("__limits.dps"))
    )
    placement = (
        F.when(~F.col("status").isin(*PLACED), F.col("status"))
        .when(F.col("place") <= role_limit, "confirmed").otherwise("waitlisted")
    )
    return joined.withColumns({"role_limit": role_limit, "placement": placement}).drop("__limits")


def roster_summary(placed: DataFrame, operations: DataFrame) -> DataFrame:
    """Confirmed, waiting, benched and declined per operation, and the slots still open."""

    def confirmed(status: str) -> Column:
        return F.count_if((F.col("status") == status) & (F.col("placement") == "confirmed"))

    counts = placed.groupBy("operation_id").agg(
        confirmed("tank").alias("tanks"), confirmed("healer").alias("healers"), confirmed("dps").alias("dps"),
        F.count_if(F.col("placement") == "waitlisted").alias("waitlisted"),
        F.count_if(F.col("status") == "bench").alias("bench"),
        F.count_if(F.col("status") == "declined").alias("declined"),
        F.count(F.lit(1)).alias("signups"),
    )
    joined = operations.select("operation_id", text.limits(F.col("group_size")).alias("l")).join(counts, "operation_id", "left")
    joined = joined.na.fill(0)
    confirmed_count = F.col("tanks") + F.col("healers") + F.col("dps")
    slots = F.col("l.tanks") + F.col("l.healers") + F.col("l.dps")
    open_of = {r: F.greatest(F.lit(0), F.col(f"l.{r}") - F.col(r)) for r in ("tanks", "healers", "dps")}
    return joined.select(
        *counts.columns,
        confirmed_count.alias("confirmed"), slots.cast("bigint").alias("total_slots"), (confirmed_count >= slots).alias("is_full"),
        *[v.cast("bigint").alias(f"open_{k}") for k, v in open_of.items()],
        text.open_slots_text(confirmed_count >= slots, open_of["tanks"], open_of["healers"], open_of["dps"]).alias("open_text"),
    )


def suggest_core(signups: DataFrame, operations: DataFrame, order: str = "signup_order") -> DataFrame:
    """Core roster in sign-up order; who signed up otherwise sits on the bench.

    Unlike the placement above this follows the stored order of the signups, and
    declined users appear nowhere.
    """
    queued = scan.running(
        signups.filter(F.col("status") != "declined"), ["operation_id", "status"], [order],
        day_block("responded_at") if order == "responded_at" else scan.line_block(1 << 18, order),
        {"place": scan.total(F.lit(1).cast("bigint"))},
    )
    limits = operations.select("operation_id", text.limits(F.col("group_size")).alias("__limits"))
    target = (
        F.when(F.col("status") == "tank", F.col("__limits.tanks")).when(F.col("status") == "healer", F.col("__limits.healers"))
        .when(F.col("status") == "dps", F.col("__limits.dps")).otherwise(0)
    )
    return queued.join(limits, "operation_id").withColumn(
        "suggestion", F.when(F.col("place") <= target, F.col("status")).otherwise("bench")
    ).drop("__limits")


def bench_of(signups: DataFrame, suggested: DataFrame) -> DataFrame:
    """Signups that neither declined nor were suggested for a core place."""
    core = suggested.filter(F.col("suggestion") != "bench").select("operation_id", "user_id")
    return signups.filter(F.col("status") != "declined").join(core, ["operation_id", "user_id"], "left_anti")


def upcoming(operations: DataFrame, guild_id, now: Column) -> DataFrame:
    """Operations of a guild that are not cancelled and not past; callers order by ``scheduled_for``."""
    return operations.filter(
        (F.col("guild_id") == guild_id) & F.col("cancelled_at").isNull() & (F.col("scheduled_for") >= now)
    )


def schedule_headline(operations: DataFrame, signups: DataFrame) -> DataFrame:
    """Next operation, how many are listed and how many signed up."""
    counts = signups.groupBy("operation_id").agg(F.count(F.lit(1)).alias("__n"))
    return operations.join(counts, "operation_id", "left").agg(
        F.min_by("title", F.struct("scheduled_for", "operation_id")).alias("next_title"),
        F.min("scheduled_for").alias("next_time"),
        F.count(F.lit(1)).alias("upcoming_count"),
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("total_signups"),
    )


def calendar_totals(summary: DataFrame, operations: DataFrame) -> DataFrame:
    """Open slots of all live operations, and signups of all operations."""
    live = operations.select("operation_id", F.col("cancelled_at").isNull().alias("__live"))
    free = F.col("open_tanks") + F.col("open_healers") + F.col("open_dps")
    return summary.join(live, "operation_id").agg(
        F.sum(F.when(F.col("__live"), free).otherwise(0)).alias("open_slots"), F.sum("signups").alias("signups")
    )


def operation_titles(requests: DataFrame, operations: DataFrame, encounters: DataFrame) -> DataFrame:
    """Title given, else the operation's and encounter's names, else a plain word."""
    ops = operations.select(F.col("id").alias("operation_ref"), F.col("name").alias("__op"))
    enc = encounters.select(F.col("id").alias("encounter_ref"), F.col("name").alias("__enc"))
    joined = requests.join(ops, "operation_ref", "left").join(enc, "encounter_ref", "left")
    inferred = F.when(F.col("__op").isNotNull(), F.concat_ws(" · ", "__op", "__enc"))
    return joined.withColumn("title", F.coalesce("title", inferred, F.lit("Operation"))).drop("__op", "__enc")


def default_character(signups: DataFrame, characters: DataFrame) -> DataFrame:
    """Fills a missing character with the user's first linked one."""
    first = characters.groupBy("user_id").agg(F.min_by("name", "linked_order").alias("__first"))
    joined = signups.join(first, "user_id", "left")
    return joined.withColumn("character_name", F.coalesce("character_name", "__first")).drop("__first")


def operation_versions(changes: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """Current state of every operation from an append-only change table.

    A change sets the fields it does not leave null; cancelling sets
    ``cancelled_at`` and never deletes; a new group size without limits of its
    own resets the limits to that size's default.
    """
    at = F.struct(*order)
    resets = F.when(F.col("group_size").isNotNull() & F.col("limits").isNull(), text.limits(F.col("group_size")))
    effective = changes.withColumn("limits", F.coalesce("limits", resets))
    return effective.groupBy("operation_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in [*fields, "limits", "cancelled_at"]]
    )


def signup_sheet(placed: DataFrame, operations: DataFrame, summary: DataFrame) -> DataFrame:
    """Text of the signup post: who holds each role, the waitlist, bench and footer.

    Lists are bounded by the signups of one operation's post.
    """
    who = F.when(F.col("character_name").isNull(), F.col("display_name")).otherwise(
        F.concat(F.col("display_name"), F.lit(" ("), F.col("character_name"), F.lit(")"))
    )
    role_order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))

    def names(condition: Column, by_role: bool = False) -> Column:
        key = [role_order.alias("r")] if by_role else []
        listed = F.array_sort(F.collect_list(F.when(condition, F.struct(*key, "responded_at", "user_id", who.alias("who")))))
        joined = F.array_join(listed.getField("who"), "\n")
        return F.when(joined == "", F.lit(text.DASH)).otherwise(joined)

    confirmed = F.col("placement") == "confirmed"
    lists = placed.groupBy("operation_id").agg(
        *[names(confirmed & (F.col("status") == s)).alias(f"{s}_names") for s in PLACED],
        names(F.col("placement") == "waitlisted", by_role=True).alias("waitlist_names"),
        names(F.col("status") == "bench").alias("bench_names"),
        names(F.col("status") == "declined").alias("declined_names"),
    )
    ops = operations.select("operation_id", "title", "scheduled_for", "cancelled_at", "difficulty", "group_size", text.limits(F.col("group_size")).alias("l"))
    joined = ops.join(summary, "operation_id").join(lists, "operation_id", "left")
    cancelled = F.col("cancelled_at").isNotNull()
    unix = F.unix_timestamp("scheduled_for").cast("string")
    when = F.when(cancelled, "**Cancelled**").otherwise(F.concat(F.lit("<t:"), unix, F.lit(":F> · <t:"), unix, F.lit(":R>")))
    mode = text.mode(F.col("difficulty"), F.col("group_size"))

    def heading(label: str, have: str, limit: str) -> Column:
        return F.format_string(f"{label} %d/%d", F.col(have), F.col(limit))

    return joined.select(
        "operation_id", "title",
        F.concat_ws("\n", when, F.when(mode != "", mode)).alias("description"),
        heading("Tanks", "tanks", "l.tanks").alias("tanks_title"), F.coalesce("tank_names", F.lit(text.DASH)).alias("tank_names"),
        heading("Healers", "healers", "l.healers").alias("healers_title"), F.coalesce("healer_names", F.lit(text.DASH)).alias("healer_names"),
        heading("DPS", "dps", "l.dps").alias("dps_title"), F.coalesce("dps_names", F.lit(text.DASH)).alias("dps_names"),
        *[F.when(F.col(c) != text.DASH, F.col(c)).alias(c) for c in ("waitlist_names", "bench_names", "declined_names")],
        F.when(cancelled, 0x7B968A).when(F.col("is_full"), 0x4ADE80).otherwise(0xD4AF37).alias("color"),
        F.when(cancelled, "Cancelled").otherwise(F.col("open_text")).alias("footer"),
    )

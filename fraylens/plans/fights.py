"""The whole analysis of an event table as one set of lazy tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraylens.operators import abilities, challenges, deaths, effects, encounters, enemies, mechanics, metrics, segment, victories
from fraylens.operators.segment import PULL
from fraylens.operators.staging import staged
from fraylens.options import Options
from fraylens.sources.catalog import Catalog


class Fights:
    """Tables derived from one flat event table; nothing runs until one is used.

    ``gap_only`` cuts pulls by plain silence instead of the full state machine.
    ``whole`` sums integral amounts as integers. ``stored`` writes the events and
    the tagged events once, for analyses that read them many times; ``tagged_once``
    writes the tagged events alone, which spares their join for every reader, and packs the facts.
    """

    def __init__(
        self, events: DataFrame, catalog: Catalog, options: Options, gap_only: bool = False, whole: bool = False, stored: bool = False,
        tagged_once: bool = False,
    ):
        self._given, self.catalog, self.options = events, catalog, options
        self._gap_only, self._whole, self._stored, self._tagged_once = gap_only, whole, stored, tagged_once

    def _kept(self, df: DataFrame) -> DataFrame:
        return staged(df, packed=True) if self._stored else df

    @cached_property
    def events(self) -> DataFrame:
        return self._kept(self._given)

    @cached_property
    def pulls(self) -> DataFrame:
        if self._gap_only:
            return segment.gap_pulls(self.events, self.options)
        hits = victories.victory_hits(segment.session_context(self.events, self.options), self.catalog.encounter_defs)
        return segment.segment_pulls(self.events, self.catalog, self.options, hits)

    @cached_property
    def tagged(self) -> DataFrame:
        """Events with their pull: one interval join against the small table of pulls."""
        tagged = segment.tag_pulls(self.events, self.pulls)
        return staged(tagged, packed=True, joined=True) if self._tagged_once else self._kept(tagged)

    @cached_property
    def contributions(self) -> DataFrame:
        flagged = metrics.with_ability_flags(self.tagged, self.catalog.off_gcd, self.catalog.interrupts)
        return metrics.contributions(flagged)

    @cached_property
    def actors(self) -> DataFrame:
        return metrics.actor_metrics(self.events, self.tagged, self.pulls, self.catalog, self.options, self._whole)

    @cached_property
    def buckets(self) -> DataFrame:
        return metrics.metric_buckets(self.tagged, self.pulls, self.options, whole=self._whole)

    @cached_property
    def sightings(self) -> DataFrame:
        return enemies.sightings(self.tagged)

    @cached_property
    def enemies(self) -> DataFrame:
        return enemies.enemy_lifecycle(self.sightings, self.catalog.npc_catalog)

    @cached_property
    def enemy_rows(self) -> DataFrame:
        return enemies.enemy_contributions(self.tagged)

    @cached_property
    def enemy_players(self) -> DataFrame:
        return enemies.enemy_players(self.enemy_rows, whole=self._whole)

    @cached_property
    def ability_rows(self) -> DataFrame:
        return abilities.ability_rows(self.tagged)

    @cached_property
    def ability_usage(self) -> DataFrame:
        return abilities.ability_usage(self.ability_rows, self.catalog.abilities, whole=self._whole)

    @cached_property
    def facts(self) -> DataFrame:
        """Pull-level facts, written once: matching, boss and outcome all read them."""
        return staged(encounters.pull_facts(self.tagged), packed=self._tagged_once, joined=self._tagged_once)

    @cached_property
    def engaged(self) -> DataFrame:
        return encounters.engaged_npcs(self.facts, self.catalog.npc_catalog)

    @cached_property
    def dead(self) -> DataFrame:
        return encounters.dead_npcs(self.facts, self.catalog.npc_catalog)

    @cached_property
    def matches(self) -> DataFrame:
        return staged(encounters.match_encounters(self.engaged, self.pulls, self.catalog))

    @cached_property
    def running_matches(self) -> DataFrame:
        return encounters.match_encounters(self.engaged, self.pulls, self.catalog, steps=True)

    @cached_property
    def evidence(self) -> DataFrame:
        return encounters.victory_evidence(self.tagged, self.running_matches, self.catalog.encounters, self.options)

    @cached_property
    def cleared(self) -> DataFrame:
        proven = self.evidence.select(*PULL).unionByName(self.runtime_wins.select(*PULL)).distinct()
        return encounters.encounter_cleared(self.matches, self.dead, proven, self.catalog)

    @cached_property
    def runtime_wins(self) -> DataFrame:
        """Pulls that a definition's victory trigger won."""
        local = self.tagged.join(self.pulls.select(*PULL, "local_player_id"), PULL)
        return victories.runtime_wins(self.tagged, victories.victory_hits(local, self.catalog.encounter_defs), self.bindings)

    @cached_property
    def boss(self) -> DataFrame:
        return encounters.boss_of_pull(self.facts, self.engaged, self.matches, self.options)

    @cached_property
    def phase_entries(self) -> DataFrame:
        """Phase changes of the pulls, a few rows each."""
        return effects.phase_entries(effects.phase_candidates(self.tagged, self.matches, self.catalog.encounters))

    @cached_property
    def phased(self) -> DataFrame:
        """Events with the phase of their pull."""
        return effects.phase_tagged(self.tagged, self.phase_entries)

    @cached_property
    def resets(self) -> DataFrame:
        return encounters.single_instance_resets(self.sightings, self.matches, self.catalog, self.options)

    @cached_property
    def participants(self) -> DataFrame:
        return encounters.participants(self.facts)

    @cached_property
    def player_deaths(self) -> DataFrame:
        return deaths.player_deaths(self.tagged)

    @cached_property
    def dead_players(self) -> DataFrame:
        return encounters.dead_players(self.facts)

    @cached_property
    def outcomes(self) -> DataFrame:
        return encounters.pull_outcomes(
            self.pulls, self.matches, self.cleared, self.boss, self.dead, self.dead_players, self.participants,
            self.resets if self.options.strict_reset else None,
        )

    @cached_property
    def entity_roles(self) -> DataFrame:
        return encounters.entity_roles(self.enemies, self.matches, self.catalog)

    @cached_property
    def fights(self) -> DataFrame:
        """One row per pull with everything the roll-ups read."""
        first_boss = encounters.first_boss_entity(self.entity_roles)
        died = self.dead_players.groupBy(*PULL).agg(F.sum("deaths").alias("player_deaths"))
        dealt = self.facts.filter("fact = 'part'").groupBy(*PULL).agg(
            F.sum("damage").cast("bigint" if self._whole else "double").alias("damage")
        )
        joined = self.outcomes.join(first_boss, PULL, "left").join(died, PULL, "left").join(dealt, PULL, "left")
        return staged(joined.na.fill(0, ["player_deaths", "damage"]))

    @cached_property
    def bindings(self) -> DataFrame:
        """The encounter definition of a pull, at every line that could change it."""
        return staged(encounters.match_definitions(self.engaged, self.catalog.encounter_defs, steps=True))

    @cached_property
    def mechanics(self) -> DataFrame:
        """Phase, counter, timer, shield and victory records, and the counters and the phase as they stand after a line; written once."""
        return staged(mechanics.run_mechanics(self.tagged, self.pulls, self.bindings, self.catalog))

    @cached_property
    def definition_phased(self) -> DataFrame:
        """Events with the phase of the pull's definition."""
        return effects.phase_tagged(self.tagged, mechanics.phase_entries(self.mechanics))

    @cached_property
    def challenges(self) -> challenges.Challenges:
        segments = mechanics.phase_segments(self.mechanics, self.pulls)
        return challenges.Challenges(self.tagged, self.pulls, self.bindings, self.mechanics, segments, self.catalog.encounter_defs)

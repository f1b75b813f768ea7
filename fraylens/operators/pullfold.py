"""The order-dependent part of pull segmentation: when does silence end a pull.

The threshold depends on what has died since the pull opened, so this is a fold
over ordered steps.  It is shared by the batch job (which feeds it collapsed
runs of events) and by the live state processor (which feeds single events).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fraylens.functions import fixed
from fraylens.options import Options

_NOT_TEXTUAL = re.compile(fixed.BOSS_DEFEAT_TEXT, re.IGNORECASE)


def _norm(text: str) -> str:
    return text.strip().lower()


class EncounterMatcher:
    """Best catalogue match of an engaged set, and whether that match is beaten."""

    def __init__(self, encounters: list[dict], definitions: list[dict] | None = None):
        self._rows = encounters
        self._by_name: dict[str, list[int]] = {}
        self._by_id: dict[str, set[int]] = {}
        for position, row in enumerate(encounters):
            for name in row["boss_names"] or []:
                self._by_name.setdefault(name, []).append(position)
            for npc_id in (row["boss_npc_ids"] or []) + (row["observed_ids"] or []):
                self._by_id.setdefault(npc_id, set()).add(position)
        self._definitions = definitions or []

    @property
    def names(self) -> set[str]:
        required = {name for row in self._rows for name in row["victory_requires"] or []}
        return set(self._by_name) | required

    @property
    def npc_ids(self) -> set[str]:
        return set(self._by_id) | {i for d in self._definitions for i in d["bossNpcIds"] or []}

    @property
    def text_markers(self) -> list[str]:
        """Marker words some encounter accepts as textual victory evidence."""
        texts = [r["victory_event"].lower() for r in self._rows if not _NOT_TEXTUAL.search(r["victory_event"] or "")]
        return [m for m in fixed.VICTORY_MARKERS if any(m in t for t in texts)]

    def resolve(self, names: set[str], ids: set[str], zone_id, zone_name) -> dict | None:
        scores: dict[int, int] = {}
        for name in names:
            for position in self._by_name.get(name, ()):
                scores[position] = scores.get(position, 0) + 2
        for position in {p for i in ids for p in self._by_id.get(i, ())}:
            scores[position] = scores.get(position, 0) + 8
        best, best_score = None, -1
        for position in sorted(scores):
            score = scores[position] + self._zone_score(self._rows[position], zone_id, zone_name)
            if score > best_score:
                best, best_score = self._rows[position], score
        return best

    @staticmethod
    def _zone_score(row: dict, zone_id, zone_name) -> int:
        if zone_id is not None and zone_id in (row["zone_ids"] or ()):
            return 6
        if zone_name is not None and _norm(zone_name) in (row["zone_names"] or ()):
            return 4
        return 0

    @staticmethod
    def cleared(row: dict, dead_names: set[str], dead_ids: set[str]) -> bool:
        wanted = row["victory_requires"] or row["boss_names"] or []
        beaten = [name in dead_names for name in wanted]
        by_id = any(i in dead_ids for i in row["boss_npc_ids"] or [])
        if len(wanted) == 1 and by_id and not beaten[0]:
            return True
        return all(beaten) if row["victory_requires"] else any(beaten)

    @staticmethod
    def text_evidence(row: dict, text: str) -> bool:
        victory = row["victory_event"] or ""
        if _NOT_TEXTUAL.search(victory):
            return False
        victory = victory.lower()
        return any(m in victory and m in text for m in fixed.VICTORY_MARKERS)

    def definition(self, ids) -> dict | None:
        """Definition with most engaged bosses; the first one touched wins a tie."""
        counts: dict[int, int] = {}
        for npc_id in ids:
            for position, definition in enumerate(self._definitions):
                if npc_id in (definition["bossNpcIds"] or ()):
                    counts[position] = counts.get(position, 0) + 1
        if not counts:
            return None
        return self._definitions[max(counts, key=counts.get)]


@dataclass
class Step:
    """One event, or a run of events in which nothing but the clock can move."""

    line: int
    ts: int
    area: bool = False
    enter: bool = False
    exit: bool = False
    run: bool = False
    activity: tuple[int, int] | None = None  # (line, ts) of the first activity
    clock_ts: int | None = None  # time of the last clock event
    engaged: list[tuple[str, str]] = field(default_factory=list)  # (npc id, canonical name)
    died: tuple[str, str, str] | None = None  # (npc id, raw name, canonical name)
    text: str | None = None
    victory_of: list[str] = field(default_factory=list)  # definitions whose victory trigger it meets
    hit: bool = False
    context: tuple = ()
    zone: tuple = (None, None)


@dataclass
class Closed:
    start_line: int
    started_at: int
    ended_at: int
    close_line: int | None
    reason: str | None
    hit: bool
    context: tuple


class PullFold:
    """Applies the steps of one log in order and yields the pulls they close."""

    def __init__(self, matcher: EncounterMatcher, options: Options, exit_pending: bool = False):
        self._matcher = matcher
        self._options = options
        self.exit_pending = exit_pending
        self.open: Closed | None = None
        self.last_closed: int | None = None

    def snapshot(self) -> tuple:
        return (self.exit_pending, self.last_closed, self.open and (self.open.start_line, self.last_activity))

    def _begin(self, line: int, ts: int, step: Step) -> None:
        if self.open is not None:
            return
        if self.last_closed is not None and ts - self.last_closed < self._options.reopen_guard_ms:
            return
        self.open = Closed(line, ts, ts, None, None, False, step.context)
        self.last_activity = ts
        self._zone = step.zone
        self._names: set[str] = set()
        self._ids: dict[str, None] = {}
        self._dead_names: set[str] = set()
        self._dead_ids: set[str] = set()
        self._match: dict | None = None
        self._evidence = False
        self._met: set[str] = set()  # definitions whose victory trigger was met before one was bound

    def _finish(self, line: int | None, reason: str | None) -> Closed:
        pull, self.open = self.open, None
        self.last_closed = self.last_activity
        pull.ended_at = max(self.last_activity, pull.started_at)
        pull.close_line, pull.reason = line, reason
        return pull

    def victory(self) -> bool:
        if self._match is None:
            return False
        return self._evidence or self._matcher.cleared(self._match, self._dead_names, self._dead_ids)

    def _limit(self) -> int:
        """The silence that ends the open pull as things stand."""
        if self.victory():
            return self._options.boss_cleanup_ms
        return self._options.exit_grace_ms if self.exit_pending else self._options.idle_ms

    def silence_left(self, now: int) -> int | None:
        """How much longer the open pull may stay silent after ``now``."""
        return None if self.open is None else max(0, self._limit() - (now - self.last_activity))

    def expire(self, line: int | None, now: int) -> Closed | None:
        if self.open is None or now - self.last_activity < self._limit():
            return None
        self.exit_pending = False
        return self._finish(line, "sustained-silence")

    def _add(self, step: Step) -> None:
        if step.text is not None and self._match is not None and not self._evidence:
            self._evidence = self._matcher.text_evidence(self._match, step.text)
        new = [pair for pair in step.engaged if pair[0] not in self._ids or pair[1] not in self._names]
        for npc_id, name in new:
            self._ids[npc_id] = None
            self._names.add(name)
        if new:
            self._match = self._matcher.resolve(self._names, set(self._ids), *self._zone)
        if step.died is not None:
            npc_id, raw, canonical = step.died
            self._dead_ids.add(npc_id)
            self._dead_names |= {_norm(raw), _norm(canonical)}
        if step.victory_of or (self._met and new):
            self._meet(set(step.victory_of))
        self.open.hit = self.open.hit or step.hit
        if step.clock_ts is not None:
            self.last_activity = step.clock_ts

    def _meet(self, met: set[str]) -> None:
        """A victory trigger counts for the definition that is bound; the first one bound also gets what was met before it."""
        bound = self._matcher.definition(self._ids)
        if bound is None:
            self._met |= met
            return
        if self._met:
            met, self._met = met | self._met, set()
        self._evidence = self._evidence or bound["id"] in met

    def push(self, step: Step) -> Closed | None:
        """Applies one step; returns the pull it closed, if any."""
        if step.area:
            closed = self._finish(step.line, "stream-ended") if self.open is not None else None
            self.exit_pending = False
            return closed
        if step.exit:
            self.exit_pending = True
            return None
        closed = None if step.run else self.expire(step.line, step.ts)
        if step.enter:
            self._begin(step.line, step.ts, step)
        if step.activity is not None:
            self._begin(*step.activity, step)
            self.exit_pending = False
        if self.open is not None:
            self._add(step)
        return closed

    def end(self, reason: str | None = "stream-ended") -> Closed | None:
        return None if self.open is None else self._finish(None, reason)

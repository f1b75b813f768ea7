"""Thresholds shared by the batch and the live operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """All tunables of the analysis; every duration is in milliseconds."""

    idle_ms: int = 8_000
    exit_grace_ms: int = 2_500
    boss_cleanup_ms: int = 3_000
    min_duration_ms: int = 4_000
    reopen_guard_ms: int = 1_000
    boss_health_multiple: int = 8
    boss_absolute_floor: int = 1_000_000
    bucket_ms: int = 10_000
    audit_window_ms: int = 15_000
    storage_bucket_ms: int = 10_000
    storage_part_events: int = 4_000
    retention_days: int | None = None
    close_wipe_percent: float = 15.0
    strict_reset: bool = False
    #: Lines of one log scanned by one task; bounds every per-log window.
    block_lines: int = 1 << 18

    @property
    def longest_silence_ms(self) -> int:
        return max(self.idle_ms, self.exit_grace_ms, self.boss_cleanup_ms)

    @property
    def shortest_silence_ms(self) -> int:
        return min(self.idle_ms, self.exit_grace_ms, self.boss_cleanup_ms)

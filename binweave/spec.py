"""What a series is: its key, time and value columns, bin width, local time zone and gap threshold."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeriesSpec:
    key: str = "route"
    ts: str = "ts"
    value: str = "value"
    width_s: int = 600
    zone: str = "Asia/Singapore"
    offset_s: int = 28800
    gap_min: int = 25

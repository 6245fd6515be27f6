"""Running state per series: gaps, slew limits and carried values as a stream goes by, kept by transformWithState."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "route string, bin long, y double, gap_min long, after_gap long, limited double"


class SeriesState(StatefulProcessor):
    """Per series the last bin, its limited value, and the bin numbers of the last gaps; one row out for each closed bin in."""

    def __init__(self, cap: float = 10.0, gap_min: int = 25, rows: int = 6):
        self.cap, self.gap_min, self.rows = cap, gap_min, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "bin long, limited double, since long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last, limited, since = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for r in sorted((x for b in rows for x in b[["bin", "y"]].itertuples(index=False)), key=lambda x: x.bin):
            gap = None if last is None else (int(r.bin) - last) * 10
            if gap is not None and gap <= 0:
                continue  # a closed bin isn't revised
            if gap is not None and gap > self.gap_min:
                since = 0
            elif since is not None:
                since += 1
            after = int(since is not None and since <= self.rows)
            y = float(r.y)
            limited = y if limited is None else limited + max(-self.cap, min(self.cap, y - limited))
            last = int(r.bin)
            out.append((key[0], last, y, gap, after, limited))
        if last is not None:
            self.state.update((last, limited, since))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        frame["gap_min"] = frame["gap_min"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def with_running_state(bins: DataFrame, cap: float = 10.0, gap_min: int = 25, rows: int = 6) -> DataFrame:
    """A stream of closed bins (route, bin, y) with their gap, after_gap and slew-limited value. The state store must be RocksDB."""
    return bins.groupBy("route").transformWithStateInPandas(SeriesState(cap, gap_min, rows), OUTPUT, "Append", "None")

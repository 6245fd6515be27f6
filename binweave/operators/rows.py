"""Row sets: validity rules, derived columns, cut-offs, protected windows, training rows and read windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bins import not_carried, valid


def strict_route(df: DataFrame, route: str, required: tuple[str, ...] = ("route", "ts", "value", "status", "error_message")) -> DataFrame:
    """Valid rows of one route without any error message, which leaves carried rows out as well; an error if a column is missing."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return valid(df, "status").filter((F.col("route") == route) & F.col("error_message").isNull())


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, null where either is null or zero."""
    return F.round(F.nullif(a, F.lit(0)) / F.nullif(b, F.lit(0)), digits)


def speed_kmh(metres: Column, secs: Column) -> Column:
    return F.round(F.nullif(metres, F.lit(0)) / F.nullif(secs, F.lit(0)) * 3.6, 2)


def wall_clock_bin(local: Column, zone: str = "Asia/Singapore", minutes: int = 10) -> Column:
    """Start, in epoch seconds, of the bin of a wall-clock time: cut to the minute, less the minute's remainder, read in the zone."""
    minute = F.date_trunc("MINUTE", local)
    floored = minute - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(minute) % minutes, F.lit(0))
    return F.unix_seconds(F.to_utc_timestamp(floored, zone))


def cut_off(df: DataFrame, instant: Column, ts: str = "ts", local_zone: str | None = None) -> DataFrame:
    """Rows up to an instant; the rows' times may be wall-clock times of a zone."""
    t = F.to_utc_timestamp(ts, local_zone) if local_zone else F.col(ts)
    return df.filter(t <= instant)


def window_end(cutoff_s: int, explicit_s: int | None = None, label_s: int = 2400, width_s: int = 600) -> int:
    """The last origin whose label a cut-off still lets one see, at a bin's start; an explicit end may not lie beyond it."""
    end = (cutoff_s - label_s) // width_s * width_s
    if explicit_s is not None and explicit_s > end:
        raise ValueError(f"window ends at {explicit_s}, but the cut-off allows {end}")
    return end if explicit_s is None else explicit_s


def check_protected(start_s: int, end_s: int, protected: tuple[int, int]) -> None:
    """An error if a window overlaps the protected one."""
    if start_s < protected[1] and protected[0] < end_s:
        raise ValueError(f"window {start_s} to {end_s} overlaps the protected {protected[0]} to {protected[1]}")


def masked_labels(rows: DataFrame, label: str, ahead: int, protected: tuple[int, int], width_s: int = 600) -> DataFrame:
    """Labels whose target lies in the protected window become null."""
    target = (F.col("bin") + ahead) * width_s
    return rows.withColumn(label, F.when(~target.between(protected[0], protected[1] - 1), F.col(label)))


def training_rows(rows: DataFrame, known_by_s: int | None = None, without_days: tuple[int, ...] = (), need: tuple[str, ...] = ("y_30", "lag_60"), label_s: int = 2400) -> DataFrame:
    """Rows after no gap that have all that a model needs; with known_by_s only those whose label was known by then; some days left out."""
    out = rows.filter(F.col("after_gap") == 0)
    for c in need:
        out = out.filter(F.col(c).isNotNull())
    if known_by_s is not None:
        out = out.filter(F.col("bin") * 600 + label_s <= known_by_s)
    return out.filter(~F.col("local_day").isin(*without_days)) if without_days else out


def five_minute_calendar(bins: DataFrame, holidays: tuple[int, ...] = (), width_s: int = 300, offset_s: int = 28800) -> DataFrame:
    """hour, minute, Monday = 0 day of week, day, month and nonworkday of a bin in local time."""
    t = F.timestamp_seconds(F.col("bin") * width_s + offset_s)
    local_day = F.floor((F.col("bin") * width_s + offset_s) / 86400)
    dow = F.weekday(t)
    return bins.withColumns({
        "hour": F.hour(t), "minute": F.minute(t), "dayofweek": dow, "day": F.dayofmonth(t), "month": F.month(t),
        "nonworkday": ((dow >= 5) | (local_day.isin(*holidays) if holidays else F.lit(False))).cast("int"),
    })


def display_level(minutes: Column) -> Column:
    """low under 30 minutes, medium to 50, else high, by the rounded value."""
    m = F.floor(minutes + 0.5)
    return F.when(m < 30, "low").when(m <= 50, "medium").otherwise("high")


HORIZONS = (30, 60)


def parsed_requests(df: DataFrame, query: str, body: str, directions: tuple[str, ...]) -> DataFrame:
    """horizon, direction, confidence and problem of requests whose parameters stand in a body (JSON text) or, failing that, in a query string.

    A horizon is digits only and one of HORIZONS (30 where absent); a direction one of a list (null: all); a confidence a number from 0 to 1 (0.25 where absent).
    """
    own = F.str_to_map(F.coalesce(query, F.lit("")), F.lit("&"), F.lit("="))
    given = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}"), F.nullif(F.try_element_at(own, F.lit(k)), F.lit("")))
    h, d, c = given("horizon"), given("direction"), given("confidence")
    horizon = F.when(h.isNull(), 30).when(h.rlike("^[0-9]+$"), h.try_cast("int"))
    confidence = F.when(c.isNull(), 0.25).otherwise(c.try_cast("double"))
    problem = (
        F.when(horizon.isNull() | ~horizon.isin(*HORIZONS), "horizon")
        .when(d.isNotNull() & ~d.isin(*directions), "direction")
        .when(confidence.isNull() | ~confidence.between(0.0, 1.0), "confidence")
    )
    return df.withColumns({"horizon": horizon, "direction": d, "confidence": confidence, "problem": problem})


def closed_window(bins: DataFrame, keys: list[str], now_s: int, span_s: int = 10800, grace_s: int = 60, width_s: int = 600, key: str = "route") -> DataFrame:
    """The closed bins of the last span of some series."""
    start = F.col("bin") * width_s
    return bins.filter(F.col(key).isin(*keys) & (start >= now_s - span_s) & (start + width_s + grace_s <= now_s))


def in_range(bins: DataFrame, keys: list[str], first_s: int, end_s: int, width_s: int = 600, key: str = "route") -> DataFrame:
    """Bins of some series that start from first_s on and before end_s."""
    return bins.filter(F.col(key).isin(*keys) & (F.col("bin") * width_s >= first_s) & (F.col("bin") * width_s < end_s))


def read_window(first_s: int, last_s: int, ahead_s: int = 1800, look_back_s: int | None = None, history_s: int | None = None, week_s: int = 7 * 86400, width_s: int = 600) -> tuple[int, int]:
    """What to read for origins from first_s to last_s: a week of features before, from the history's start or a look-back at most; labels after."""
    start = first_s if look_back_s is None else last_s - look_back_s
    if history_s is not None:
        start = max(start, history_s)
    return start - week_s, last_s + ahead_s + width_s


def on_grid(df: DataFrame, keys: list[str], ts: str = "t", value: str = "value", width_s: int = 600, key: str = "route") -> DataFrame:
    """Rows of known series with a positive value at a multiple of the width: (key, bin, y)."""
    return df.filter(F.col(key).isin(*keys) & (F.col(value) > 0) & (F.col(ts) % width_s == 0)).select(key, (F.col(ts) / width_s).cast("long").alias("bin"), F.col(value).alias("y"))


def per_direction(observations: DataFrame, ordinal: dict[str, int], level: str = "level") -> DataFrame:
    """Each observation (a, b counts, level) as two rows: a direction's own count, the other's, and the level's ordinal."""
    code = F.coalesce(*(F.when(F.col(level) == k, F.lit(v)) for k, v in ordinal.items()))
    row = lambda name, own, other: F.struct(F.lit(name).alias("direction"), F.col(own).alias("own"), F.col(other).alias("other"), code.alias("ordinal"))
    rest = [c for c in observations.columns if c not in ("a", "b")]
    return observations.select(*rest, F.explode(F.array(row("A", "a", "b"), row("B", "b", "a"))).alias("_r")).select(*rest, "_r.*")


def sampling_plan(days: DataFrame, day: str = "local_day", peaks: tuple[tuple[int, int], ...] = ((360, 660), (960, 1320)), step: int = 10, off_step: int = 20) -> DataFrame:
    """Per day the minutes to sample, in order: every step within the peaks first, then every off_step outside."""
    minute = F.col("minute")
    peak = F.lit(False)
    for a, b in peaks:
        peak = peak | ((minute >= a) & (minute < b))
    rows = days.select(day, F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(step))).alias("minute")).withColumn("is_peak", peak)
    kept = rows.filter(F.col("is_peak") | (minute % off_step == 0))
    from pyspark.sql import Window

    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(day).orderBy(F.desc("is_peak"), "minute")))


def day_window(start: str | None, end: str | None, today: str, back: int = 7) -> tuple[str, str]:
    """The dates to fetch: given ones, or the last `back` days up to yesterday; none may lie in the future or be upside down."""
    from datetime import date, timedelta

    now = date.fromisoformat(today)
    last = date.fromisoformat(end) if end else now - timedelta(days=1)
    first = date.fromisoformat(start) if start else last - timedelta(days=back - 1)
    if last > now or first > last:
        raise ValueError(f"no window from {first} to {last} on {now}")
    return first.isoformat(), last.isoformat()


def required_out_of_sample(trained_s: int, window_start_s: int) -> None:
    """An error if a model was trained at or after the start of the window it is tested on."""
    if trained_s >= window_start_s:
        raise ValueError(f"model trained at {trained_s}, window starts at {window_start_s}")

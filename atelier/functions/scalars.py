"""Scalar functions: canonical JSON fingerprints, names, times, thresholds ladders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys and no blanks; null for what is no JSON or holds NaN or an infinity."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """canonical() of a column, in Arrow batches: number formats are Python's, which no built-in reproduces."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(canonical)

    return run(text)


def fingerprint(canonical_text: Column) -> Column:
    """First 20 hex digits of the sha256."""
    return F.substring(F.sha2(canonical_text.cast("binary"), 256), 1, 20)


def finite_number(v: Column) -> Column:
    """A number in text as a finite double, else null; `true` and `false` are not numbers."""
    x = v.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def is_uuid(v: Column) -> Column:
    return F.coalesce(v.rlike(UUID), F.lit(False))


def offset_time(v: Column) -> Column:
    """An ISO time that states its offset, as a timestamp; null without one."""
    return F.when(v.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(v))


def shown_time(t: Column, hours: int = 3, zone: str = "МСК", unknown: str = "не указана") -> Column:
    """An instant as `dd.mm.yyyy hh:mm zone` in a zone of fixed offset, whatever the session's; a text for a missing one."""
    local = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(F.unix_micros(t) / 1_000_000) + hours * 3600)).cast("string")
    return F.coalesce(F.concat(F.regexp_replace(local, r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}:\d{2}).*$", "$3.$2.$1 $4"), F.lit(f" {zone}")), F.lit(unknown))


def connector_number(name: Column) -> Column:
    """c12 -> 12, anything else 0."""
    return F.coalesce(F.regexp_extract(name, r"^c(-?\d+)$", 1).try_cast("int"), F.lit(0))


def door_width(width: Column, source_class: Column, radius: Column, length: Column, confirmed: Column) -> Column:
    """Leaf width of a recognised width: scaled by the swing's radius over the opening's length where a swing was measured (never up);
    as it is for outlined, surveyed and confirmed interior openings; else 1.12 times it, 40 at least."""
    as_is = source_class.isin("outlined_wall_frame", "surveyed_door") | ((source_class == "unmarked_interior_gap") & F.coalesce(confirmed, F.lit(False)))
    return F.when(source_class == "measured_swing", width * F.least(F.lit(1.0), radius / length)).when(F.coalesce(as_is, F.lit(False)), width).otherwise(F.greatest(F.lit(40.0), width * 1.12))


def fit_opening(width: Column, position: Column, length: Column, thickness: Column, minimum: Column, left: float = -0.5, right: float = 0.5) -> Column:
    """Struct (width, position) of an opening that a small overrun moves and shrinks into its wall, else null.

    position is in percent of the wall's length; left and right are the hole's limits per unit of width. Null if it fits already, would be under
    `minimum` or three quarters of its width, or would move by over half the thickness.
    """
    center = length * position / 100
    fits = (center + left * width >= 0) & (center + right * width <= length)
    fitted = F.least(width, length / (right - left))
    to = F.least(F.greatest(center, -left * fitted), length - right * fitted)
    ok = F.lit(left < 0 < right) & (length > 0) & ~fits & (fitted >= F.greatest(minimum, 0.75 * width)) & (F.abs(to - center) <= thickness / 2)
    return F.when(ok, F.struct(fitted.alias("width"), (100 * to / length).alias("position")))


def failed_stage(log: Column) -> Column:
    """The last stage that a log names as failed, empty if none."""
    return F.regexp_extract(log, r"(?s).*stage (\w+) failed", 1)


def color_of(cls: Column) -> Column:
    """Display colour of a class id; fixed values of the plan classes."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in ((0, "000000"), (1, "ffffff"), (2, "ff0000"), (3, "0000ff")) for x in kv)), cls)

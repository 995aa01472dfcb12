"""Column expressions over usage rows: times, groups, derived measures, costs."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_MODEL, UNKNOWN_TIME

PATTERNS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "minute": "yyyy-MM-dd HH:mm"}


def local_time(ms: Column, timezone: str, form: str) -> Column:
    """Epoch milliseconds as calendar text in a zone, by that zone's daylight saving rules (session zone: UTC)."""
    at = F.from_utc_timestamp(F.timestamp_millis(ms), timezone)
    return F.coalesce(F.date_format(at, PATTERNS[form]), F.lit(UNKNOWN_TIME))


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def in_range(ms: Column, from_ms: int | None, to_ms: int | None) -> Column:
    """Half-open; rows without a time pass only if the range is open at both ends."""
    if from_ms is None and to_ms is None:
        return F.lit(True)
    out = ms.isNotNull()
    if from_ms is not None:
        out = out & (ms >= F.lit(from_ms).cast("long"))
    if to_ms is not None:
        out = out & (ms < F.lit(to_ms).cast("long"))
    return out


def under(path: Column, roots: list[str], separator: str = "/") -> Column:
    """Path is one of the roots or lies below one; no roots, no paths."""
    out = F.lit(False)
    for root in roots:
        root = root.rstrip(separator)
        out = out | (path == root) | path.startswith(root + separator)
    return out


def known_model(model: Column) -> Column:
    return F.coalesce(~model.isin("", UNKNOWN_MODEL), F.lit(False))


def contains_folded(key: Column, needle: str) -> Column:
    return F.lower(key).contains(needle.strip().lower())


def uncached(inputs: Column, cached: Column, write: Column) -> Column:
    return F.greatest(F.lit(0), inputs - cached - write)


def hit_ratio(cached: Column, inputs: Column) -> Column:
    return F.when(inputs > 0, cached / inputs).otherwise(F.lit(0.0))


def model_key(model: Column) -> Column:
    return F.lower(F.trim(model))


def request_cost(price: Column) -> Column:
    """USD of a request at the rates in struct ``price`` (per million tokens).

    Cached tokens count up to the input, written ones up to what is left; a missing cached or write rate is the input
    rate; long rates hold for the whole request if the input is above the threshold.
    """
    positive = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    inputs = positive("input_tokens")
    cached = F.least(positive("cached_input_tokens"), inputs)
    written = F.least(positive("cache_write_input_tokens"), inputs - cached)
    long = F.coalesce(price["long_input"].isNotNull() & (inputs > price["threshold"]), F.lit(False))
    rate = lambda name: F.when(long, F.coalesce(price[f"long_{name}"], price["long_input"])).otherwise(F.coalesce(price[name], price["input"]))
    return ((inputs - cached - written) * rate("input") + cached * rate("cached") + written * rate("write") + positive("output_tokens") * rate("output")) / F.lit(1e6)


def nice_ceiling(value: Column) -> Column:
    """The least of 1, 2, 5 times a power of ten that is at least ``value`` (1 for none)."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    step = value / power
    return F.when(F.coalesce(value, F.lit(0)) <= 0, F.lit(1.0)).otherwise(power * F.when(step <= 1, 1).when(step <= 2, 2).when(step <= 5, 5).otherwise(10))


def register(spark: SparkSession) -> None:
    """Make ``date_key(ms, 'day' or 'month', zone)`` and ``date_time(ms, zone)`` callable from the session's SQL."""
    at = "from_utc_timestamp(timestamp_millis(ms), zone)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION date_key(ms BIGINT, form STRING, zone STRING) RETURNS STRING RETURN coalesce(CASE form WHEN 'day' THEN date_format({at}, '{PATTERNS['day']}') WHEN 'month' THEN date_format({at}, '{PATTERNS['month']}') END, '{UNKNOWN_TIME}')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION date_time(ms BIGINT, zone STRING) RETURNS STRING RETURN coalesce(date_format({at}, '{PATTERNS['minute']}'), '{UNKNOWN_TIME}')")

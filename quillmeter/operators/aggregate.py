"""Aggregates over priced requests: totals, groups, model rollups, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.usage import hit_ratio, iso_time, known_model, local_time, uncached
from ..options import SORTS, UsageQuery
from ..schemas import COSTS, COUNTERS, UNKNOWN_MODEL

MODEL_LIST = 100


def measures() -> list[Column]:
    zero = F.lit(0)
    return [
        F.count_distinct("session_id").alias("sessions"),
        F.count("*").alias("requests"),
        *(F.coalesce(F.sum(c), zero).alias(c) for c in COUNTERS),
        *(F.coalesce(F.sum(c), zero).alias(c) for c in COSTS),
    ]


def derived(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "uncached_input_tokens": uncached(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("cache_write_input_tokens")),
            "cache_hit_ratio": hit_ratio(F.col("cached_input_tokens"), F.col("input_tokens")),
        }
    )


def totals(priced: DataFrame) -> DataFrame:
    return derived(priced.agg(*measures()))


def group_key(query: UsageQuery) -> Column:
    if query.by_date:
        return local_time(F.col("timestamp_ms"), query.timezone, query.group)
    if query.group == "session":
        return F.col("session_id")
    return F.coalesce({"model": F.col("model"), "cwd": F.col("cwd")}[query.group], F.lit(UNKNOWN_MODEL))


def grouped(priced: DataFrame, query: UsageQuery) -> DataFrame:
    """A row per key. Sessions show their start and id; group ``none`` has no rows."""
    if query.group == "none":
        return derived(priced.limit(0).groupBy(F.lit("").alias("key")).agg(*measures()))
    rows = priced.groupBy(group_key(query).alias("key")).agg(*measures(), F.min(F.coalesce("session_created_at_ms", "timestamp_ms")).alias("__start"))
    if query.group == "session":
        rows = rows.withColumn("key", F.concat(local_time(F.col("__start"), query.timezone, "minute"), F.lit(" "), F.col("key")))
    return derived(rows.drop("__start"))


def ordered(rows: DataFrame, query: UsageQuery) -> DataFrame:
    """Sort and cut; the direction holds for the tie-break by key too, and keys sort by the Unicode collation."""
    column, key = SORTS[query.sort_name], F.collate(F.col("key"), "UNICODE")
    by = [key] if column == "key" else [F.col(column), key]
    rows = rows.orderBy(*((c.desc() if query.descending else c.asc()) for c in by))
    return rows.limit(query.limit) if query.limit else rows


def _by_model() -> list:
    return [F.desc("total_tokens"), F.desc("requests"), F.asc("model")]


def unpriced_models(priced: DataFrame, most: int | None = MODEL_LIST) -> DataFrame:
    rows = priced.where("unpriced_requests > 0").groupBy(F.coalesce("model", F.lit(UNKNOWN_MODEL)).alias("model"))
    rows = rows.agg(F.count("*").alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")), iso_time(F.min("timestamp_ms")).alias("first_seen"), iso_time(F.max("timestamp_ms")).alias("last_seen"))
    rows = rows.orderBy(*_by_model())
    return rows if most is None else rows.limit(most)


def assumed_models(priced: DataFrame, most: int | None = MODEL_LIST) -> DataFrame:
    """A row per assumed model with its routes in order of start; the last one is the current one."""
    sums = ("requests", "input_tokens", "output_tokens", "total_tokens", "assumed_cost_usd", "assumed_upper_bound_cost_usd")
    base = priced.where("assumed_requests > 0").withColumn("requests", F.lit(1).cast("long"))
    routes = base.groupBy("model", "route").agg(*(F.sum(c).alias(c) for c in sums), F.min("timestamp_ms").alias("first"), F.max("timestamp_ms").alias("last"))
    each = F.struct(F.coalesce("route.effective_from", F.lit("")).alias("sort_key"), "route.*", *sums, iso_time(F.col("first")).alias("first_seen"), iso_time(F.col("last")).alias("last_seen"))
    rows = routes.groupBy("model").agg(F.sort_array(F.collect_list(each)).alias("routes"), *(F.sum(c).alias(c) for c in sums), iso_time(F.min("first")).alias("first_seen"), iso_time(F.max("last")).alias("last_seen"))
    now = F.element_at("routes", -1)
    rows = rows.select("model", now["assumed_model"].alias("assumed_model"), now["upper_bound_model"].alias("upper_bound_model"), now["label"].alias("label"), now["source_url"].alias("source_url"), *sums, "first_seen", "last_seen", F.transform("routes", lambda r: r.dropFields("sort_key")).alias("routes")).orderBy(*_by_model())
    return rows if most is None else rows.limit(most)


def unknown_times(events: DataFrame, bounded: bool) -> DataFrame:
    """One row: events and tokens without a time, and how many of these a bounded range leaves out."""
    rows = events.where(F.col("timestamp_ms").isNull()).agg(F.count("*").alias("events"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
    out = F.lit(1 if bounded else 0)
    return rows.select("events", "tokens", (F.col("events") * out).alias("excluded_events"), (F.col("tokens") * out).alias("excluded_tokens"))


def composition(total: DataFrame) -> DataFrame:
    """``part, tokens, share``: where the tokens of a totals row went."""
    parts = {
        "uncached input": uncached(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("cache_write_input_tokens")),
        "cached input": F.col("cached_input_tokens"),
        "cache write": F.col("cache_write_input_tokens"),
        "visible output": F.greatest(F.lit(0), F.col("output_tokens") - F.col("reasoning_output_tokens")),
        "reasoning": F.col("reasoning_output_tokens"),
    }
    rows = total.select(F.inline(F.array(*(F.struct(F.lit(n).alias("part"), c.cast("long").alias("tokens")) for n, c in parts.items()))), sum(parts.values(), F.lit(0)).alias("all"))
    return rows.select("part", "tokens", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0).alias("share"))


def models_in(events: DataFrame) -> DataFrame:
    return events.where(known_model(F.col("model"))).select("model").distinct().orderBy("model")


def file_stats(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("events_count") > 0).alias("files_with_usage"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("duplicate_token_events", "parse_errors", "raw_token_events", "events_count")),
    )


def top_series(rows: DataFrame, metric: str, most: int = 18, by_date: bool = False) -> DataFrame:
    """The largest keys for a chart; dates in order of time."""
    top = rows.orderBy(F.desc(metric), F.desc("key")).limit(most)
    return top.orderBy("key") if by_date else top


# --- distinct sessions that can be added up -----------------------------------------------------------------------


def session_numbers(events: DataFrame, folder: str) -> DataFrame:
    """A written dictionary ``session_id, session_no``. Numbers are dense within a part of the table, so they fill few bitmaps."""
    numbered = events.select("session_id").distinct().withColumn("session_no", F.monotonically_increasing_id())
    numbered.write.parquet(folder)
    return events.sparkSession.read.schema(numbered.schema).parquet(folder)


def session_slices(events: DataFrame, numbers: DataFrame, *keys: str) -> DataFrame:
    """``keys, bucket, sessions, requests``: the sessions of each key as bitmaps of 4 KiB at most. Slices of several keys, days or
    runs merge to exact counts (``merged_sessions``), where counts of sessions would not add up.
    """
    rows = events.join(numbers, "session_id")
    bucket, place = F.bitmap_bucket_number("session_no"), F.bitmap_bit_position("session_no")
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("sessions"), F.count("*").alias("requests"))


def merged_sessions(slices: DataFrame, *keys: str) -> DataFrame:
    """``keys, sessions, requests`` over all slices of a key."""
    merged = slices.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("sessions").alias("sessions"), F.sum("requests").alias("requests"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("sessions")).alias("sessions"), F.sum("requests").alias("requests"))

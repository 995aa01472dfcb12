"""Global dedupe: one representative of every usage fingerprint, chosen before any time filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_order() -> list:
    """Events with a time of their own first, then the earliest, then file path (binary) and place in the file."""
    return [F.desc("has_event_timestamp"), F.asc_nulls_last("timestamp_ms"), F.asc("file_path"), F.asc("event_index")]


def canonical(events: DataFrame, dedupe: str = "global") -> DataFrame:
    if dedupe == "file":  # files were deduplicated while parsing
        return events
    best = Window.partitionBy("total_usage_key").orderBy(*rank_order())
    return events.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def duplicates(events: DataFrame) -> DataFrame:
    """One row: indexed events, canonical events, and the copies between."""
    n, kept = F.count("*"), F.count_distinct("total_usage_key")
    return events.agg(n.alias("indexed"), kept.alias("canonical"), (n - kept).alias("global_duplicates"))


def repair(canonical_rows: DataFrame, events: DataFrame, changed_keys: DataFrame) -> DataFrame:
    """Choose anew for the keys that changed only: drop their representatives, rank their rows, keep the rest."""
    keys = changed_keys.select("total_usage_key").distinct()
    kept = canonical_rows.join(keys, "total_usage_key", "left_anti")
    return kept.unionByName(canonical(events.join(keys, "total_usage_key", "left_semi")).select(*canonical_rows.columns))


def changed_keys(old_rows: DataFrame, staged_rows: DataFrame) -> DataFrame:
    return old_rows.select("total_usage_key").union(staged_rows.select("total_usage_key")).distinct()

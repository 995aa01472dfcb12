"""Fixed schemas of the usage engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: Counters of a usage vector; cached, cache-write and reasoning tokens are parts of others.
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
#: Additive cost fields of a request.
AMOUNTS = ("estimated_cost_usd", "assumed_cost_usd", "assumed_upper_bound_cost_usd", "reference_total_cost_usd", "reference_total_upper_bound_cost_usd")
COUNTS = ("priced_requests", "assumed_requests", "unpriced_requests", "priced_total_tokens", "assumed_total_tokens", "unpriced_total_tokens", "provisional_priced_requests", "provisional_priced_total_tokens")
COSTS = (*AMOUNTS, *COUNTS, "provisional_estimated_cost_usd")

UNKNOWN_CWD, UNKNOWN_MODEL, UNKNOWN_TIME = "(unknown cwd)", "(unknown model)", "(unknown time)"

USAGE_EVENTS = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("event_index", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("has_event_timestamp", T.BooleanType()),
        T.StructField("session_created_at_ms", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("total_usage_key", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("model", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
    ]
)

FILES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("events_count", T.LongType()),
        T.StructField("duplicate_token_events", T.LongType()),
        T.StructField("parse_errors", T.LongType()),
        T.StructField("raw_token_events", T.LongType()),
    ]
)

_RATES = [T.StructField(f"{p}{r}", T.DoubleType()) for p in ("", "long_") for r in ("input", "cached", "write", "output")]
_SIDE = [*_RATES, T.StructField("threshold", T.LongType())]

#: One row per model and time span: what a request of that span costs.
PRICE_SPANS = T.StructType(
    [
        T.StructField("model_key", T.StringType(), False),
        T.StructField("valid_from", T.LongType()),
        T.StructField("valid_to", T.LongType()),
        T.StructField("official", T.BooleanType(), False),
        T.StructField("provisional", T.BooleanType(), False),
        T.StructField("version_id", T.StringType()),
        T.StructField("price", T.StructType(_SIDE)),
        T.StructField("upper", T.StructType(_SIDE)),
        T.StructField(
            "route",
            T.StructType([T.StructField(c, T.StringType()) for c in ("id", "effective_from", "assumed_model", "upper_bound_model", "label", "source_url", "evidence_level")]),
        ),
    ]
)

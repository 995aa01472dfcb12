"""Queries over the driver's tables: every relational operator of the engine, with DuckDB SQL beside it.

The tables hold no token logs, so ``events`` is read as usage: users are sessions, event types are models, ``value`` gives
token counts. Some times are missing, and a third of the users also occur as later copies in a second file.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.usage import contains_folded, in_range, iso_time, local_time, nice_ceiling, register, under
from .operators import aggregate as A
from .operators.canonical import canonical, changed_keys, duplicates, repair
from .options import ROLLING, UsageQuery, rolling, start_of_day
from .plans.usage import scan
from .pricing.pages import page_versions
from .pricing.catalog import Catalog, Route, Version, to_ms
from .pricing.spans import price_spans, priced
from .schemas import COSTS, COUNTERS
from .sources.logs import list_logs, scratch_folder, write_logs
from .sources.parse import records, settled, usage_events
from .sources.ranges import file_state
from .streaming.incremental import UsageIndex


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_catalog() -> Catalog:
    """Prices that change within January 2024, of every kind the engine tells apart."""
    v = lambda id_, start, provisional, *rates, **more: Version(id_, to_ms(start), provisional, rates[0], rates[3], rates[1], rates[2], **more)
    return Catalog(
        models={
            "click": [v("click-base", None, True, 2.0, 0.5, None, 8.0), v("click-10", "2024-01-10", False, 3.0, 0.25, 3.75, 12.0), v("click-20", "2024-01-20", False, 1.0, 0.125, 1.25, 4.0, long=(2.0, 0.25, None, 6.0), threshold=50_000)],
            "view": [v("view-05", "2024-01-05", False, 5.0, None, None, 20.0, long=(10.0, None, None, 30.0), threshold=20_000)],
            "purchase-v2": [v("purchase-base", None, True, 4.0, 1.0, 5.0, 16.0)],
        },
        aliases={"purchase": "purchase-v2"},
        routes={"signup": [Route("signup-a", to_ms("2024-01-08"), "click", "view", "first route"), Route("signup-b", to_ms("2024-01-15"), "purchase-v2", "view", "second route")]},
    )


# The same prices as SQL, written out by hand; lookups are as-of joins in SQL, so nothing of the code under test is in it.
_BASE = "-9007199254740991"
_DAY = "epoch_ms(TIMESTAMP '2024-01-{}')"
_RATES = ("i", "c", "w", "o", "li", "lc", "lw", "lo")
_PRICES = f"""pv AS (SELECT m, start, provisional, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _RATES)}, t FROM (VALUES
  ('click', {_BASE}, true, 2.0, 0.5, NULL, 8.0, NULL, NULL, NULL, NULL, NULL),
  ('click', {_DAY.format(10)}, false, 3.0, 0.25, 3.75, 12.0, NULL, NULL, NULL, NULL, NULL),
  ('click', {_DAY.format(20)}, false, 1.0, 0.125, 1.25, 4.0, 2.0, 0.25, NULL, 6.0, 50000),
  ('view', {_DAY.format('05')}, false, 5.0, NULL, NULL, 20.0, 10.0, NULL, NULL, 30.0, 20000),
  ('purchase-v2', {_BASE}, true, 4.0, 1.0, 5.0, 16.0, NULL, NULL, NULL, NULL, NULL)) v(m, start, provisional, i, c, w, o, li, lc, lw, lo, t)),
al AS (SELECT * FROM (VALUES ('purchase', 'purchase-v2')) v(alias, m)),
rt AS (SELECT * FROM (VALUES ('signup', 'signup-a', {_DAY.format('08')}, 'click', 'view'), ('signup', 'signup-b', {_DAY.format(15)}, 'purchase-v2', 'view')) v(m, id, start, low_m, high_m))"""


def _asof(source: str) -> str:
    """CTEs that look up the prices of CTE ``source`` (model, timestamp_ms) into ``j``: official, route, and the rates of the
    price (p_) and of the upper bound (u_).
    """
    names = (*_RATES, "t")
    rates = [f"CASE WHEN official THEN of_{n} WHEN NOT official THEN {side}_{n} END AS {p}_{n}" for p, side in (("p", "lo"), ("u", "hi")) for n in names]
    picks = lambda side: ", ".join(f"v.{n} AS {side}_{n}" for n in names)
    return f"""{_PRICES},
n1 AS (SELECT e.*, coalesce(al.m, lower(trim(e.model))) AS named FROM {source} e LEFT JOIN al ON al.alias = lower(trim(e.model))),
n2 AS (SELECT n1.*, v.m AS of_m, v.provisional AS of_provisional, {picks('of')} FROM n1 ASOF LEFT JOIN pv v ON n1.named = v.m AND n1.timestamp_ms >= v.start),
n3 AS (SELECT n2.*, r.id AS route_id, r.start AS route_start, r.low_m AS assumed_model, r.high_m AS upper_bound_model FROM n2 ASOF LEFT JOIN rt r ON lower(trim(n2.model)) = r.m AND n2.timestamp_ms >= r.start),
n4 AS (SELECT n3.*, v.m AS lo_m, {picks('lo')} FROM n3 ASOF LEFT JOIN pv v ON n3.assumed_model = v.m AND n3.timestamp_ms >= v.start),
n5 AS (SELECT n4.*, v.m AS hi_m, {picks('hi')} FROM n4 ASOF LEFT JOIN pv v ON n4.upper_bound_model = v.m AND n4.timestamp_ms >= v.start),
n6 AS (SELECT *, CASE WHEN of_m IS NOT NULL THEN true WHEN lo_m IS NOT NULL AND hi_m IS NOT NULL THEN false END AS official, of_m IS NOT NULL AND of_provisional AS provisional FROM n5),
j AS (SELECT *, {', '.join(rates)} FROM n6)"""


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as usage events, one file per user."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", k.alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.floor(F.col("value") * 1000).cast("long").alias("i"), F.floor(F.col("value") * 100).cast("long").alias("o"))
    cached, write = F.expr("i * k div 200"), F.expr("i * k div 400")
    return rows.select(
        F.concat(F.lit("/logs/a/u"), F.col("user_id")).alias("file_path"),
        F.col("event_id").alias("event_index"),
        F.when(F.col("event_id") % 97 != 0, F.col("ms")).alias("timestamp_ms"),
        (F.col("event_id") % 97 != 0).alias("has_event_timestamp"),
        F.lit(None).cast("long").alias("session_created_at_ms"),
        F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("k"), F.col("event_id")).alias("total_usage_key"),
        F.concat(F.lit("/p"), F.col("k") % 10).alias("cwd"),
        F.col("event_type").alias("model"),
        F.col("i").alias("input_tokens"),
        cached.alias("cached_input_tokens"),
        write.alias("cache_write_input_tokens"),
        F.col("o").alias("output_tokens"),
        F.expr("o div 4").alias("reasoning_output_tokens"),
        (F.col("i") + F.col("o")).alias("total_tokens"),
    )


def with_copies(events: DataFrame) -> DataFrame:
    """Plus later copies of a third of the users' events, in a file of an earlier name."""
    copied = events.where(F.substring("session_id", 2, 20).cast("long") % 3 == 0)
    copied = copied.withColumns({"file_path": F.concat(F.lit("/logs/0/"), F.col("session_id")), "timestamp_ms": F.col("timestamp_ms") + 1000})
    return events.unionByName(copied)


_U = """u AS (SELECT '/logs/a/u' || user_id AS file_path, event_id AS event_index,
  CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) // 1000 END AS timestamp_ms, event_id % 97 <> 0 AS has_event_timestamp,
  'u' || user_id AS session_id, 'k' || event_id AS total_usage_key, '/p' || (k % 10) AS cwd, event_type AS model,
  i AS input_tokens, i * k // 200 AS cached_input_tokens, i * k // 400 AS cache_write_input_tokens, o AS output_tokens, o // 4 AS reasoning_output_tokens, i + o AS total_tokens, user_id
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(floor(value * 1000) AS BIGINT) AS i, CAST(floor(value * 100) AS BIGINT) AS o FROM events))"""
_C = "c AS (SELECT * FROM u UNION ALL SELECT * REPLACE ('/logs/0/' || session_id AS file_path, timestamp_ms + 1000 AS timestamp_ms) FROM u WHERE user_id % 3 = 0)"
_RANK = "row_number() OVER (PARTITION BY total_usage_key ORDER BY has_event_timestamp DESC, timestamp_ms ASC NULLS LAST, file_path, event_index)"


def _rate(p: str, n: str) -> str:
    return f"CASE WHEN {p}_li IS NOT NULL AND a_in > {p}_t THEN coalesce({p}_l{n}, {p}_li) ELSE coalesce({p}_{n}, {p}_i) END"


def _cost(p: str) -> str:
    return f"((a_in - a_ca - a_wr) * ({_rate(p, 'i')}) + a_ca * ({_rate(p, 'c')}) + a_wr * ({_rate(p, 'w')}) + greatest(0, output_tokens) * ({_rate(p, 'o')})) / 1e6"


def _priced(source: str) -> str:
    """CTEs that price the rows of CTE ``source`` into ``q``."""
    return f"""{_asof(source)},
y AS (SELECT *, greatest(0, input_tokens) AS a_in, least(greatest(0, cached_input_tokens), greatest(0, input_tokens)) AS a_ca,
  least(greatest(0, cache_write_input_tokens), greatest(0, input_tokens) - least(greatest(0, cached_input_tokens), greatest(0, input_tokens))) AS a_wr FROM j),
x AS (SELECT *, {_cost('p')} AS low, {_cost('u')} AS high FROM y),
q AS (SELECT *, CASE WHEN official THEN low ELSE 0 END AS estimated_cost_usd, CASE WHEN NOT official THEN low ELSE 0 END AS assumed_cost_usd, CASE WHEN NOT official THEN high ELSE 0 END AS assumed_upper_bound_cost_usd,
  coalesce(low, 0) AS reference_total_cost_usd, CASE WHEN official THEN low ELSE coalesce(high, 0) END AS reference_total_upper_bound_cost_usd,
  CAST(coalesce(official, false) AS BIGINT) AS priced_requests, CAST(coalesce(NOT official, false) AS BIGINT) AS assumed_requests, CAST(official IS NULL AS BIGINT) AS unpriced_requests,
  CASE WHEN official THEN total_tokens ELSE 0 END AS priced_total_tokens, CASE WHEN NOT official THEN total_tokens ELSE 0 END AS assumed_total_tokens, CASE WHEN official IS NULL THEN total_tokens ELSE 0 END AS unpriced_total_tokens,
  CAST(coalesce(official AND provisional, false) AS BIGINT) AS provisional_priced_requests, CASE WHEN official AND provisional THEN total_tokens ELSE 0 END AS provisional_priced_total_tokens, CASE WHEN official AND provisional THEN low ELSE 0 END AS provisional_estimated_cost_usd FROM x)"""


_MONEY = {c for c in COSTS if c.endswith("usd")}


def _sums() -> str:
    out = ["count(DISTINCT session_id) AS sessions", "count(*) AS requests"]
    out += [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTERS]
    out += [f"round(coalesce(sum({c}), 0), 9) AS {c}" if c in _MONEY else f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COSTS]
    out += ["CAST(greatest(0, coalesce(sum(input_tokens) - sum(cached_input_tokens) - sum(cache_write_input_tokens), 0)) AS BIGINT) AS uncached_input_tokens"]
    out += ["round(CASE WHEN sum(input_tokens) > 0 THEN sum(cached_input_tokens) / CAST(sum(input_tokens) AS DOUBLE) ELSE 0 END, 9) AS cache_hit_ratio"]
    return ", ".join(out)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def _costed(spark: SparkSession, sf_dir: str, query: UsageQuery = UsageQuery()) -> DataFrame:
    kept = canonical(with_copies(adapted(spark, sf_dir)), query.dedupe)
    return priced(kept.where(in_range(F.col("timestamp_ms"), query.from_ms, query.to_ms)), spark, demo_catalog())


def _key_sql(group: str, zone: str) -> str:
    if group in ("day", "month"):
        form = "%Y-%m-%d" if group == "day" else "%Y-%m"
        return f"coalesce(strftime((make_timestamptz(timestamp_ms * 1000) AT TIME ZONE '{zone}'), '{form}'), '(unknown time)')"
    return {"model": "model", "cwd": "cwd"}[group]


def _canonical_sql(dedupe: str, from_ms: int | None = None, to_ms: int | None = None) -> str:
    rank = _RANK if dedupe == "global" else "1"
    span = " AND ".join([f"timestamp_ms >= {from_ms}"] * (from_ms is not None) + [f"timestamp_ms < {to_ms}"] * (to_ms is not None)) or "true"
    return f"WITH {_U}, {_C}, k AS (SELECT * FROM (SELECT *, {rank} AS rn FROM c) WHERE rn = 1 AND {span}), {_priced('k')}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _grouped(name: str, query: UsageQuery) -> None:
    head = _canonical_sql(query.dedupe, query.from_ms, query.to_ms)
    if query.group == "session":
        start = "coalesce(strftime((make_timestamptz(min(timestamp_ms) * 1000) AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M'), '(unknown time)')"
        sql = f"{head} SELECT {start} || ' ' || session_id AS key, {_sums()} FROM q GROUP BY session_id"
    else:
        sql = f"{head} SELECT {_key_sql(query.group, query.timezone)} AS key, {_sums()} FROM q GROUP BY 1"
    _add(name, lambda spark, d: _rounded(A.grouped(_costed(spark, d, query), query)), sql)


_FROM, _TO = to_ms("2024-01-08"), to_ms("2024-01-22")
_grouped("priced_by_model", UsageQuery(group="model"))
_grouped("by_day", UsageQuery(group="day"))
_grouped("by_month", UsageQuery(group="month"))
_grouped("by_cwd", UsageQuery(group="cwd"))
_grouped("by_session", UsageQuery(group="session"))
_grouped("by_day_los_angeles", UsageQuery(group="day", timezone="America/Los_Angeles"))
_grouped("by_month_kolkata", UsageQuery(group="month", timezone="Asia/Kolkata"))
_grouped("by_model_file_scope", UsageQuery(group="model", dedupe="file"))
_grouped("range_half_open", UsageQuery(group="model", from_ms=_FROM, to_ms=_TO))
_grouped("range_open_start", UsageQuery(group="day", to_ms=_FROM))
_add("totals", lambda s, d: _rounded(A.totals(_costed(s, d))), f"{_canonical_sql('global')} SELECT {_sums()} FROM q")
_add("group_none", lambda s, d: A.grouped(_costed(s, d), UsageQuery(group="none")), f"{_canonical_sql('global')} SELECT '' AS key, {_sums()} FROM q WHERE false GROUP BY 1")

_SHOWN = ["key", "sessions", "requests", "input_tokens", "total_tokens", "reference_total_cost_usd"]


def _top(query: UsageQuery) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _rounded(A.ordered(A.grouped(_costed(s, d, query), query), query).select(*_SHOWN))


def _top_sql(query: UsageQuery, column: str) -> str:
    way = "DESC" if query.descending else "ASC"
    return f"{_canonical_sql('global')}, g AS (SELECT {_key_sql(query.group, query.timezone)} AS key, {_sums()} FROM q GROUP BY 1) SELECT {', '.join(_SHOWN)} FROM g ORDER BY {column} {way}, key {way} LIMIT {query.limit}"


for _name, _query, _column in (
    ("top_cwd_by_cost", UsageQuery(group="cwd", sort="cost", limit=4), "reference_total_cost_usd"),
    ("top_cwd_by_requests", UsageQuery(group="cwd", sort="requests", desc=False, limit=3), "requests"),
    ("first_days", UsageQuery(group="day", limit=5), "key"),
    ("top_days_by_input", UsageQuery(group="day", sort="input", desc=True, limit=5), "input_tokens"),
):
    _add(_name, _top(_query), _top_sql(_query, _column))
_add("row_count_before_limit", lambda s, d: A.grouped(_costed(s, d), UsageQuery(group="cwd")).agg(F.count("*").alias("row_count")), f"{_canonical_sql('global')} SELECT count(DISTINCT cwd) AS row_count FROM q")

_MODEL = "count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_SEEN = "strftime(make_timestamp({f}(timestamp_ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS {n}"
_FIRST, _LAST = _SEEN.format(f="min", n="first_seen"), _SEEN.format(f="max", n="last_seen")
_add("unpriced_models", lambda s, d: A.unpriced_models(_costed(s, d)), f"{_canonical_sql('global')} SELECT model, {_MODEL}, {_FIRST}, {_LAST} FROM q WHERE unpriced_requests > 0 GROUP BY model ORDER BY total_tokens DESC, requests DESC, model LIMIT 100")
_add(
    "assumed_models",
    lambda s, d: _rounded(A.assumed_models(_costed(s, d)).select("model", "assumed_model", "upper_bound_model", "requests", "input_tokens", "output_tokens", "total_tokens", "assumed_cost_usd", "assumed_upper_bound_cost_usd", "first_seen", "last_seen", F.size("routes").cast("long").alias("n_routes"))),
    f"{_canonical_sql('global')} SELECT model, max_by(assumed_model, route_start) AS assumed_model, max_by(upper_bound_model, route_start) AS upper_bound_model, {_MODEL}, round(sum(assumed_cost_usd), 9) AS assumed_cost_usd, round(sum(assumed_upper_bound_cost_usd), 9) AS assumed_upper_bound_cost_usd, {_FIRST}, {_LAST}, count(DISTINCT route_id) AS n_routes FROM q WHERE assumed_requests > 0 GROUP BY model",
)
_add(
    "assumed_routes",
    lambda s, d: _rounded(_costed(s, d).where("assumed_requests > 0").groupBy("model", F.col("route.id").alias("route_id")).agg(F.count("*").alias("requests"), F.sum("assumed_cost_usd").alias("assumed_cost_usd"), F.sum("assumed_upper_bound_cost_usd").alias("upper_usd"))),
    f"{_canonical_sql('global')} SELECT model, route_id, count(*) AS requests, round(sum(assumed_cost_usd), 9) AS assumed_cost_usd, round(sum(assumed_upper_bound_cost_usd), 9) AS upper_usd FROM q WHERE assumed_requests > 0 GROUP BY 1, 2",
)
_add(
    "assumed_model_routes",
    lambda s, d: _rounded(A.assumed_models(_costed(s, d)).select("model", F.posexplode("routes").alias("place", "r")).select("model", "place", F.col("r.id").alias("route_id"), "r.requests", "r.total_tokens", "r.assumed_cost_usd", "r.first_seen")),
    f"{_canonical_sql('global')} SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY min(route_start)) - 1 AS INTEGER) AS place, route_id, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(assumed_cost_usd), 9) AS assumed_cost_usd, {_FIRST} FROM q WHERE assumed_requests > 0 GROUP BY model, route_id",
)


def _mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose names differ by case; the first of them in the order that people expect (a, A, b)."""
    query = UsageQuery(group="model", sort="key", desc=False, limit=3)
    named = adapted(spark, sf_dir).withColumn("model", F.when(F.col("event_index") % 3 == 0, F.initcap("model")).otherwise(F.col("model")))
    return A.ordered(A.grouped(priced(canonical(named), spark, demo_catalog()), query), query).select("key", "sessions", "requests", "total_tokens")


_add("first_keys_of_mixed_case", _mixed_case, f"WITH {_U}, m AS (SELECT *, CASE WHEN event_index % 3 = 0 THEN upper(left(model, 1)) || substr(model, 2) ELSE model END AS key FROM u) SELECT key, count(DISTINCT session_id) AS sessions, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM m GROUP BY key ORDER BY lower(key), key DESC LIMIT 3")


def _sessions_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct sessions of each month, from slices by day that are merged."""
    rows = adapted(spark, sf_dir).withColumn("day", local_time(F.col("timestamp_ms"), "Asia/Kolkata", "day"))
    days = A.session_slices(rows, A.session_numbers(rows, scratch_folder(spark, "sessions")), "day")
    return A.merged_sessions(days.withColumn("month", F.when(F.col("day").startswith("("), F.col("day")).otherwise(F.substring("day", 1, 7))), "month")


_add("sessions_by_month_from_days", _sessions_by_month, f"WITH {_U} SELECT {_key_sql('month', 'Asia/Kolkata')} AS month, count(DISTINCT session_id) AS sessions, count(*) AS requests FROM u GROUP BY 1")
_add(
    "asof_price_per_request",
    lambda s, d: _rounded(_costed(s, d).select("total_usage_key", "model", "reference_total_cost_usd", "reference_total_upper_bound_cost_usd", "priced_requests", "provisional_priced_requests")),
    f"{_canonical_sql('global')} SELECT total_usage_key, model, round(reference_total_cost_usd, 9) AS reference_total_cost_usd, round(reference_total_upper_bound_cost_usd, 9) AS reference_total_upper_bound_cost_usd, priced_requests, provisional_priced_requests FROM q",
)
_add(
    "price_spans",
    lambda s, d: price_spans(s, demo_catalog()).select("model_key", "valid_from", "valid_to", "official", "provisional", F.col("price.input").alias("input_rate"), F.col("route.id").alias("route_id")),
    f"""WITH {_PRICES}, named AS (SELECT m AS model FROM pv UNION SELECT alias FROM al UNION SELECT m FROM rt),
s AS (SELECT m AS model, start FROM pv UNION SELECT al.alias, start FROM al JOIN pv ON pv.m = al.m UNION SELECT m, start FROM rt
      UNION SELECT rt.m, pv.start FROM rt JOIN pv ON pv.m IN (rt.low_m, rt.high_m)),
cuts AS (SELECT model, CAST(NULL AS BIGINT) AS valid_from FROM named UNION SELECT model, start FROM s WHERE start > {_BASE}),
spans AS (SELECT model, valid_from, lead(valid_from) OVER (PARTITION BY model ORDER BY valid_from NULLS FIRST) AS valid_to, coalesce(valid_from, {_BASE}) AS timestamp_ms FROM cuts),
{_asof('spans').replace(_PRICES + ',', '', 1)} SELECT model AS model_key, valid_from, valid_to, official, provisional, p_i AS input_rate, CASE WHEN NOT official THEN route_id END AS route_id FROM j WHERE official IS NOT NULL""",
)
_add("duplicate_counts", lambda s, d: duplicates(with_copies(adapted(s, d))), f"WITH {_U}, {_C} SELECT count(*) AS indexed, count(DISTINCT total_usage_key) AS canonical, count(*) - count(DISTINCT total_usage_key) AS global_duplicates FROM c")
_add("canonical_events", lambda s, d: canonical(with_copies(adapted(s, d))).select("total_usage_key", "file_path", "timestamp_ms", "total_tokens"), f"WITH {_U}, {_C} SELECT total_usage_key, file_path, timestamp_ms, total_tokens FROM (SELECT *, {_RANK} AS rn FROM c) WHERE rn = 1")
_add(
    "unknown_times",
    lambda s, d: A.unknown_times(canonical(with_copies(adapted(s, d))), True),
    f"WITH {_U} SELECT count(*) AS events, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, count(*) AS excluded_events, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS excluded_tokens FROM u WHERE timestamp_ms IS NULL",
)
_parts = {"uncached input": "input_tokens - cached_input_tokens - cache_write_input_tokens", "cached input": "cached_input_tokens", "cache write": "cache_write_input_tokens", "visible output": "output_tokens - reasoning_output_tokens", "reasoning": "reasoning_output_tokens"}
_add(
    "composition",
    lambda s, d: _rounded(A.composition(A.totals(_costed(s, d)))),
    f"WITH {_U}, m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS part, CAST(sum({e}) AS BIGINT) AS tokens FROM u" for n, e in _parts.items()) + ") SELECT part, tokens, round(tokens / CAST(sum(tokens) OVER () AS DOUBLE), 9) AS share FROM m",
)
_add("distinct_models", lambda s, d: A.models_in(adapted(s, d)), f"WITH {_U} SELECT DISTINCT model FROM u WHERE model NOT IN ('', '(unknown model)')")
_add("path_prefix", lambda s, d: with_copies(adapted(s, d)).where(under(F.col("file_path"), ["/logs/0", "/logs/a/u1"])).groupBy("file_path").agg(F.count("*").alias("n")), f"WITH {_U}, {_C} SELECT file_path, count(*) AS n FROM c WHERE file_path LIKE '/logs/0/%' OR file_path = '/logs/a/u1' OR file_path LIKE '/logs/a/u1/%' GROUP BY 1")
_add("search_keys", lambda s, d: adapted(s, d).where(contains_folded(F.col("cwd"), " P1 ")).groupBy("cwd").agg(F.count("*").alias("n")), f"WITH {_U} SELECT cwd, count(*) AS n FROM u WHERE contains(lower(cwd), 'p1') GROUP BY 1")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals of the copied users leave; only their keys are ranked again."""
    events = with_copies(adapted(spark, sf_dir))
    gone = events.where(F.col("file_path").startswith("/logs/a/") & (F.substring("session_id", 2, 20).cast("long") % 3 == 0))
    left = events.join(gone.select("file_path").distinct(), "file_path", "left_anti")
    return repair(canonical(events), left, changed_keys(gone, gone.limit(0))).select("total_usage_key", "file_path", "timestamp_ms")


_add("dirty_key_repair", _repaired, f"WITH {_U}, {_C}, l AS (SELECT * FROM c WHERE NOT (file_path LIKE '/logs/a/%' AND user_id % 3 = 0)) SELECT total_usage_key, file_path, timestamp_ms FROM (SELECT *, {_RANK} AS rn FROM l) WHERE rn = 1")
_add(
    "deleted_files",
    lambda s, d: with_copies(adapted(s, d)).select("file_path").distinct().join(adapted(s, d).select("file_path").distinct(), "file_path", "left_anti"),
    f"WITH {_U}, {_C} SELECT DISTINCT file_path FROM c WHERE file_path NOT IN (SELECT file_path FROM u)",
)
_add("changed_keys", lambda s, d: changed_keys(adapted(s, d).where("model = 'click'"), adapted(s, d).where("cwd = '/p1'")), f"WITH {_U} SELECT total_usage_key FROM u WHERE model = 'click' UNION SELECT total_usage_key FROM u WHERE cwd = '/p1'")


# --- the parser, over log lines made from the events of each user -----------------------------------------------


def _stamp(when=None) -> Column:
    """The timestamp of a line, for events that have one (and, if given, meet ``when``)."""
    at = F.concat(F.lit('"timestamp":"'), iso_time(F.col("timestamp_ms")), F.lit('",'))
    return F.coalesce(at if when is None else F.when(when, at), F.lit(""))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_path, line_no, line, unterminated``: cumulative counters; every fifth count is written twice, models change
    only with purchases, and the first events of a file come before any context."""
    rows = adapted(spark, sf_dir)
    order = Window.partitionBy("session_id").orderBy("event_index")
    sums = {f"s{i}": F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for i, c in enumerate(COUNTERS)}
    rows = rows.withColumns({**sums, "n": F.row_number().over(order)})
    usage = F.to_json(F.struct(*(F.col(f"s{i}").alias(c) for i, c in enumerate(COUNTERS))))
    count = F.concat(F.lit("{"), _stamp(), F.lit('"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":'), usage, F.lit("}}}"))
    context = F.concat(F.lit('{"type":"turn_context","payload":{"turn_id":"t'), F.col("event_index"), F.lit('","model":"m'), F.col("event_index") % 7, F.lit('"}}'))
    lines = F.concat(
        F.when(F.col("model") == "purchase", F.array(context)).otherwise(F.array().cast("array<string>")),
        F.array(count),
        F.when(F.col("n") % 5 == 0, F.array(count)).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n") % 11 == 0, F.array(F.lit('{"type":"event_msg","payload":{"type":"token_count"'))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select("file_path", "n", F.posexplode(lines).alias("i", "line")).select("file_path", (F.col("n") * 10 + F.col("i")).cast("long").alias("line_no"), "line", F.lit(False).alias("unterminated"))


def _parsed(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and file counts of lines; their parsed rows are written once, in ranges of a few lines each."""
    ranges = lines.withColumn("segment", F.expr("line_no div 10 * 10"))
    return usage_events(settled(records(ranges), scratch_folder(spark, "records")))


_L = f"""WITH {_U}, o AS (SELECT *, row_number() OVER w AS n, {', '.join(f'sum({c}) OVER w AS s{i}' for i, c in enumerate(COUNTERS))} FROM u WINDOW w AS (PARTITION BY session_id ORDER BY event_index ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, {', '.join(f's{i}' for i in range(6))} ORDER BY n) AS again FROM o),
f AS (SELECT *, last_value(CASE WHEN model = 'purchase' THEN 'm' || (event_index % 7) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS back,
  first_value(CASE WHEN model = 'purchase' THEN 'm' || (event_index % 7) END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM r)"""
_add(
    "parsed_events",
    lambda s, d: _parsed(s, _logs(s, d))[0].select("file_path", "event_index", "timestamp_ms", "model", *COUNTERS),
    f"{_L} SELECT file_path, row_number() OVER (PARTITION BY session_id ORDER BY n) - 1 AS event_index, timestamp_ms, coalesce(back, ahead, '(unknown model)') AS model, {', '.join(COUNTERS)} FROM f WHERE again = 1",
)
_add(
    "parsed_file_stats",
    lambda s, d: A.file_stats(_parsed(s, _logs(s, d))[1]),
    f"{_L} SELECT count(DISTINCT session_id) AS files, count(DISTINCT session_id) AS files_with_usage, CAST(count(*) + count(*) FILTER (WHERE n % 5 = 0) - count(*) FILTER (WHERE again = 1) AS BIGINT) AS duplicate_token_events, count(*) FILTER (WHERE n % 11 = 0) AS parse_errors, count(*) + count(*) FILTER (WHERE n % 5 = 0) AS raw_token_events, count(*) FILTER (WHERE again = 1) AS events_count FROM f",
)

# Sessions with metadata (only the first of a file counts), settings, tasks, reported last usage, and lines without a time.
_META, _SET, _START, _END, _LAST_USE, _TIMED = ("n % 7 = 1 AND user % 2 = 0", "n % 5 = 2", "n % 4 = 0", "n % 4 = 2", "n % 3 = 0", "n % 6 <> 5")


def _session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).withColumn("user", F.substring("session_id", 2, 20).cast("long"))
    order = Window.partitionBy("session_id").orderBy("event_index")
    rows = rows.withColumns({**{f"s{i}": F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for i, c in enumerate(COUNTERS)}, "n": F.row_number().over(order)})
    when = lambda test, line: F.when(F.expr(test), F.array(line)).otherwise(F.array().cast("array<string>"))
    own = F.col("event_index").cast("string")
    event = lambda kind, rest: F.concat(F.lit(f'{{"type":"event_msg","payload":{{"type":"{kind}"'), *rest, F.lit("}}"))
    total = F.to_json(F.struct(*(F.col(f"s{i}").alias(c) for i, c in enumerate(COUNTERS))))
    last = F.when(F.expr(_LAST_USE), F.concat(F.lit(',"last_token_usage":'), F.to_json(F.struct(*((F.col(c) + 1).alias(c) for c in COUNTERS))))).otherwise("")
    meta = F.concat(F.lit("{"), _stamp(), F.lit('"type":"session_meta","payload":{"id":" s'), own, F.lit('","cwd":"/m'), F.col("user") % 5, F.lit('"}}'))
    lines = F.concat(
        when(_META, meta),
        when(_SET, event("thread_settings_applied", [F.lit(',"thread_settings":{"model":"set'), F.col("event_index") % 3, F.lit('"}')])),
        when(_START, event("task_started", [F.lit(',"turn_id":"t'), own, F.lit('"')])),
        when(_END, event("task_complete", [])),
        F.array(F.concat(F.lit("{"), _stamp(F.expr(_TIMED)), F.lit('"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":'), total, last, F.lit("}}}"))),
    )
    return rows.select("file_path", "n", F.posexplode(lines).alias("i", "line")).select("file_path", (F.col("n") * 10 + F.col("i")).cast("long").alias("line_no"), "line", F.lit(False).alias("unterminated"))


_SESSIONS = f"""WITH {_U}, o AS (SELECT *, user_id AS user, row_number() OVER w AS n, {', '.join(f'sum({c}) OVER w AS s{i}' for i, c in enumerate(COUNTERS))} FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_index ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, row_number() OVER (PARTITION BY user, {', '.join(f's{i}' for i in range(6))} ORDER BY n) AS again, CASE WHEN {_TIMED} THEN timestamp_ms END AS own,
  CASE WHEN user % 2 = 0 THEN first_value(timestamp_ms) OVER w END AS created, CASE WHEN user % 2 = 0 THEN 's' || first_value(event_index) OVER w ELSE 'u' || user END AS session,
  CASE WHEN user % 2 = 0 THEN '/m' || (user % 5) ELSE '(unknown cwd)' END AS place,
  coalesce(last_value(CASE WHEN {_SET} THEN 'set' || (event_index % 3) END IGNORE NULLS) OVER w, first_value(CASE WHEN {_SET} THEN 'set' || (event_index % 3) END IGNORE NULLS) OVER (PARTITION BY user ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '(unknown model)') AS named,
  coalesce(last_value(CASE WHEN {_START} THEN 't' || event_index WHEN {_END} THEN '' END IGNORE NULLS) OVER w, '') AS turn
  FROM o WINDOW w AS (PARTITION BY user ORDER BY n ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, {', '.join(f'CASE WHEN {_LAST_USE} THEN {c} + 1 ELSE greatest(0, s{i} - coalesce(lag(s{i}) OVER k, 0)) END AS d{i}' for i, c in enumerate(COUNTERS))} FROM f WHERE again = 1 WINDOW k AS (PARTITION BY user ORDER BY n))"""
_KEY = "concat_ws(',', " + ", ".join(f"s{i}" for i in range(6)) + ")"
_PRINT = f"sha256(concat_ws(chr(31), CASE WHEN turn <> '' THEN 'turn:' || turn WHEN own IS NOT NULL THEN 'time:' || own ELSE 'none' END, {_KEY}, concat_ws(',', {', '.join(f'd{i}' for i in range(6))}), CASE WHEN turn = '' AND own IS NULL THEN concat_ws(chr(31), session, place, named) ELSE '' END))"
_add(
    "session_contexts",
    lambda s, d: _parsed(s, _session_logs(s, d))[0],
    f"{_SESSIONS} SELECT file_path, row_number() OVER (PARTITION BY user ORDER BY n) - 1 AS event_index, coalesce(own, created) AS timestamp_ms, own IS NOT NULL AS has_event_timestamp, created AS session_created_at_ms, session AS session_id, {_PRINT} || ':' || {_KEY} AS total_usage_key, place AS cwd, named AS model, {', '.join(f'CAST(d{i} AS BIGINT) AS {c}' for i, c in enumerate(COUNTERS))} FROM e",
)

# --- logs as files: written, listed, read by byte ranges, indexed as they grow -----------------------------------


def _named(lines: DataFrame) -> DataFrame:
    """Lines with the file they go to: plain for some users, compressed for others."""
    user = F.regexp_extract("file_path", r"u(\d+)$", 1)
    packed = user.cast("long") % 3 == 0
    return lines.select(F.concat(F.when(packed, "b/").otherwise("a/"), F.lit("u"), user, F.when(packed, ".jsonl.zst").otherwise(".jsonl")).alias("name"), "line_no", "line")


def _shown(events: DataFrame) -> DataFrame:
    return events.select(F.substring_index("file_path", "/", -1).alias("name"), "event_index", "timestamp_ms", "model", *COUNTERS)


def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are cut into ranges of a quarter of their mean size at most, so most have several."""
    folder = scratch_folder(spark, "logs")
    write_logs(_named(_logs(spark, sf_dir)), folder)
    sizes = [file_state(p)["size"] for p in list_logs([folder])]
    return _shown(scan(spark, [f"{folder}/b", folder, f"{folder}/none"], max(1, sum(sizes) // (len(sizes) or 1) // 4)).events)


def _grown_index(spark: SparkSession, sf_dir: str) -> UsageIndex:
    """Half of each file's lines are indexed, then the rest. Each file begins with a turn of its own: without a turn, equal events
    of two users at the same time would be taken for copies of one request."""
    users = adapted(spark, sf_dir).select("file_path", "session_id").distinct()
    turn = F.concat(F.lit('{"type":"event_msg","payload":{"type":"task_started","turn_id":"'), "session_id", F.lit('"}}'))
    turns = users.select("file_path", F.lit(1).cast("long").alias("line_no"), turn.alias("line"), F.lit(False).alias("unterminated"))
    folder, lines = scratch_folder(spark, "grown"), _named(_logs(spark, sf_dir).unionByName(turns))
    index = UsageIndex(spark, f"{folder}/index")
    write_logs(lines.where("line_no < 300"), f"{folder}/logs")
    index.refresh([f"{folder}/logs"])
    write_logs(lines.where(F.col("name").endswith(".zst") | (F.col("line_no") >= 300)), f"{folder}/logs")
    index.refresh([f"{folder}/logs"])
    return index


def _from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_grown_index(spark, sf_dir).events())


_FILE = "'u' || user_id || CASE WHEN user_id % 3 = 0 THEN '.jsonl.zst' ELSE '.jsonl' END AS name"
_READ = f"{_L} SELECT {_FILE}, row_number() OVER (PARTITION BY session_id ORDER BY n) - 1 AS event_index, timestamp_ms, coalesce(back, ahead, '(unknown model)') AS model, {', '.join(COUNTERS)} FROM f WHERE again = 1"
_add("events_from_files", _from_files, _READ)
_add("events_from_grown_index", _from_index, _READ)


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed halves in place of some plain logs, nothing in place of others; doing so again changes nothing."""
    n = 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            user = re.search(r"/u(\d+)\.jsonl$", path)
            if not user or int(user[1]) % 4 not in (1, 2):
                continue
            with contextlib.suppress(FileNotFoundError):  # done before
                if int(user[1]) % 4 == 1:
                    beside = f"{path}.{uuid.uuid4().hex}.tmp"
                    with open(path, "rb") as whole, zstandard.open(beside, "wb") as packed:
                        shutil.copyfileobj(whole, packed, 1 << 20)
                    os.truncate(beside, os.path.getsize(beside) // 2)
                    os.replace(beside, f"{path}.zst")
                os.remove(path)
                n += 1
    yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def _from_replaced_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a first refresh some plain logs give way to compressed copies that end in mid-frame, and others are deleted. A copy
    that can't be read keeps the events of the log it replaces; a deleted log takes its events along."""
    folder = scratch_folder(spark, "replaced")
    logs, index = f"{folder}/logs", UsageIndex(spark, f"{folder}/index")
    write_logs(_named(_logs(spark, sf_dir)), logs)
    index.refresh([logs])
    paths = spark.createDataFrame([(p,) for p in list_logs([logs])], "path string").repartition(4 * spark.sparkContext.defaultParallelism)
    paths.mapInArrow(_replaced, "n long").agg(F.sum("n")).collect()
    index.refresh([logs])
    return _shown(index.events())


_add("events_of_replaced_logs", _from_replaced_logs, f"{_READ} AND NOT (user_id % 3 <> 0 AND user_id % 4 = 2)")

_add(
    "maintained_usage",
    lambda s, d: _grown_index(s, d).usage("day", "Asia/Kolkata"),
    f"{_L} SELECT {_key_sql('day', 'Asia/Kolkata')} AS key, count(DISTINCT session_id) AS sessions, count(*) AS requests, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)} FROM f WHERE again = 1 GROUP BY 1",
)

# --- options and functions ---------------------------------------------------------------------------------------


def _day_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first instant of every day on which there are events (a bounded list of days), in two zones."""
    days = adapted(spark, sf_dir).where("timestamp_ms IS NOT NULL").select(F.timestamp_millis("timestamp_ms").cast("date").alias("d")).distinct().collect()
    return spark.createDataFrame([(z, r.d, start_of_day(r.d, z)) for z in ("America/New_York", "Asia/Kolkata") for r in days], "zone string, day date, start_ms long")


_add("day_starts", _day_starts, f"WITH {_U}, d AS (SELECT DISTINCT CAST(make_timestamp(timestamp_ms * 1000) AS DATE) AS day FROM u WHERE timestamp_ms IS NOT NULL), z AS (SELECT unnest(['America/New_York', 'Asia/Kolkata']) AS zone) SELECT zone, day, epoch_ms(timezone(zone, CAST(day AS TIMESTAMP))) AS start_ms FROM d, z")


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in the ranges that end with the last event."""
    rows = adapted(spark, sf_dir)
    now = rows.agg(F.max("timestamp_ms")).first()[0] or 0
    spans = {name: rolling(name, now) for name in ROLLING}
    counts = rows.agg(*(F.count_if(in_range(F.col("timestamp_ms"), *spans[n])).alias(n) for n in spans))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("span"), F.col(f"`{n}`").alias("requests")) for n in spans))))


_add("rolling_ranges", _rolling, f"WITH {_U}, m AS (SELECT max(timestamp_ms) - max(timestamp_ms) % 60000 AS now FROM u), r AS (SELECT * FROM (VALUES ('24h', 24), ('7d', 168), ('30d', 720), ('12w', 2016)) v(span, hours)) SELECT span, count(u.event_index) AS requests FROM r CROSS JOIN m LEFT JOIN u ON u.timestamp_ms >= now - hours * CAST(3600000 AS BIGINT) AND u.timestamp_ms < now GROUP BY span")


def _by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    adapted(spark, sf_dir).createOrReplaceTempView("quillmeter_events")
    return spark.sql("SELECT date_key(timestamp_ms, 'day', 'America/Los_Angeles') AS day, date_time(min(timestamp_ms), 'Asia/Kolkata') AS first_seen, count(*) AS requests FROM quillmeter_events GROUP BY 1")


_add("by_sql_function", _by_function, f"WITH {_U} SELECT coalesce(strftime(make_timestamptz(timestamp_ms * 1000) AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d'), '(unknown time)') AS day, coalesce(strftime(make_timestamptz(min(timestamp_ms) * 1000) AT TIME ZONE 'Asia/Kolkata', '%Y-%m-%d %H:%M'), '(unknown time)') AS first_seen, count(*) AS requests FROM u GROUP BY 1")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price page for every part: some without cached prices, with multipliers, with a threshold, or of another model."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("p"))
    key, some = F.col("p_partkey"), lambda test, *text: F.when(F.expr(test), F.concat(*text)).otherwise("")
    row = lambda name, by: (F.lit(f"| {name} | $"), F.format_number(F.col("p") * by, 2), F.lit(" | 1M tokens |\n"))
    text = F.concat(
        F.lit("# Part\n\n| Input | $1 | 1M tokens |\n\n| Model ID | `part-"), key, some("p_partkey % 11 = 0", F.lit("x")), F.lit("` |\n\n## Pricing\n\n### Text tokens\n\n| Kind | Price | Unit |\n| --- | --- | --- |\n"),
        *row("Input", 1), some("p_partkey % 3 > 0", *row("Cached input", 2)), *row("Output", 3),
        some("p_partkey % 4 = 1", F.lit("\nFor cache writes, 1.25x the input rate applies.\n")),
        some("p_partkey % 7 < 3", F.lit("\nRequests with > "), F.format_number(key + 1000, 0), F.lit(" input tokens cost 2x input and 1.5x output.\n")),
        F.lit("\n### Other\n\n| Output | $5 | 1M tokens |\n"),
    )
    return part.select(F.concat(F.lit(" Part-"), key).alias("model"), text.alias("markdown"))


_price = lambda by, test: f"CASE WHEN p_partkey % 11 <> 0 AND {test} THEN CAST(p * {by} AS DOUBLE) END"
_add(
    "prices_on_pages",
    lambda s, d: _rounded(page_versions(_pages(s, d)).drop("content_hash")),
    f"""WITH t AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,2)) AS p FROM part)
SELECT 'part-' || p_partkey AS model, {_price('1', 'true')} AS input, {_price('2', 'p_partkey % 3 > 0')} AS cached, {_price('1.25', 'p_partkey % 4 = 1')} AS cache_write, {_price('3', 'true')} AS output,
  {_price('2', 'p_partkey % 7 < 3')} AS long_input, {_price('4', 'p_partkey % 7 < 3 AND p_partkey % 3 > 0')} AS long_cached, {_price('2.5', 'p_partkey % 7 < 3 AND p_partkey % 4 = 1')} AS long_write, {_price('4.5', 'p_partkey % 7 < 3')} AS long_output,
  CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 < 3 THEN CAST(p_partkey + 1000 AS BIGINT) END AS threshold,
  CASE WHEN p_partkey % 11 = 0 THEN 'Model ID mismatch: expected part-' || p_partkey || ', found part-' || p_partkey || 'x' END AS error FROM t""",
)

# --- the same operators over other tables ------------------------------------------------------------------------

_add(
    "orders_by_month",
    lambda s, d: _table(s, d, "orders").groupBy(local_time(F.unix_millis(F.col("o_orderdate").cast("timestamp")), "UTC", "month").alias("key")).agg(F.count("*").alias("requests"), F.count_distinct("o_custkey").alias("sessions")),
    "SELECT strftime(o_orderdate, '%Y-%m') AS key, count(*) AS requests, count(DISTINCT o_custkey) AS sessions FROM orders GROUP BY 1",
)
_add(
    "conversation_usage",
    lambda s, d: _table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("sessions"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.max("turn").alias("last_turn")),
    "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS sessions, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1",
)
_add(
    "chart_scale",
    lambda s, d: A.grouped(_costed(s, d), UsageQuery(group="day")).agg(nice_ceiling(F.max("total_tokens")).alias("scale")),
    f"{_canonical_sql('global')}, m AS (SELECT max(t) AS v FROM (SELECT sum(total_tokens) AS t FROM q GROUP BY {_key_sql('day', 'UTC')})), z AS (SELECT v, pow(10.0, floor(log10(v))) AS p FROM m) SELECT p * CASE WHEN v / p <= 1 THEN 1 WHEN v / p <= 2 THEN 2 WHEN v / p <= 5 THEN 5 ELSE 10 END AS scale FROM z",
)
_add("top_series", lambda s, d: A.top_series(A.grouped(_costed(s, d), UsageQuery(group="day")), "total_tokens", 18, True).select("key", "total_tokens"), f"{_canonical_sql('global')} SELECT {_key_sql('day', 'UTC')} AS key, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM q GROUP BY 1 ORDER BY total_tokens DESC, key DESC LIMIT 18")

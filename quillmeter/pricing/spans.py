"""A catalog as a table of price spans, and the as-of join of requests with it.

All starts of versions and routes that matter to a model cut time into spans; within one, every lookup (alias, version,
assumed route, the route's own versions) has one answer. So pricing is one equi-join with a range condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.usage import model_key, request_cost
from ..schemas import COSTS, PRICE_SPANS
from .catalog import Catalog, Version, to_iso

#: Spans up to which the table is broadcast (about 500 bytes each); above, the join shuffles by model.
BROADCAST_SPANS = 50_000


def _side(v: Version | None):
    if v is None:
        return None
    long = v.long or (None,) * 4
    return tuple(None if x is None else float(x) for x in (v.input, v.cached, v.write, v.output, *long)) + (v.threshold,)


def span_rows(catalog: Catalog) -> list[tuple]:
    def starts(model: str) -> set[int]:
        name = catalog.aliases.get(model, model)
        return {v.effective_ms for v in catalog.dated(catalog.models.get(name, []))}

    rows = []
    for model in sorted({*catalog.models, *catalog.aliases, *catalog.routes}):
        cuts = starts(model)
        for r in catalog.routes.get(model, []):
            cuts |= starts(r.model) | starts(r.upper_model) | ({r.effective_ms} - {None})
        ordered = [None, *sorted(cuts)]
        for start, end in zip(ordered, [*ordered[1:], None], strict=True):
            at = float("-inf") if start is None else start
            official = catalog.price(model, at)
            if official:
                rows.append((model, start, end, True, official.provisional, official.id, _side(official), _side(official), None))
                continue
            route = catalog.route(model, at)
            if not route:
                continue
            low = catalog.price(route.model, at)
            high = catalog.price(route.upper_model, at) or catalog.price(route.upper_model, None)
            if low and high:
                name = lambda m: catalog.aliases.get(m, m)
                facts = (route.id, to_iso(route.effective_ms), name(route.model), name(route.upper_model), route.label or f"{route.model} reference estimate", route.source_url, route.evidence)
                rows.append((model, start, end, False, False, low.id, _side(low), _side(high), facts))
    return rows


def price_spans(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame(span_rows(catalog), PRICE_SPANS)


def priced(events: DataFrame, spark: SparkSession, catalog: Catalog) -> DataFrame:
    """``events`` with the additive cost fields, ``route`` and ``price_version``; events without a time stay unpriced."""
    rows = span_rows(catalog)
    spans = spark.createDataFrame(rows, PRICE_SPANS)
    return price_with(events, F.broadcast(spans) if len(rows) <= BROADCAST_SPANS else spans)


def price_with(events: DataFrame, spans: DataFrame) -> DataFrame:
    at = F.col("timestamp_ms")
    match = (model_key(F.col("model")) == F.col("model_key")) & (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))) & at.isNotNull()
    joined = events.join(spans, match, "left")
    total = F.coalesce("total_tokens", F.lit(0))
    official, assumed = F.coalesce("official", F.lit(False)), F.coalesce(~F.col("official"), F.lit(False))
    provisional = official & F.coalesce("provisional", F.lit(False))
    low, high = request_cost(F.col("price")), request_cost(F.col("upper"))
    usd = lambda when, value: F.when(when, value).otherwise(F.lit(0.0))
    flag = lambda when: when.cast("long")
    tokens = lambda when: F.when(when, total).otherwise(F.lit(0)).cast("long")
    none = F.col("official").isNull()
    out = {
        "estimated_cost_usd": usd(official, low),
        "assumed_cost_usd": usd(assumed, low),
        "assumed_upper_bound_cost_usd": usd(assumed, high),
        "reference_total_cost_usd": usd(~none, low),
        "reference_total_upper_bound_cost_usd": usd(~none, F.when(official, low).otherwise(high)),
        "priced_requests": flag(official),
        "assumed_requests": flag(assumed),
        "unpriced_requests": flag(none),
        "priced_total_tokens": tokens(official),
        "assumed_total_tokens": tokens(assumed),
        "unpriced_total_tokens": tokens(none),
        "provisional_priced_requests": flag(provisional),
        "provisional_priced_total_tokens": tokens(provisional),
        "provisional_estimated_cost_usd": usd(provisional, low),
    }
    assert set(out) == set(COSTS)
    return joined.select(*events.columns, *(c.alias(n) for n, c in out.items()), "route", F.col("version_id").alias("price_version"))

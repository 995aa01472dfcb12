"""Payloads as JSON, CSV and text."""

from __future__ import annotations

import json

from .functions.text import number, percent, usd
from .schemas import COSTS

#: Column order of the CSV: fixed, later additions at the end.
CSV = (
    "key", "sessions", "requests", "input_tokens", "cached_input_tokens", "uncached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens",
    "estimated_cost_usd", "priced_requests", "unpriced_requests", "priced_total_tokens", "unpriced_total_tokens", "cache_hit_ratio",
    "cache_write_input_tokens", "assumed_cost_usd", "assumed_upper_bound_cost_usd", "reference_total_cost_usd", "reference_total_upper_bound_cost_usd",
    "assumed_requests", "assumed_total_tokens", "provisional_priced_requests", "provisional_priced_total_tokens", "provisional_estimated_cost_usd",
)
_TABLE = {"group": "key", "sessions": number, "requests": number, "input_tokens": number, "cached_input_tokens": number, "cache_write_input_tokens": number, "uncached_input_tokens": number, "output_tokens": number, "reasoning_output_tokens": number, "total_tokens": number, "estimated_cost_usd": usd, "reference_total_cost_usd": usd, "cache_hit_ratio": percent}
_HEADS = {"input_tokens": "input", "cached_input_tokens": "cached", "cache_write_input_tokens": "cache-write", "uncached_input_tokens": "uncached", "output_tokens": "output", "reasoning_output_tokens": "reasoning", "total_tokens": "total", "estimated_cost_usd": "official-cost", "reference_total_cost_usd": "reference-cost", "cache_hit_ratio": "cache%"}


def to_json(payload: dict) -> str:
    return json.dumps(payload, indent=2, ensure_ascii=False)


def _cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        x = int(x)
    text = str(x)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n') else text


def to_csv(rows: list[dict]) -> str:
    lines = [",".join(("group", *CSV[1:]))]
    lines += [",".join(_cell(r.get(c)) for c in CSV) for r in rows]
    return "\n".join(lines)


def to_table(rows: list[dict]) -> str:
    heads = [_HEADS.get(c, c) for c in _TABLE]
    body = [[str(r["key"]) if f == "key" else f(r[c]) for c, f in _TABLE.items()] for r in rows]
    widths = [max(map(len, column)) for column in zip(heads, *body, strict=True)]
    line = lambda cells: "  ".join(c.rjust(w) if i else c.ljust(w) for i, (c, w) in enumerate(zip(cells, widths, strict=True)))
    return "\n".join([line(heads), line(["-" * w for w in widths]), *map(line, body)])


def _top(rows: list[dict], show, most: int = 8) -> str:
    return ", ".join(map(show, rows[:most])) + (", ..." if len(rows) > most else "")


def to_text(p: dict) -> str:
    t, s = p["totals"], p["stats"]
    out = [
        "Token usage",
        f"Source: {', '.join(p['source'])}",
        f"Range: {p['range']['from'] or 'beginning'} .. {p['range']['to'] or 'now'}",
        f"Timezone: {p['timezone']}",
        f"Scanned: {number(s.get('files'))} files, {number(s.get('files_with_usage'))} with token events, {number(s.get('duplicate_token_events'))} duplicate lines skipped",
    ]
    if s.get("global_duplicate_token_events"):
        out.append(f"Global dedupe: {number(s['global_duplicate_token_events'])} copied events skipped")
    if s.get("parse_errors"):
        out.append(f"Parse warnings: {number(s['parse_errors'])} lines could not be parsed")
    if s.get("excluded_unknown_timestamp_events"):
        out.append(f"Unknown times: {number(s['excluded_unknown_timestamp_events'])} events / {number(s['excluded_unknown_timestamp_tokens'])} tokens outside the bounded range")
    elif s.get("unknown_timestamp_events"):
        out.append(f"Unknown times: {number(s['unknown_timestamp_events'])} events / {number(s['unknown_timestamp_tokens'])} tokens counted as unpriced")
    out += ["", "Totals:"]
    for name in ("sessions", "requests", "input_tokens", "cached_input_tokens", "cache_write_input_tokens", "uncached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"):
        out.append(f"  {name}: {number(t[name])}" + (f" ({percent(t['cache_hit_ratio'])})" if name == "cached_input_tokens" else ""))
    out.append(f"  official_estimated_cost_usd: {usd(t['estimated_cost_usd'])}")
    if t["provisional_priced_requests"]:
        out.append(f"  provisional_priced: {number(t['provisional_priced_requests'])} requests / {usd(t['provisional_estimated_cost_usd'])}")
    if t["assumed_requests"]:
        out.append(f"  assumed_cost_usd: {usd(t['assumed_cost_usd'])} .. {usd(t['assumed_upper_bound_cost_usd'])}")
    out.append(f"  reference_total_cost_usd: {usd(t['reference_total_cost_usd'])} .. {usd(t['reference_total_upper_bound_cost_usd'])}")
    if p["assumedModels"]:
        out.append("  assumed_models: " + _top(p["assumedModels"], lambda r: f"{r['model']} -> {r['assumed_model']} ({number(r['total_tokens'])} tokens)"))
    if t["unpriced_total_tokens"]:
        out.append(f"  unpriced_total_tokens: {number(t['unpriced_total_tokens'])}")
    if p["unpricedModels"]:
        out.append("  unpriced_models: " + _top(p["unpricedModels"], lambda r: f"{r['model']} ({number(r['total_tokens'])} tokens)"))
    if p["group"] != "none":
        cut = f", first {len(p['rows'])} of {p['rowCount']}" if p["rowCount"] > len(p["rows"]) else ""
        out += ["", f"Grouped by {p['group']}{cut}:", to_table(p["rows"]) if p["rows"] else "(no rows)"]
    return "\n".join(out)


assert set(COSTS) <= set(CSV)

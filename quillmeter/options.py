"""Query options: what to read, which time span, how to group, sort and cut."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime, timedelta
from datetime import time as clock
from zoneinfo import ZoneInfo

GROUPS = ("none", "day", "month", "model", "cwd", "session")
SORTS = {"key": "key", "total": "total_tokens", "input": "input_tokens", "output": "output_tokens", "cached": "cached_input_tokens", "reasoning": "reasoning_output_tokens", "requests": "requests", "sessions": "sessions", "cost": "reference_total_cost_usd"}
DEDUPE = ("global", "file")
SCOPES = ("all", "local", "wsl", "windows")
ROLLING = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30), "12w": timedelta(weeks=12)}
DAY_MS = 86_400_000


@dataclass(frozen=True)
class UsageQuery:
    roots: tuple[str, ...] = ()
    from_ms: int | None = None
    to_ms: int | None = None
    group: str = "month"
    sort: str | None = None
    desc: bool | None = None
    limit: int = 0
    dedupe: str = "global"
    timezone: str = "UTC"
    scope: str = "all"
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        for name, value, valid in (("group", self.group, GROUPS), ("sort", self.sort, (None, *SORTS)), ("dedupe scope", self.dedupe, DEDUPE), ("source scope", self.scope, SCOPES)):
            if value not in valid:
                raise ValueError(f"invalid {name}: {value}; valid values: {', '.join(map(str, valid))}")
        if not isinstance(self.limit, int) or self.limit < 0:
            raise ValueError("limit must be a non-negative integer")
        try:
            ZoneInfo(self.timezone)
        except Exception as e:
            raise ValueError(f"unknown timezone: {self.timezone}") from e

    @property
    def by_date(self) -> bool:
        return self.group in ("day", "month")

    @property
    def sort_name(self) -> str:
        """Dates sort by key, other groups by total tokens, unless told otherwise."""
        return self.sort or ("key" if self.by_date else "total")

    @property
    def descending(self) -> bool:
        return (not self.by_date) if self.desc is None else self.desc

    @property
    def bounded(self) -> bool:
        return self.from_ms is not None or self.to_ms is not None


def parse_duration(text: str) -> int:
    """``90h``, ``7d`` or ``2w`` in milliseconds."""
    m = re.fullmatch(r"(\d+)([hdw])", text.strip().lower())
    if not m:
        raise ValueError(f"invalid duration: {text}")
    return int(m[1]) * {"h": 3_600_000, "d": DAY_MS, "w": 7 * DAY_MS}[m[2]]


def start_of_day(day: date, timezone: str) -> int:
    """Epoch milliseconds of the first instant of ``day`` in the zone; raises if the zone has no such day."""
    zone = ZoneInfo(timezone)
    midnight = datetime.combine(day, clock.min, zone)  # the earlier one, where clocks show it twice
    first = midnight.astimezone(UTC)
    if first.astimezone(zone).replace(tzinfo=None) != midnight.replace(tzinfo=None):
        # Clocks jump over midnight: the day begins where they land, within hours of it, or not at all.
        around = (first + timedelta(minutes=m) for m in range(-180, 181))
        first = next((t for t in around if t.astimezone(zone).date() == day), None)
        if first is None:
            raise ValueError(f"the day {day} does not exist in {timezone}")
    return int(first.timestamp() * 1000)


def parse_bound(text: str, timezone: str, end: bool = False) -> int:
    """A bound in milliseconds: a date (``end``: the start of the next day) or an ISO time."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            day = date.fromisoformat(text)
        except ValueError as e:
            raise ValueError(f"invalid date: {text}") from e
        return start_of_day(day + timedelta(days=1) if end else day, timezone)
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"invalid time: {text}") from e
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def rolling(name: str, now_ms: int | None = None) -> tuple[int, int]:
    """``[from, to)`` of a rolling range, to the minute."""
    if name not in ROLLING:
        raise ValueError(f"invalid range: {name}; valid values: {', '.join(ROLLING)}")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    now -= now % 60_000
    return now - int(ROLLING[name].total_seconds() * 1000), now


def web_limit(text: str | None, group: str) -> int:
    """Limit of a web request: 0 to 500; 30 for paths and sessions where none is given."""
    if text in (None, ""):
        return 30 if group in ("cwd", "session") else 0
    if not re.fullmatch(r"\d+", text):
        raise ValueError("limit must be a non-negative integer")
    return min(500, int(text))


def split_paths(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split(os.pathsep) if p.strip()]


def parse_args(argv: list[str], now_ms: int | None = None, env: dict[str, str] | None = None) -> UsageQuery:
    """Command line to query. ``--timezone`` may follow the dates it applies to; of ``--desc`` and ``--asc`` the first named wins."""
    env = os.environ if env is None else env
    roots, flags, raw = [], {}, {}
    values = {"--sessions": "roots", "--sessions-dir": "roots", "--from": "from", "--since": "from", "--to": "to", "--until": "to", "--last": "last", "--group": "group", "--sort": "sort", "--limit": "limit", "--dedupe-scope": "dedupe", "--timezone": "timezone", "--tz": "timezone", "--scope": "scope", "--cache-dir": "cache"}
    args = list(argv)
    while args:
        name = args.pop(0)
        if name in ("--json", "--csv", "--desc", "--asc", "--today", "--use-cache", "--help", "-h"):
            flags[name] = True
            if name == "--today":
                raw.pop("to", None)
                raw.pop("from", None)
                raw["today"] = True
                raw.pop("last", None)
        elif name in values:
            if not args:
                raise ValueError(f"missing value for {name}")
            value = args.pop(0)
            if values[name] == "roots":
                roots.append(value)
                continue
            raw[values[name]] = value
            if values[name] == "last":
                raw.pop("to", None)
                raw.pop("from", None)
                raw.pop("today", None)
            elif values[name] == "from":
                raw.pop("last", None)
                raw.pop("today", None)
        else:
            raise ValueError(f"unknown argument: {name}")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    zone = raw.get("timezone", "UTC")
    query = UsageQuery(timezone=zone)
    start = parse_bound(raw["from"], zone) if "from" in raw else None
    if "last" in raw:
        start = now - parse_duration(raw["last"])
    elif raw.get("today"):
        start = start_of_day(datetime.fromtimestamp(now / 1000, ZoneInfo(zone)).date(), zone)
    limit = raw.get("limit", "0")
    if not re.fullmatch(r"\d+", limit):
        raise ValueError("--limit must be a non-negative integer")
    found = roots or split_paths(env.get("QUILLMETER_ROOTS"))
    return replace(
        query,
        roots=tuple(dict.fromkeys(os.path.expanduser(r) for r in found)),
        from_ms=start,
        to_ms=parse_bound(raw["to"], zone, end=True) if "to" in raw else None,
        group=raw.get("group", "month"),
        sort=raw.get("sort"),
        desc=True if "--desc" in flags else False if "--asc" in flags else None,
        limit=int(limit),
        dedupe=raw.get("dedupe", "global"),
        scope=raw.get("scope", "all"),
        extra={"json": "--json" in flags, "csv": "--csv" in flags, "help": "--help" in flags or "-h" in flags, "use_cache": "--use-cache" in flags or "cache" in raw, "cache": raw.get("cache")},
    )

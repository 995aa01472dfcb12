"""Price catalogs: versions per model, aliases, assumed routes; validation, merging and evolution.

A catalog is plain data of some tens of rows that lives on the driver; ``spans`` turns it into a table for Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from . import builtin

SCHEMA_VERSION = 2
RATE_NAMES = ("input", "cached", "write", "output")
_JSON_RATES = {"input": "input", "cached": "cachedInput", "write": "cacheWrite", "output": "output"}


def to_ms(text: str | None) -> int | None:
    if text in (None, ""):
        return None
    try:
        at = datetime.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise ValueError(f"invalid time: {text}") from e
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def to_iso(ms: int | None) -> str | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def normal(model: str) -> str:
    return (model or "").strip().lower()


@dataclass(frozen=True)
class Version:
    id: str
    effective_ms: int | None
    provisional: bool
    input: float
    output: float
    cached: float | None = None
    write: float | None = None
    long: tuple[float, float | None, float | None, float] | None = None  # input, cached, write, output
    threshold: int | None = None
    observed_ms: int | None = None
    superseded_by: str | None = None
    source_url: str | None = None
    content_hash: str | None = None
    evidence: str | None = None

    def __post_init__(self):
        if not self.id:
            raise ValueError("a price version needs an id")
        long = self.long or ()
        for name, rate in (("input", self.input), ("output", self.output), *(("optional", r) for r in (self.cached, self.write, *long) if r is not None)):
            if not isinstance(rate, int | float) or isinstance(rate, bool) or not rate > 0 or rate == float("inf"):
                raise ValueError(f"{self.id}: {name} rate must be a positive number")
        if (self.long is None) != (self.threshold is None):
            raise ValueError(f"{self.id}: long-context rates and their threshold go together")

    def rates(self) -> tuple:
        return (self.input, self.cached, self.write, self.output, self.long, self.threshold)


@dataclass(frozen=True)
class Route:
    id: str
    effective_ms: int | None
    model: str
    upper_model: str
    label: str | None = None
    source_url: str | None = None
    evidence: str = "assumption"


@dataclass
class Catalog:
    models: dict[str, list[Version]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    routes: dict[str, list[Route]] = field(default_factory=dict)
    checked_at: str | None = None
    currency: str = "USD"
    basis: str = "standard text-token prices per 1M tokens"

    # -- selection ---------------------------------------------------------------------------------------------

    def baseline(self, versions: list[Version]) -> Version | None:
        undated = [v for v in versions if v.superseded_by is None and v.effective_ms is None]
        best = None
        for v in undated:  # the last observed wins, the later in the list on ties
            if best is None or (v.observed_ms or 0) >= (best.observed_ms or 0):
                best = v
        return best

    def dated(self, versions: list[Version]) -> list[Version]:
        return sorted((v for v in versions if v.superseded_by is None and v.effective_ms is not None), key=lambda v: v.effective_ms)

    def price(self, model: str, at_ms: int | float | None) -> Version | None:
        """The version in force at a time; without a time the latest."""
        name = normal(model)
        versions = self.models.get(self.aliases.get(name, name))
        if not versions:
            return None
        at = float("inf") if at_ms is None else at_ms
        found = [v for v in self.dated(versions) if v.effective_ms <= at]
        return found[-1] if found else self.baseline(versions)

    def route(self, model: str, at_ms: int | float | None) -> Route | None:
        """The route with the greatest start in force; the first of equal starts."""
        at, best = float("inf") if at_ms is None else at_ms, None
        for r in self.routes.get(normal(model), []):
            start = float("-inf") if r.effective_ms is None else r.effective_ms
            if start <= at and (best is None or start > (float("-inf") if best.effective_ms is None else best.effective_ms)):
                best = r
        return best

    # -- digest, metadata --------------------------------------------------------------------------------------

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.to_json(), sort_keys=True).encode()).hexdigest()

    def metadata(self) -> dict:
        active = [v for vs in self.models.values() for v in vs if v.superseded_by is None]
        dates = sorted(v.effective_ms for v in active if v.effective_ms is not None)
        thresholds = {v.threshold for v in active if v.threshold is not None}
        return {
            "mode": "event-time",
            "currency": self.currency,
            "basis": self.basis,
            "checkedAt": self.checked_at,
            "latestEffectiveFrom": to_iso(dates[-1]) if dates else None,
            "longContextThresholdTokens": thresholds.pop() if len(thresholds) == 1 else None,
            "provisionalVersionCount": sum(v.provisional for v in active),
            "pricedModels": sorted({*self.models, *self.aliases}),
            "assumedModels": [
                {"model": m, "assumedModel": rs[-1].model, "upperBoundModel": rs[-1].upper_model, "label": rs[-1].label, "routes": [asdict(r) for r in rs]}
                for m, rs in sorted((m, sorted(rs, key=lambda r: r.effective_ms or 0)) for m, rs in self.routes.items() if rs)
            ],
        }

    # -- JSON --------------------------------------------------------------------------------------------------

    def to_json(self) -> dict:
        def rates(values) -> dict:
            return {_JSON_RATES[n]: v for n, v in zip(RATE_NAMES, values, strict=True) if v is not None}

        models = {}
        for model, versions in self.models.items():
            out = []
            for v in versions:
                row = {"id": v.id, "effectiveFrom": to_iso(v.effective_ms), "provisional": v.provisional, "serviceTier": "standard", **rates((v.input, v.cached, v.write, v.output))}
                if v.long:
                    row |= {"longContextThresholdTokens": v.threshold, "longContext": rates(v.long)}
                row |= {k: x for k, x in (("sourceUrl", v.source_url), ("observedAt", to_iso(v.observed_ms)), ("contentHash", v.content_hash), ("evidenceLevel", v.evidence), ("supersededBy", v.superseded_by)) if x is not None}
                out.append(row)
            models[model] = {"versions": out}
        routes = {m: [{"id": r.id, "effectiveFrom": to_iso(r.effective_ms), "model": r.model, "upperBoundModel": r.upper_model, "label": r.label, "sourceUrl": r.source_url, "evidenceLevel": r.evidence} for r in rs] for m, rs in self.routes.items()}
        return {"schemaVersion": SCHEMA_VERSION, "currency": self.currency, "basis": self.basis, "checkedAt": self.checked_at, "aliases": self.aliases, "assumedRoutes": routes, "models": models}

    @classmethod
    def from_json(cls, data: dict) -> Catalog:
        """A catalog of schema 2, or of the flat schema 1 (one undated, provisional version per model)."""
        if not isinstance(data, dict) or not isinstance(data.get("models"), dict):
            raise ValueError("a price catalog needs models")
        schema = data.get("schemaVersion", 1)
        if schema not in (1, SCHEMA_VERSION):
            raise ValueError(f"unsupported catalog schema {schema}")

        def version(model: str, row: dict, flat: bool = False) -> Version:
            if row.get("serviceTier", "standard") != "standard":
                raise ValueError(f"{model}: only standard prices are supported")
            long = row.get("longContext")
            return Version(
                id=row.get("id") or (f"{model}-legacy" if flat else ""),
                effective_ms=to_ms(row.get("effectiveFrom")),
                provisional=bool(row.get("provisional", flat)),
                input=row.get("input"), output=row.get("output"), cached=row.get("cachedInput"), write=row.get("cacheWrite"),
                long=(long.get("input"), long.get("cachedInput"), long.get("cacheWrite"), long.get("output")) if long else None,
                threshold=row.get("longContextThresholdTokens") if long else None,
                observed_ms=to_ms(row.get("observedAt")), superseded_by=row.get("supersededBy"), source_url=row.get("sourceUrl"), content_hash=row.get("contentHash"), evidence=row.get("evidenceLevel"),
            )

        models = {}
        for name, entry in data["models"].items():
            model = normal(name)
            rows = [version(model, r) for r in entry.get("versions", [])] if schema == SCHEMA_VERSION else [version(model, entry, flat=True)]
            if len({v.id for v in rows}) != len(rows):
                raise ValueError(f"{model}: version ids repeat")
            models[model] = rows
        routes = {}
        for name, rows in (data.get("assumedRoutes") or {}).items():
            if not all(r.get("model") and r.get("upperBoundModel") for r in rows):
                raise ValueError(f"{name}: a route needs a model and an upper-bound model")
            routes[normal(name)] = [Route(r.get("id") or f"{normal(name)}-{r.get('effectiveFrom') or 'baseline'}", to_ms(r.get("effectiveFrom")), normal(r["model"]), normal(r["upperBoundModel"]), r.get("label"), r.get("sourceUrl"), r.get("evidenceLevel") or "assumption") for r in rows]
        return cls(models, {normal(a): normal(b) for a, b in (data.get("aliases") or {}).items()}, routes, data.get("checkedAt"), data.get("currency", "USD"), data.get("basis", cls.basis))


def built_in() -> Catalog:
    out = Catalog(aliases=dict(builtin.ALIASES))
    for model, id_, start, provisional, i, c, w, o, li, lc, lw, lo, threshold in builtin.VERSIONS:
        out.models.setdefault(model, []).append(Version(id_, to_ms(start), provisional, i, o, c, w, (li, lc, lw, lo) if li else None, threshold))
    for model, id_, start, target, upper, label, evidence in builtin.ROUTES:
        out.routes.setdefault(model, []).append(Route(id_, to_ms(start), target, upper, label, None, evidence))
    return out


_LONG = ("long input", "long cached", "long write", "long output", "threshold")
_WRITE = ("write", "long write")


def _flat(v: Version) -> dict[str, float | None]:
    base, long = ("input", "cached", "write", "output"), v.long or (None,) * 4
    return {**{n: getattr(v, n) for n in base}, **dict(zip(_LONG, (*long, v.threshold), strict=True))}


def _completes(formal: Version, seen: Version) -> bool:
    """``seen`` has the rates of ``formal``, or was read from the very same page with either its long-context rates or its
    cache-write rates overlooked. From any other page, rates that differ are a change of price.
    """
    mine, theirs = _flat(formal), _flat(seen)
    differ = {n for n in mine if mine[n] != theirs[n]}
    if not differ:
        return True
    same_page = formal.content_hash is not None and formal.content_hash == seen.content_hash and formal.effective_ms is not None
    if not same_page or any(theirs[n] is not None for n in differ):
        return False
    no_long = seen.long is None and seen.threshold is None and formal.long is not None and formal.threshold is not None
    return (no_long and differ <= set(_LONG)) or ("write" in differ and differ <= set(_WRITE))


# --- how catalogs change ------------------------------------------------------------------------------------------


def _formal(v: Version) -> bool:
    return not v.provisional and v.superseded_by is None


def _tentative(v: Version) -> bool:
    """Seen at some time, and not (yet) announced."""
    return v.provisional and v.effective_ms is not None


def _same_price(there: Version, coming: Version) -> bool:
    return there.rates() == coming.rates()


def _same_start(there: Version, coming: Version) -> bool:
    return there.effective_ms == coming.effective_ms


Pair = Callable[[Version, Version], bool]


@dataclass(frozen=True)
class Policy:
    """What a version that comes in means to those of its model that are there, as tests of pairs (there, coming)."""

    known: Pair = lambda there, coming: False  # nothing new comes in
    outdone: Pair = lambda there, coming: False  # the coming one is superseded from the start
    outdated: Pair = lambda there, coming: False  # the one that is there is superseded


#: What another catalog saw joins this one.
MERGING = Policy(
    known=lambda there, coming: there.id == coming.id or (coming.effective_ms is None and _same_price(there, coming)),
    outdone=lambda there, coming: _formal(there) and _tentative(coming) and coming.superseded_by is None and _completes(there, coming) and (there.effective_ms or 0) <= coming.effective_ms,
)
#: A page shows prices; only the latest version is asked.
OBSERVING = Policy(known=_same_price)
#: Prices are announced from a day on: they replace the same prices where these were only seen, and other prices of that day.
ANNOUNCING = Policy(
    known=lambda there, coming: _formal(there) and _same_start(there, coming) and _same_price(there, coming),
    outdated=lambda there, coming: _tentative(there) if _same_price(there, coming) else _same_start(there, coming),
)


def version_id(model: str, how: str, when: str, found: Version) -> str:
    """The one form of ids that this module gives."""
    return "/".join([model, how, when, *([found.content_hash[:8]] if found.content_hash else [])])


def admitted(there: list[Version], coming: Version, policy: Policy, judges: list[Version] | None = None) -> tuple[list[Version], Version | None]:
    """The versions of a model once another one came, and that one as it was taken (None: it was known). ``judges``: those that
    are asked (all).
    """
    asked = there if judges is None else judges
    if any(policy.known(v, coming) for v in asked):
        return there, None
    by = [v.id for v in asked if policy.outdone(v, coming)]
    taken = replace(coming, superseded_by=by[0]) if by else coming
    return [replace(v, superseded_by=taken.id) if policy.outdated(v, taken) else v for v in there] + [taken], taken


def merge(seed: Catalog, runtime: Catalog | None) -> Catalog:
    """All versions of both; where both have an id, or an undated price, the seed's stays."""
    if runtime is None:
        return seed
    models = dict(seed.models)
    for model, more in runtime.models.items():
        own = seed.models.get(model, [])
        for v in more:
            rows = models.get(model, [])
            # Only the seed's announcements decide over what was seen; what is known is known from either.
            coming = None if any(MERGING.known(x, v) for x in rows) else admitted(own, v, MERGING)[1]
            models[model] = [*rows, *([coming] if coming else [])]
    dates = [c.checked_at for c in (seed, runtime) if c.checked_at]
    return replace(seed, models=models, checked_at=max(dates) if dates else None)


def observe(catalog: Catalog, model: str, found: Version, now_ms: int) -> Version | None:
    """Take prices just seen on a page as in force from now on; None if they are the current ones."""
    name = normal(model)
    latest = catalog.price(name, None)
    seen = replace(found, id=version_id(name, "seen", to_iso(now_ms), found), effective_ms=now_ms, observed_ms=now_ms, provisional=True, evidence="first-observed")
    catalog.models[name], taken = admitted(catalog.models.get(name, []), seen, OBSERVING, [latest] if latest else [])
    return taken


def verify(catalog: Catalog, model: str, found: Version, effective_from: str, source_url: str, now_ms: int) -> tuple[Version, bool]:
    """Take announced prices from a day on: the version that then holds, and whether anything changed."""
    for text, form, what in ((effective_from, r"\d{4}-\d{2}-\d{2}", "the effective date must be YYYY-MM-DD"), (source_url, r"https://[^/]+.*", "the source must be an https address")):
        if not re.fullmatch(form, text or ""):
            raise ValueError(what)
    name = normal(model)
    there = catalog.models.get(name, [])
    coming = replace(found, id=version_id(name, "from", effective_from, found), effective_ms=to_ms(effective_from), provisional=False, observed_ms=now_ms, source_url=source_url, evidence="verified")
    catalog.models[name], taken = admitted(there, coming, ANNOUNCING)
    if taken is None:
        return next(v for v in there if ANNOUNCING.known(v, coming)), False
    catalog.checked_at = to_iso(now_ms)
    return taken, True


def read_cache(path: str, keep_corrupt: bool = True) -> Catalog | None:
    """The cached catalog; a damaged file is put aside and ignored."""
    try:
        with open(path, encoding="utf-8") as f:
            return Catalog.from_json(json.load(f))
    except FileNotFoundError:
        return None
    except (ValueError, TypeError, AttributeError):
        if keep_corrupt:
            os.replace(path, f"{path}.corrupt-{int(time.time() * 1000)}")
        return None


def write_cache(path: str, catalog: Catalog, wait_s: float = 5.0) -> Catalog:
    """Merge into the cache under a lock file and replace it at once."""
    lock, until = f"{path}.lock", time.monotonic() + wait_s
    while True:
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.monotonic() > until:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(0.05)
    try:
        merged = merge(catalog, read_cache(path))
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(merged.to_json(), f, indent=2)
        os.replace(temporary, path)
        return merged
    finally:
        os.unlink(lock)

"""The usage query end to end: events, dedupe, time filter, pricing, aggregation, payload."""

from __future__ import annotations

import shutil
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.usage import in_range
from ..operators import aggregate as A
from ..operators.canonical import canonical
from ..options import UsageQuery
from ..pricing.catalog import Catalog, built_in, to_iso
from ..pricing.spans import priced
from ..sources.logs import failures_of, list_logs, scratch_folder
from ..sources.parse import records, settled, usage_events
from ..sources.ranges import RANGE_BYTES, file_state, read_lines


@dataclass
class Scan:
    """Events and file counts of a set of logs, and the files that could not be read."""

    events: DataFrame
    files: DataFrame
    failures: list[dict]
    paths: list[str]
    #: Where what was read is kept; ``done`` deletes it.
    folder: str

    def done(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def scan(spark: SparkSession, roots: list[str], range_bytes: int = RANGE_BYTES) -> Scan:
    """Read all logs below the roots; a file that cannot be read fails as a whole and the others still count.

    Files are read once, a task a range: marked lines and their parsed rows are written tables, from which all else comes.
    """
    paths, folder = list_logs(roots), scratch_folder(spark, "scan")
    lines = settled(read_lines(spark, [(p, 0, file_state(p)["size"], None) for p in paths], range_bytes), f"{folder}/lines")
    failures = [{"path": r.file_path, "code": r.code, "message": r.message, "usingPreviousIndex": False} for r in failures_of(lines).orderBy("file_path").collect()]
    good = lines.where("status IS NULL")
    if failures:
        bad = spark.createDataFrame([(f["path"],) for f in failures], "file_path string")
        good = good.join(bad, "file_path", "left_anti")
    events, files = usage_events(settled(records(good), f"{folder}/records"))
    return Scan(events, files, failures, paths, folder)


def costed(events: DataFrame, query: UsageQuery, catalog: Catalog) -> DataFrame:
    """Representatives are chosen before the time filter; the filter then runs below pricing."""
    kept = canonical(events, query.dedupe).where(in_range(F.col("timestamp_ms"), query.from_ms, query.to_ms))
    return priced(kept, events.sparkSession, catalog)


def _plain(row) -> dict:
    return row.asDict(recursive=True)


def payload(events: DataFrame, query: UsageQuery, catalog: Catalog | None = None, files: DataFrame | None = None, failures: list[dict] | None = None, paths: list[str] | None = None, slice_: DataFrame | None = None) -> dict:
    """Totals, rows, model rollups, statistics and price facts as plain data (only aggregated rows reach the driver)."""
    catalog = catalog or built_in()
    own = slice_ is None
    rows = costed(events, query, catalog).persist() if own else slice_
    try:
        total = _plain(A.totals(rows).first())
        groups = A.grouped(rows, query)
        found = [_plain(r) for r in A.ordered(groups, query).collect()]
        count = len(found) if not query.limit or len(found) < query.limit else groups.count()
        assumed = [_plain(r) for r in A.assumed_models(rows).collect()]
        unpriced = [_plain(r) for r in A.unpriced_models(rows).collect()]
    finally:
        if own:
            rows.unpersist()
    kept = canonical(events, query.dedupe)
    unknown = _plain(A.unknown_times(kept, query.bounded).first())
    stats = _plain(A.file_stats(files).first()) if files is not None else {}
    stats |= {"global_duplicate_token_events": (events.count() - kept.count()) if query.dedupe == "global" else 0}
    stats |= {"unknown_timestamp_events": unknown["events"], "unknown_timestamp_tokens": unknown["tokens"], "excluded_unknown_timestamp_events": unknown["excluded_events"], "excluded_unknown_timestamp_tokens": unknown["excluded_tokens"]}
    if paths is not None:
        stats |= {"files": len(paths), "failed_files": len(failures or [])}
    return {
        "source": list(query.roots),
        "range": {"from": to_iso(query.from_ms), "to": to_iso(query.to_ms)},
        "timezone": query.timezone,
        "group": query.group,
        "sort": query.sort_name,
        "desc": query.descending,
        "sourceScope": query.scope,
        "dedupeScope": query.dedupe,
        "totals": total,
        "rows": found,
        "rowCount": count,
        "assumedModels": assumed,
        "unpricedModels": unpriced,
        "stats": stats,
        "index": {"incomplete": bool(failures), "failedFiles": len(failures or []), "failures": failures or []},
        "pricing": catalog.metadata(),
    }


def run(spark: SparkSession, query: UsageQuery, catalog: Catalog | None = None) -> dict:
    """Direct scan of the query's roots."""
    read = scan(spark, list(query.roots))
    events = read.events.persist()
    try:
        return payload(events, query, catalog, read.files, read.failures, read.paths)
    finally:
        events.unpersist()
        read.done()

"""Incremental index: sorted runs of Parquet tables behind numbered manifests.

A refresh compares the listing with the newest manifest, reads what changed (of a plain log that grew only the new bytes)
and adds one run with what is new: parsed rows, parser states, events, and the representatives of the fingerprints that
changed. Nothing that other runs hold is rewritten, so a refresh writes in proportion to the change. What a replaced, grown or
deleted file left in older runs is void: the manifest says from which run on a file's rows count, and readers leave the rest
out; of representatives the newest run's count. When runs become many, the newest ones of similar size are merged into one
(each row is rewritten a logarithmic number of times), and what is void goes.

A grown file goes on from its parser state: its new events need the merged state of its segments and its earlier
counters, nothing else. If the new bytes bring context that earlier events lacked, the file's events are made anew from its
stored rows.

The tables of a run lie in buckets whose number follows from the run's rows: events by file and place, representatives by
fingerprint. A directory with a Bloom filter of the fingerprints of each bucket tells which buckets can hold the changed ones;
only these are read.

A manifest is published by linking it under the next number, which fails if another writer was first. A file that fails,
or changes while it is read, keeps its previous events and is retried once it changes (or on request).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.usage import local_time
from ..operators.canonical import canonical, changed_keys
from ..schemas import COUNTERS, FILES, USAGE_EVENTS
from ..sources.logs import SUFFIXES, list_logs
from ..sources.parse import STATE, TOTALS, carried_in, events_of, file_counts, first_of_repeats, merged_states, records, segment_states
from ..sources.ranges import LINES, combined, file_state, read_lines

SCHEMA, PARSER = 5, 2
#: Manifests that stay; runs from which on some are merged; how much larger a run may be than all newer ones to be merged too.
KEEP, RUNS, FACTOR = 2, 8, 2
#: Rows of a bucket, events of a file that lie together, bits of the directory for each fingerprint.
BUCKET_ROWS, TOGETHER, BITS = 200_000, 50_000, 16
#: Rows up to which a list (of files, of fingerprints) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
KEYS = "total_usage_key string"
SLOT_MS = 900_000
SLOTS = "slot_ms long, model string, cwd string, session_id string, requests long, " + ", ".join(f"{c} long" for c in COUNTERS)
_UUID = re.compile(r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$", re.I)


class Conflict(RuntimeError):
    """Another writer published first."""


class Aborted(RuntimeError):
    """The refresh was called off; nothing was published."""


def identity(path: str) -> str:
    """Where a log, its compressed replacement and its copy in another folder agree: the UUID at the end of the name, or
    else the path.
    """
    plain = path.removesuffix(".zst")
    found = _UUID.search(plain)
    return found[1].lower() if found else plain


def same_state(a: dict | None, b: dict) -> bool:
    return bool(a) and a.get("parser") == PARSER and abs(a["mtime_ms"] - b["mtime_ms"]) <= 0.001 and all(a[k] == b[k] for k in ("size", "dev", "ino"))


def span_of(path: str, known: dict | None, state: dict) -> tuple[str, int, int | None, str | None]:
    """The bytes to read of a changed file: those after the last whole line, if a plain file has grown, or all."""
    if path.endswith(".zst"):
        return path, 0, None, None
    grown = known and known.get("parser") == PARSER and state["size"] > known["size"] and all(known[k] == state[k] for k in ("dev", "ino"))
    return (path, known["offset"], state["size"], known["boundary"]) if grown else (path, 0, state["size"], None)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key), F.lit(buckets)).cast("int")


def event_place() -> Column:
    """Which events of a file lie in one bucket."""
    return F.concat("file_path", F.lit("#"), F.floor(F.col("event_index") / TOGETHER))


def event_buckets(path: str, events: int, buckets: int) -> set[int]:
    return {zlib.crc32(f"{path}#{i}".encode()) % buckets for i in range(-(-events // TOGETHER))}


def slots(events: DataFrame, sign: int) -> DataFrame:
    """Requests and counters (or what to take back of them) by quarter of an hour, which no time zone cuts."""
    slot = (F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(SLOT_MS))).alias("slot_ms")
    rows = events.groupBy(slot, "model", "cwd", "session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in COUNTERS))
    return rows.select("slot_ms", "model", "cwd", "session_id", *((F.col(c) * sign).alias(c) for c in ("requests", *COUNTERS)))


def summed(rows: DataFrame) -> DataFrame:
    """Slots of several refreshes as one; those that came to nothing go."""
    return rows.groupBy("slot_ms", "model", "cwd", "session_id").agg(*(F.sum(c).alias(c) for c in ("requests", *COUNTERS))).where("requests <> 0")


def _flags_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(4)])


def bloom_filters(rows: DataFrame) -> DataFrame:
    """``bucket, bits`` over the ``total_usage_key`` of rows that have a ``bucket``."""

    def build(group: pa.Table) -> pa.Table:
        hashes = group.column("h").to_numpy()
        bits = max(64, 1 << (len(hashes) * BITS - 1).bit_length())
        flags = np.zeros(bits, bool)
        flags[_flags_of(hashes, bits).astype(np.int64)] = True
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    return rows.select("bucket", F.xxhash64("total_usage_key").alias("h")).groupBy("bucket").applyInArrow(build, "bucket int, bits binary")


def may_hold(directory: DataFrame, hashes: np.ndarray) -> list[int]:
    """The buckets whose filter holds any of the hashes (at most as many as there are buckets)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flags = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
                if flags[_flags_of(hashes, len(flags)).astype(np.int64)].all(axis=0).any():
                    out.append(bucket)
            yield pa.record_batch([pa.array(out, pa.int32())], names=["bucket"])

    return [r.bucket for r in directory.select("bucket", "bits").mapInArrow(test, "bucket int").collect()]


class UsageIndex:
    """``folder`` holds numbered manifests and a folder of tables for each run."""

    def __init__(self, spark: SparkSession, folder: str, scan: Callable[[SparkSession, list[tuple]], DataFrame] = read_lines):
        self.spark, self.folder, self._scan = spark, folder, scan
        self._lock, self._guard, self._jobs = threading.Lock(), threading.Lock(), {}
        self._stop, self._tag = threading.Event(), f"refresh-{uuid.uuid4().hex}"
        self._schemas = {"events": USAGE_EVENTS, "canonical": USAGE_EVENTS, "states": STATE, "keys": KEYS, "slots": SLOTS}
        self._scopes: dict = {}
        os.makedirs(folder, exist_ok=True)

    # -- reading -----------------------------------------------------------------------------------------------

    def _revisions(self) -> list[int]:
        return sorted(int(m[1]) for m in map(re.compile(r"manifest-(\d+)\.json").fullmatch, os.listdir(self.folder)) if m)

    def manifest(self) -> dict:
        found = self._revisions()
        if not found:
            return {"schema": SCHEMA, "revision": 0, "files": {}, "failures": {}, "runs": [], "void": {}}
        with open(f"{self.folder}/manifest-{found[-1]}.json", encoding="utf-8") as f:
            newest = json.load(f)
        if newest["schema"] > SCHEMA:
            raise RuntimeError(f"the index has schema {newest['schema']}, this version reads {SCHEMA}")
        if newest["schema"] < SCHEMA:  # rebuilt in full at the next refresh
            newest = {"schema": SCHEMA, "revision": newest["revision"], "files": {}, "failures": newest["failures"], "runs": [], "void": {}}
        return newest

    def _schema(self, name: str):
        if name not in self._schemas:
            self._schemas[name] = records(self.spark.createDataFrame([], LINES)).schema
        return self._schemas[name]

    def _table(self, run: dict, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A table of a run, or those of its buckets; None if there is nothing."""
        own = run["tables"].get(name)
        if own is None:
            return None
        found = [f"{self.folder}/{run['id']}/{name}/bucket={b}" for b in own["buckets"] if buckets is None or b in buckets]
        return self.spark.read.schema(self._schema(name)).parquet(*found) if found else None

    def _union(self, name: str, parts: list[DataFrame | None]) -> DataFrame:
        found = [p for p in parts if p is not None]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self._schema(name))

    def _listed(self, values: list[str], column: str) -> DataFrame:
        rows = self.spark.createDataFrame(pa.table({column: pa.array(values, pa.string())}))
        return F.broadcast(rows) if len(values) <= BROADCAST_ROWS else rows

    def _valid(self, manifest: dict, name: str, only: list[str] | None = None, runs: list[dict] | None = None, where: Callable[[dict], set[int] | None] = lambda _: None) -> DataFrame:
        """The rows of ``records``, ``states`` or ``events`` that count, of all files or of ``only`` some (of buckets that ``where`` names)."""
        kind = "records" if name == "records" else "events"
        parts, only = [], None if only is None else set(only)
        for run in manifest["runs"] if runs is None else runs:
            rows = self._table(run, name, where(run))
            if rows is None:
                continue
            void = [p for p, since in manifest["void"].items() if run["seq"] < since[kind]]
            if only is not None:
                kept = sorted(only.difference(void))
                if not kept:
                    continue
                if len(kept) <= 100:
                    rows = rows.where(F.col("file_path").isin(kept))  # reaches the statistics of the files
                else:
                    rows = rows.join(self._listed(kept, "file_path"), "file_path", "left_semi")
            elif void:
                rows = rows.join(self._listed(void, "file_path"), "file_path", "left_anti")
            if name == "records":  # a line without an end is read again when its file grows
                newer = [p for p, s in manifest["files"].items() if s.get("last", 0) > run["seq"] and (only is None or p in only)]
                if newer and run["tables"]["records"].get("unended"):
                    ended = rows.where("NOT unterminated")
                    rows = ended.unionByName(rows.where("unterminated").join(self._listed(newer, "file_path"), "file_path", "left_anti"))
            parts.append(rows)
        return self._union(name, parts)

    def events(self, manifest: dict | None = None) -> DataFrame:
        return self._valid(manifest or self.manifest(), "events")

    def canonical(self, manifest: dict | None = None, keys: DataFrame | None = None, runs: list[dict] | None = None) -> DataFrame:
        """Representatives: a run's rows count unless a newer run has their fingerprint among its changed ones. ``keys`` picks some."""
        runs = (manifest or self.manifest())["runs"] if runs is None else runs
        hashes = self._hashes(keys) if keys is not None else None
        parts, newer, n = [], None, 0
        for run in reversed(runs):
            rows = self._table(run, "canonical", self._holding(run, "canonical", hashes) if hashes is not None else None)
            if rows is not None:
                if keys is not None:
                    rows = rows.join(keys, "total_usage_key", "left_semi")
                if newer is not None:
                    rows = rows.join(F.broadcast(newer) if n <= BROADCAST_ROWS else newer, "total_usage_key", "left_anti")
                parts.append(rows)
            own = self._table(run, "keys")
            if own is not None:
                newer, n = own if newer is None else newer.unionByName(own), n + run["tables"]["keys"]["rows"]
        return self._union("canonical", parts)

    def slots(self, manifest: dict | None = None) -> DataFrame:
        """Requests and counters of the representatives by quarter of an hour, model, directory and session: the sums of what all
        refreshes added and took back, so the events are not read.
        """
        return summed(self._union("slots", [self._table(r, "slots") for r in (manifest or self.manifest())["runs"]]))

    def usage(self, group: str, timezone: str = "UTC", manifest: dict | None = None) -> DataFrame:
        """``key, sessions, requests`` and counters by day or month (of any time zone), model, directory or session."""
        key = {"day": lambda: local_time(F.col("slot_ms"), timezone, "day"), "month": lambda: local_time(F.col("slot_ms"), timezone, "month"), "model": lambda: F.col("model"), "cwd": lambda: F.col("cwd"), "session": lambda: F.col("session_id")}[group]()
        return self.slots(manifest).groupBy(key.alias("key")).agg(F.count_distinct("session_id").alias("sessions"), F.sum("requests").alias("requests"), *(F.sum(c).alias(c) for c in COUNTERS))

    def files(self, manifest: dict | None = None) -> DataFrame:
        return file_counts(self._valid(manifest or self.manifest(), "states")).select(*FILES.names)

    def _hashes(self, keys: DataFrame) -> np.ndarray | None:
        """Hashes of changed fingerprints, if they are few enough for the directory to be of use."""
        rows = keys.select(F.xxhash64("total_usage_key").alias("h")).limit(BROADCAST_ROWS + 1).toArrow()
        return rows.column("h").to_numpy() if rows.num_rows <= BROADCAST_ROWS else None

    def _holding(self, run: dict, name: str, hashes: np.ndarray | None) -> set[int] | None:
        """The buckets of a run's table that may hold the hashes; None: any."""
        if hashes is None or not run["tables"].get(name, {}).get("directory"):
            return None
        return set(may_hold(self.spark.read.schema("bucket int, bits binary").parquet(f"{self.folder}/{run['id']}/{name}-directory"), hashes))

    def fingerprint(self, roots: list[str], manifest: dict | None = None) -> str:
        """Of the files of a scope, their failures and the rules that made their rows; equal as long as nothing below the roots
        changed (no roots: anything). Worked out once for each revision."""
        m = manifest or self.manifest()
        key = (m["revision"], tuple(roots))
        if key not in self._scopes:
            inside = lambda p: not roots or _inside(p, roots)
            mine = sorted((p, s["size"], s["mtime_ms"]) for p, s in m["files"].items() if inside(p))
            failed = sorted((p, f["code"]) for p, f in m["failures"].items() if inside(p))
            self._scopes = {k: v for k, v in self._scopes.items() if k[0] >= m["revision"] - KEEP}
            self._scopes[key] = hashlib.sha256(json.dumps([SCHEMA, PARSER, mine, failed]).encode()).hexdigest()
        return self._scopes[key]

    def status(self) -> dict:
        m = self.manifest()
        return {"revision": m["revision"], "files": len(m["files"]), "failedFiles": len(m["failures"]), "failures": [{"path": p, **f} for p, f in sorted(m["failures"].items())], "incomplete": bool(m["failures"]), "running": self._lock.locked()}

    # -- refreshing --------------------------------------------------------------------------------------------

    def refresh(self, roots: list[str], retry_failures: bool = False, progress: Callable[[dict], None] | None = None, only: list[str] | None = None) -> dict:
        """Bring the index up to date: all below the roots, or ``only`` some files (then nothing is listed and nothing is taken to
        be gone). Calls for the same at the same time share one job; others take turns.
        """
        key = (tuple(roots), retry_failures, None if only is None else tuple(only))
        with self._guard:
            job = self._jobs.get(key)
            mine = job is None
            if mine:
                job = self._jobs[key] = Future()
        if not mine:
            return job.result()
        try:
            with self._lock:
                self._stop.clear()
                self.spark.sparkContext.addJobTag(self._tag)
                try:
                    job.set_result(self._refresh(roots, retry_failures, progress or (lambda _: None), only))
                finally:
                    self.spark.sparkContext.removeJobTag(self._tag)
        except BaseException as e:
            job.set_exception(Aborted("the refresh was called off") if self._stop.is_set() else e)
        finally:
            with self._guard:
                del self._jobs[key]
        return job.result()

    def abort(self) -> None:
        """Call off a running refresh; publication is its last step, so nothing of it stays."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def _refresh(self, roots: list[str], retry: bool, progress: Callable[[dict], None], only: list[str] | None = None) -> dict:
        progress({"phase": "discover"})
        base = self.manifest()
        known, failed = base["files"], dict(base["failures"])
        seen, spans = {}, []
        for path in list_logs(roots) if only is None else sorted(set(only)):
            try:
                seen[path] = {**file_state(path), "parser": PARSER}
            except FileNotFoundError:
                continue
            waits = path in failed and not retry and same_state(failed[path].get("state"), seen[path])
            if not waits and (path in failed or not same_state(known.get(path), seen[path])):
                spans.append(span_of(path, known.get(path), seen[path]))
        progress({"phase": "scan", "pendingFiles": len(spans), "newFiles": sum(s[0] not in known for s in spans), "grownFiles": sum(s[1] > 0 for s in spans), "unchangedFiles": len(seen) - len(spans)})
        out = f"{self.folder}/v-{base['revision'] + 1}-{uuid.uuid4().hex[:8]}"
        try:
            ends = self._stage(out, "lines", spans) if spans else {}
            if again := [(p, 0, seen[p]["size"], None) for p, s in ends.items() if s.get("code") == "LOG_REPLACED"]:
                ends |= self._stage(out, "again", again)
            for path, status in ends.items():
                if "code" in status:
                    failed[path] = {"code": status["code"], "message": status["message"], "state": seen[path]}
                else:
                    failed.pop(path, None)
            failed = {p: f for p, f in failed.items() if p in seen or p in known or only is not None or not _inside(p, roots)}
            # A compressed or moved copy that failed keeps the events of the file it replaced.
            kept = {identity(p) for p in failed}
            gone = {p for p in known if only is None and _inside(p, roots) and p not in seen and identity(p) not in kept}
            held = {identity(k) for k in known} if failed else set()
            failed = {p: f | {"usingPreviousIndex": identity(p) in held} for p, f in failed.items() if p not in gone}
            ends = {p: s for p, s in ends.items() if "code" not in s}
            if not ends and not gone and failed == base["failures"]:
                shutil.rmtree(out, ignore_errors=True)
                return base
            manifest = self._write(out, base, seen, ends, gone)
            manifest["failures"] = failed
            progress({"phase": "publish", "files": len(manifest["files"]), "failedFiles": len(failed)})
            if self._stop.is_set():
                raise Aborted
            self._publish(manifest)
            return manifest
        except BaseException:
            shutil.rmtree(out, ignore_errors=True)
            shutil.rmtree(f"{out}-m", ignore_errors=True)
            raise

    def _stage(self, out: str, name: str, spans: list[tuple]) -> dict[str, dict]:
        """Read the spans into a table of lines; what the statuses of each file's ranges come to."""
        self._scan(self.spark, spans).write.parquet(f"{out}/{name}")
        rows = self.spark.read.schema(LINES).parquet(f"{out}/{name}").where("status IS NOT NULL").groupBy("file_path").agg(F.collect_list("status").alias("all")).toLocalIterator()
        return {r.file_path: combined(r.file_path, [json.loads(x) for x in r.all]) for r in rows}

    def _write(self, out: str, base: dict, seen: dict, ends: dict[str, dict], gone: set[str]) -> dict:
        """Write a run and return the manifest that adds it (merged with others if there are many)."""
        spark, seq, known = self.spark, base["revision"] + 1, base["files"]
        run = {"id": os.path.basename(out), "seq": seq, "tables": {}}
        grown = sorted(p for p, s in ends.items() if s["from"] > 0)
        lines = spark.read.schema(LINES).parquet(*(f"{out}/{n}" for n in ("lines", "again") if os.path.isdir(f"{out}/{n}"))) if ends else spark.createDataFrame([], LINES)
        good = lines.where("status IS NULL").join(self._listed(sorted(ends), "file_path"), "file_path", "left_semi")
        fresh = self._put(run, "records", records(good), None)
        counted = fresh.agg(F.count_if("unterminated").alias("unended")).first()
        run["tables"]["records"]["unended"] = counted.unended or 0
        first = first_of_repeats(fresh)
        states = segment_states(fresh, first)
        earlier, reopened = None, []
        if grown:
            earlier = self._settled(out, "earlier", merged_states(self._valid(base, "states", grown)))
            reopened = self._reopened(earlier, states)
        went_on, anew = set(grown), set(reopened)
        replaced = {p for p in ends if p in known and p not in went_on}
        void = {p: dict(v) for p, v in base["void"].items()}
        for p in [*gone, *replaced, *reopened]:
            void[p] = {"events": seq, "records": void.get(p, {}).get("records", 0) if p in anew else seq}
        files = {p: s for p, s in known.items() if p not in gone} | {p: seen[p] | {"offset": s["offset"], "boundary": s["boundary"], "last": seq} for p, s in ends.items()}
        after = {"files": files, "void": void, "runs": [*base["runs"], run]}

        if grown:
            # Files that go on as they were: their new rows, after the merged state and without counters that they had.
            on = sorted(went_on - anew)
            numbers = F.split(F.substring_index("total_usage_key", ":", -1), ",")
            buckets = lambda r: self._buckets_of(r, base, on)
            had = self._valid(base, "events", on, where=buckets).select("file_path", *(numbers[i].cast("long").alias(t) for i, t in enumerate(TOTALS))) if on else None
            rows = fresh.join(self._listed(reopened, "file_path"), "file_path", "left_anti") if reopened else fresh
            if reopened:
                rows = rows.unionByName(self._valid(after, "records", reopened))
                earlier = earlier.join(self._listed(reopened, "file_path"), "file_path", "left_anti")
            first = self._settled(out, "kept", first_of_repeats(rows, had))
            states = segment_states(rows, first)
        self._put(run, "states", states, None)
        new = self._table(run, "states")
        carried = carried_in((new if earlier is None else earlier.unionByName(new)) if new is not None else spark.createDataFrame([], STATE))
        events = 0
        for r in new.groupBy("file_path").agg(F.sum("kept").alias("n")).collect() if new is not None else []:  # changed files only
            files[r.file_path]["events"] = r.n + (known[r.file_path].get("events", 0) if r.file_path in went_on and r.file_path not in anew else 0)
            events += r.n
        added = self._put(run, "events", events_of(first, carried), event_place(), ["file_path", "event_index"], events)

        # Fingerprints that gained or lost events: where some were lost, all that is left of them is ranked again.
        left = sorted({p for p in [*gone, *replaced, *reopened] if p in known})
        lost = self._valid(base, "events", left, where=lambda r: self._buckets_of(r, base, left)) if left else spark.createDataFrame([], USAGE_EVENTS)
        lost = self._settled(out, "lost", lost.select("total_usage_key").distinct())
        keys = self._put(run, "keys", changed_keys(lost, added), F.col("total_usage_key"))
        hashes = self._hashes(lost)
        older = [r for r in base["runs"]]
        rest = self._union("events", [self._valid(after, "events", runs=[r], where=lambda r: self._holding(r, "events", hashes)) for r in older]).join(lost, "total_usage_key", "left_semi") if left else None
        before = self._settled(out, "before", self.canonical(keys=keys, runs=older)) if older else None
        current = before.join(lost, "total_usage_key", "left_anti") if older else None
        chosen = canonical(self._union("events", [added, rest, current]))
        now = self._put(run, "canonical", chosen.select(*USAGE_EVENTS.names), F.col("total_usage_key"), ["total_usage_key"])
        # What left the representatives is taken back, what joined them is added.
        moved = slots(now if now is not None else spark.createDataFrame([], USAGE_EVENTS), 1)
        self._put(run, "slots", summed(moved.unionByName(slots(before, -1)) if older else moved), None)
        for name in ("lines", "again", "earlier", "kept", "lost", "before"):
            shutil.rmtree(f"{out}/{name}", ignore_errors=True)
        manifest = {"schema": SCHEMA, "revision": seq, **after}
        return self._merged(out, manifest)

    def _buckets_of(self, run: dict, manifest: dict, paths: list[str]) -> set[int]:
        own = run["tables"].get("events")
        return set().union(*(event_buckets(p, manifest["files"][p].get("events", 0), own["of"]) for p in paths)) if own else set()

    def _reopened(self, earlier: DataFrame, states: DataFrame) -> list[str]:
        """Grown files whose earlier events lacked something that the new rows bring, or came from a line without an end."""
        now = merged_states(states).select("file_path", *(F.col(c).alias(f"now_{c}") for c in ("meta", "first_cwd", "first_model")))
        both = earlier.join(now, "file_path", "left")
        has_cwd = F.col("first_cwd").isNotNull() | F.col("meta.cwd").isNotNull()
        brings = (F.col("meta").isNull() & F.col("now_meta").isNotNull()) | (~has_cwd & F.col("now_first_cwd").isNotNull()) | (F.col("first_model").isNull() & F.col("now_first_model").isNotNull())
        return sorted(r.file_path for r in both.where((F.col("unended") > 0) | ((F.col("kept") > 0) & brings)).select("file_path").collect())

    def _settled(self, out: str, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{out}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{out}/{name}")

    def _put(self, run: dict, name: str, rows: DataFrame, by: Column | None, order: list[str] | None = None, expected: int | None = None) -> DataFrame:
        """Write a table of a run, in buckets if it is large; what is large by fingerprint gets a directory."""
        folder, schema = f"{self.folder}/{run['id']}/{name}", rows.schema
        beside = f"{folder}-unsorted"
        buckets = 1
        if expected is None or expected <= BUCKET_ROWS:
            rows.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(folder)
            if not os.path.isdir(f"{folder}/bucket=0"):
                run["tables"][name] = {"rows": 0, "buckets": [], "of": 1}
                return self.spark.createDataFrame([], schema)
            expected = self.spark.read.schema(schema).parquet(f"{folder}/bucket=0").count()
            if by is not None and expected > BUCKET_ROWS:  # larger than it seemed
                os.replace(f"{folder}/bucket=0", beside)
                shutil.rmtree(folder)
                rows = self.spark.read.schema(schema).parquet(beside)
        if by is not None and expected > BUCKET_ROWS:
            buckets = -(-expected // BUCKET_ROWS)
            rows.withColumn("bucket", bucket_of(by, buckets)).repartition("bucket").sortWithinPartitions("bucket", *(order or [])).write.partitionBy("bucket").parquet(folder)
        shutil.rmtree(beside, ignore_errors=True)
        found = sorted(int(d.partition("=")[2]) for d in os.listdir(folder) if d.startswith("bucket="))
        run["tables"][name] = {"rows": expected, "buckets": found, "of": buckets}
        if buckets > 1 and name in ("events", "canonical"):
            bloom_filters(self.spark.read.parquet(folder).select(F.col("bucket").cast("int").alias("bucket"), "total_usage_key")).write.parquet(f"{folder}-directory")
            run["tables"][name]["directory"] = True
        return self._table(run, name)

    def _merged(self, out: str, manifest: dict) -> dict:
        """Merge the newest runs once there are ``RUNS``: as many as are not much larger than all newer ones together."""
        runs = manifest["runs"]
        if len(runs) < RUNS:
            return manifest
        size = lambda r: 1 + r["tables"]["events"]["rows"]
        at = len(runs) - 2
        while at and size(runs[at - 1]) <= FACTOR * sum(map(size, runs[at:])):
            at -= 1
        parts, whole = runs[at:], at == 0
        run = {"id": f"{os.path.basename(out)}-m", "seq": runs[-1]["seq"], "tables": {}}
        rows = {n: sum(r["tables"][n]["rows"] for r in parts if n in r["tables"]) for n in ("records", "events", "canonical", "keys")}
        parsed = self._put(run, "records", self._valid(manifest, "records", runs=parts), None)
        run["tables"]["records"]["unended"] = parsed.where("unterminated").count()
        self._put(run, "states", self._valid(manifest, "states", runs=parts), None)
        self._put(run, "events", self._valid(manifest, "events", runs=parts), event_place(), ["file_path", "event_index"], rows["events"])
        self._put(run, "canonical", self.canonical(runs=parts), F.col("total_usage_key"), ["total_usage_key"], rows["canonical"])
        if not whole:
            keys = self._union("keys", [self._table(r, "keys") for r in parts]).distinct()
            self._put(run, "keys", keys, F.col("total_usage_key"), None, rows["keys"])
        self._put(run, "slots", summed(self._union("slots", [self._table(r, "slots") for r in parts])), None)
        left = [*runs[:at], run]
        void = {p: v for p, v in manifest["void"].items() if any(r["seq"] < max(v.values()) for r in left)}
        return manifest | {"runs": left, "void": void}

    def _publish(self, manifest: dict) -> None:
        temporary = f"{self.folder}/{uuid.uuid4().hex}.tmp"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        try:
            os.link(temporary, f"{self.folder}/manifest-{manifest['revision']}.json")  # fails if the number is taken
        except FileExistsError:
            raise Conflict("the index was published by another writer") from None
        finally:
            os.unlink(temporary)
        used = set()
        for revision in self._revisions():
            name = f"{self.folder}/manifest-{revision}.json"
            if revision <= manifest["revision"] - KEEP:
                os.unlink(name)
                continue
            with open(name, encoding="utf-8") as f:
                used |= {r["id"] for r in json.load(f).get("runs", [])}
        for stale in [d for d in os.listdir(self.folder) if d.startswith("v-") and d not in used and int(d.split("-")[1]) <= manifest["revision"]]:
            shutil.rmtree(f"{self.folder}/{stale}", ignore_errors=True)


def _inside(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r + "/") for r in (r.rstrip("/") for r in roots))


def stream_refresh(spark: SparkSession, index: UsageIndex, roots: list[str], checkpoint: str):
    """A file stream that brings the files of every batch into the index; nothing else is listed or read.

    A batch that runs again after a failure finds its files as the index knows them and changes nothing, so each line counts once.
    """
    paths = roots[0] if len(roots) == 1 else "{" + ",".join(roots) + "}"
    schema = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").load(paths).select("path")

    def take(batch: DataFrame, _: int) -> None:
        files = [unquote(re.sub(r"^file:(//)?(?=/)", "", r.path)) for r in batch.distinct().collect()]
        if files:
            index.refresh(roots, only=[f for f in files if f.endswith(SUFFIXES)])

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

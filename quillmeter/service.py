"""Query service over an index: cached answers, shared priced slices, consistent reads."""

from __future__ import annotations

import threading
from collections import OrderedDict
from dataclasses import replace

from pyspark.sql import functions as F

from .functions.usage import in_range, under
from .operators.canonical import canonical
from .options import UsageQuery
from .plans.usage import payload
from .pricing.catalog import Catalog, built_in
from .pricing.spans import priced
from .streaming.incremental import UsageIndex

ANSWERS, SLICES, RETRIES = 64, 8, 3


class QueryService:
    """Answers are kept per query, fingerprint of the query's scope and price digest, so a change elsewhere leaves them; groups,
    sorts and limits share one priced slice."""

    def __init__(self, index: UsageIndex, catalog: Catalog | None = None):
        self.index, self.catalog = index, catalog or built_in()
        self._answers: OrderedDict = OrderedDict()
        self._slices: OrderedDict = OrderedDict()
        self._lock = threading.RLock()

    def set_catalog(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def _slice(self, query: UsageQuery, manifest: dict, digest: str):
        key = (query.roots, query.dedupe, query.from_ms, query.to_ms, self.index.fingerprint(list(query.roots), manifest), digest)
        if key in self._slices:
            self._slices.move_to_end(key)
            return self._slices[key]
        whole = not query.roots
        events = self.index.events(manifest)
        if not whole:
            events = events.where(under(F.col("file_path"), list(query.roots)))
        kept = self.index.canonical(manifest) if whole and query.dedupe == "global" else canonical(events, query.dedupe)
        rows = priced(kept.where(in_range(F.col("timestamp_ms"), query.from_ms, query.to_ms)), events.sparkSession, self.catalog).persist()
        self._slices[key] = (events, rows)
        while len(self._slices) > SLICES:
            self._slices.popitem(last=False)[1][1].unpersist()
        return self._slices[key]

    def query(self, query: UsageQuery) -> dict:
        with self._lock:
            for _ in range(RETRIES):
                manifest, digest = self.index.manifest(), self.catalog.digest()
                key = (replace(query, extra={}), self.index.fingerprint(list(query.roots), manifest), digest)
                if key in self._answers:
                    self._answers.move_to_end(key)
                    return self._answers[key]
                events, rows = self._slice(query, manifest, digest)
                files = self.index.files(manifest)
                if query.roots:
                    files = files.where(under(F.col("file_path"), list(query.roots)))
                failures = self.index.status()["failures"]
                answer = payload(events, query, self.catalog, files, failures, slice_=rows)
                if self.index.manifest()["revision"] != manifest["revision"]:
                    continue
                answer["index"] |= {"revision": manifest["revision"]}
                self._answers[key] = answer
                while len(self._answers) > ANSWERS:
                    self._answers.popitem(last=False)
                return answer
        raise RuntimeError("the index keeps changing")

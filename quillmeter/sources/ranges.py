"""Byte ranges of log files: whole lines of plain files, whole frames of compressed ones, and the Spark data source over them.

A file of any size is cut by arithmetic into ranges of about ``RANGE_BYTES``. A range of a plain file owns the lines that begin
in it and reads on to the end of its last one. A range of a zstd file owns the frames that begin in it (found by the sizes in
block headers, nothing is decoded on the way), again with the lines that begin in these; a file of one frame has one range.
So ranges of a file are read by different tasks, and together they give each line once.

    spark.dataSource.register(LogSource)
    spark.read.format("usage_logs").option("rangeBytes", "64m").load("/logs")

With ``spark.sql.python.filterPushdown.enabled`` and the option ``pushFilters``, filters on ``line`` (contains) run on the bytes,
before a line is decoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringContains

from .parse import MARKERS

#: ``segment`` is where the line's range begins in the file, ``line_no`` the line's place: in the file (plain), or in what the
#: range's frames decode to. Both order the lines of a file.
LINES = "file_path string, segment long, line_no long, line string, unterminated boolean, status string"
RANGES = "ranges array<struct<file_path:string,start:bigint,stop:bigint,size:bigint,before:string,inside:boolean>>"
RANGE_BYTES = 256 << 20
#: What opening a range costs, as bytes read, when small ones are dealt to tasks; tasks of a read beyond which they grow.
OPEN_BYTES, TASKS = 1 << 20, 10_000
#: Bytes that are read at once, and lines and bytes that make up a batch.
CHUNK, BATCH_LINES, BATCH_BYTES = 1 << 20, 5000, 4 << 20
BOUNDARY = 64 << 10
_HIT = re.compile(('"(' + "|".join(MARKERS) + ')"').encode())
_SCHEMA = pa.schema([("file_path", pa.string()), ("segment", pa.int64()), ("line_no", pa.int64()), ("line", pa.string()), ("unterminated", pa.bool_()), ("status", pa.string())])


class LogError(Exception):
    """Why a log cannot be used."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Range(InputPartition):
    """Lines that begin at ``start`` or later and before ``stop`` (None: all); nothing at ``size`` or later is read.

    ``before`` is the hash that must precede ``start``, where a file is expected to go on; ``inside`` ranges may begin in the
    middle of a line, which the range before owns.
    """

    path: str
    start: int = 0
    stop: int | None = None
    size: int | None = None
    before: str | None = None
    inside: bool = False


def cut(path: str, start: int, size: int | None, before: str | None = None, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """The ranges of a file from ``start``; files of unknown size have one."""
    if size is None or size - start <= range_bytes:
        return [Range(path, start, None, size, before)]
    starts = range(start, size, range_bytes)
    stops = [*starts[1:], None]
    return [Range(path, a, b, size, before if a == start else None, a > start) for a, b in zip(starts, stops, strict=True)]


def open_log(path: str):
    """A seekable binary stream of a local path, or of a URI that pyarrow knows."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def file_state(path: str) -> dict:
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        info = store.get_file_info(inner)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(path)
        return {"size": info.size, "mtime_ms": (info.mtime_ns or 0) / 1e6, "dev": 0, "ino": 0}
    s = os.stat(path)
    return {"size": s.st_size, "mtime_ms": s.st_mtime_ns / 1e6, "dev": s.st_dev, "ino": s.st_ino}


def was_changed(before: dict, after: dict, compressed: bool) -> bool:
    """A plain log may grow while it is read; nothing else may happen to it."""
    moved = any(before[k] != after[k] for k in ("dev", "ino")) or after["size"] < before["size"]
    return moved or ((compressed or after["size"] == before["size"]) and after["mtime_ms"] != before["mtime_ms"])


def boundary(f, at: int) -> str:
    """Hash of the bytes before ``at``, by which a grown file is known to go on where it ended."""
    f.seek(max(0, at - BOUNDARY))
    return hashlib.sha256(f.read(min(at, BOUNDARY))).hexdigest()


# --- frames -------------------------------------------------------------------------------------------------------

_SKIPPABLE = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")


def _read(f, n: int) -> bytes:
    """``n`` bytes unless the file ends first (remote streams may give fewer at once)."""
    out = f.read(n)
    while len(out) < n and (more := f.read(n - len(out))):
        out += more
    return out


def frame_starts(f) -> Iterator[tuple[int, bool]]:
    """Where each frame begins and whether it has content, from headers only. Ends after the first that makes no sense."""
    import zstandard

    at = 0
    while True:
        f.seek(at)
        head = _read(f, 18)
        if not head:
            return
        if _SKIPPABLE.match(head) and len(head) >= 8:
            yield at, False
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        try:
            next_block = at + zstandard.frame_header_size(head)
            checksum = zstandard.get_frame_parameters(head).has_checksum
        except zstandard.ZstdError:
            yield at, True
            return
        content, last = False, False
        while not last:
            f.seek(next_block)
            block = _read(f, 3)
            if len(block) < 3:
                yield at, True
                return
            # Three little-endian bytes: last flag, two bits of kind (1: one byte, repeated), size.
            bits = int.from_bytes(block, "little")
            last, kind, size = bits & 1, bits >> 1 & 3, bits >> 3
            content = content or size > 0
            next_block += 3 + (1 if kind == 1 else size)
        yield at, content
        at = next_block + 4 * checksum


def decoded(f, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Pieces of the content from the frame at ``at`` on, each with the place of its frame; raises for anything but whole frames."""
    import zstandard

    f.seek(at)
    data = f.read(CHUNK)
    if not data and not at:
        raise LogError("LOG_DECODE_FAILED", "empty zstd file")
    while data:
        if len(data) < 8:
            data += f.read(CHUNK)
        if _SKIPPABLE.match(data):
            size = int.from_bytes(data[4:8], "little") + 8
            at += size
            while len(data) < size and (more := f.read(CHUNK)):
                size -= len(data)
                data = more
            if len(data) < size:
                raise LogError("LOG_DECODE_FAILED", "truncated zstd frame")
            data = data[size:] or f.read(CHUNK)
            continue
        frame, taken = zstandard.ZstdDecompressor().decompressobj(), 0
        while True:
            try:
                yield at, frame.decompress(data)
            except zstandard.ZstdError as e:
                raise LogError("LOG_DECODE_FAILED", f"damaged zstd file: {e}") from e
            taken += len(data)
            if frame.eof:
                break
            data = f.read(CHUNK)
            if not data:
                raise LogError("LOG_DECODE_FAILED", "truncated zstd frame")
        at += taken - len(frame.unused_data)
        data = frame.unused_data or f.read(CHUNK)


def check_compressed(path: str) -> str | None:
    """Why a compressed log cannot be used, or None."""
    try:
        with open_log(path) as f:
            for _ in decoded(f):
                pass
    except LogError as e:
        return str(e)
    return None


# --- lines of a range ---------------------------------------------------------------------------------------------


def _split(chunks: Iterable[bytes], at: int) -> Iterator[tuple[int, bytes, bool]]:
    """Place, content and completeness of lines; a line may span any number of chunks."""
    held: list[bytes] = []
    for chunk in chunks:
        *whole, rest = chunk.split(b"\n")
        for line in whole:
            line = b"".join([*held, line])
            held = []
            yield at, line, False
            at += len(line) + 1
        held.append(rest)
    if tail := b"".join(held):
        yield at, tail, True


def _plain(f, r: Range) -> Iterator[tuple[int, bytes, bool]]:
    begin = r.start - 1 if r.inside else r.start

    def chunks() -> Iterator[bytes]:
        f.seek(begin)
        at = begin
        while data := f.read(CHUNK if r.size is None else min(CHUNK, r.size - at)):
            at += len(data)
            yield data

    lines = _split(chunks(), begin)
    if r.inside:
        next(lines, None)  # what is left of a line (or just its end) that began before
    for at, line, tail in lines:
        if r.stop is not None and at >= r.stop:
            return
        yield at, line, tail


def _framed(f, r: Range) -> Iterator[tuple[int, bytes, bool]]:
    first, before = 0, None
    if r.inside:
        first = None
        for at, content in frame_starts(f):
            if at >= r.start:
                first = at
                break
            before = at if content else before
        if first is None or (r.stop is not None and first >= r.stop):
            return
    last = b"\n"
    if before is not None:
        for at, data in decoded(f, before):
            if at != before:
                break
            last = data[-1:] or last
    own: list[int] = []  # decoded bytes of the range's own frames, once those after them have begun

    def chunks() -> Iterator[bytes]:
        size = 0
        for at, data in decoded(f, first):
            if r.stop is not None and at >= r.stop and not own:
                own.append(size)
            size += len(data)
            yield data

    lines = _split(chunks(), 0)
    if last != b"\n":
        next(lines, None)
    for at, line, tail in lines:
        if own and at >= own[0]:
            return
        yield at, line, tail


def range_lines(r: Range, needles: tuple[bytes, ...] = ()) -> Iterator[tuple[int, str | None, bool, str | None]]:
    """``(place, line, unterminated, None)`` of a range's marked lines, and at the end ``(place, None, False, status)``.

    The status tells where the last whole line ended (null: the range owns none), or what went wrong; then nothing of the file
    counts. A file that does not go on where it is expected to is reported, for the caller to read it from its start.
    """
    try:
        packed = r.path.endswith(".zst")
        state = file_state(r.path)
        with open_log(r.path) as f:
            if r.start and not r.inside and boundary(f, r.start) != r.before:
                raise LogError("LOG_REPLACED", "the file does not go on where it ended")
            end = None if r.inside else r.start
            for at, line, tail in _framed(f, r) if packed else _plain(f, r):
                if not tail:
                    end = at + len(line) + 1
                if _HIT.search(line) and all(n in line for n in needles):
                    yield at, line.removesuffix(b"\r").decode("utf-8", "replace"), tail and not packed, None
            print_ = None if packed or end is None else boundary(f, end)
        if was_changed(state, file_state(r.path), packed):
            raise LogError("LOG_CHANGED", "the file changed while it was read")
        yield end or 0, None, False, json.dumps({"from": None if r.inside else r.start, "offset": end, "boundary": print_, "state": state})
    except (OSError, LogError) as e:
        yield 0, None, False, json.dumps({"code": getattr(e, "code", "LOG_READ_FAILED"), "message": str(e)})


def combined(path: str, statuses: list[dict]) -> dict:
    """The status of a file from those of its ranges."""
    for s in statuses:
        if "code" in s:
            return s
    first = statuses[0]["state"]
    if any(was_changed(first, s["state"], path.endswith(".zst")) and was_changed(s["state"], first, path.endswith(".zst")) for s in statuses):
        return {"code": "LOG_CHANGED", "message": "the file changed while it was read"}
    begun = [s["from"] for s in statuses if s["from"] is not None]
    last = max((s for s in statuses if s["offset"] is not None), key=lambda s: s["offset"])
    return {"from": min(begun), "offset": last["offset"], "boundary": last["boundary"]}


def _batches(ranges: Iterable[Range], needles: tuple[bytes, ...] = ()) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in ranges:
        for row in range_lines(r, needles):
            rows.append((r.path, r.start, *row))
            size += len(row[1] or "")
            if len(rows) >= BATCH_LINES or size >= BATCH_BYTES:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
                rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _cost(r: Range) -> int:
    stop = r.size if r.stop is None else r.stop
    if stop is None:
        try:
            stop = file_state(r.path)["size"]
        except OSError:  # the task that reads it will tell
            stop = r.start
    return OPEN_BYTES + stop - r.start


def dealt(ranges: list[Range], least: int) -> list[list[Range]]:
    """Ranges by task: large ones alone, small ones together, but in ``least`` tasks if there are as many."""
    costs = [_cost(r) for r in ranges]
    total = sum(costs)
    most = max(min(RANGE_BYTES, total // max(1, least)), total // TASKS)
    out, size = [], 0
    for r, cost in zip(ranges, costs, strict=True):
        if not out or size + cost > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += cost
    return out


def read_ranges(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    """The lines of the ranges; large ones are tasks of their own, small ones share tasks."""
    if not ranges:
        return spark.createDataFrame([], LINES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(Range(*row.values()) for own in batch.column(0).to_pylist() for row in own)

    rows = [([(r.path, r.start, r.stop, r.size, r.before, r.inside) for r in own],) for own in dealt(ranges, 4 * spark.sparkContext.defaultParallelism)]
    return spark.createDataFrame(rows, RANGES).coalesce(1).repartition(len(rows)).mapInArrow(read, LINES)


def read_lines(spark: SparkSession, spans: list[tuple[str, int, int | None, str | None]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file_path, segment, line_no, line, unterminated, status`` of files or their ends (path, start, size, hash before).

    Every range has one row with a status and no line. A file that cannot be read fails alone.
    """
    return read_ranges(spark, [r for span in spans for r in cut(*span, range_bytes)])


# --- the data source ----------------------------------------------------------------------------------------------


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", text.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


@dataclass(frozen=True)
class Ranges(InputPartition):
    """Ranges that one task reads."""

    ranges: tuple[Range, ...] = field(default_factory=tuple)


class LogReader(DataSourceReader):
    def __init__(self, roots: list[str], range_bytes: int):
        self.roots, self.range_bytes, self.needles = roots, range_bytes, ()

    def partitions(self) -> list[Ranges]:
        from .logs import list_logs

        out, held, size = [], [], 0
        for path in list_logs(self.roots):
            try:
                ranges = cut(path, 0, file_state(path)["size"], None, self.range_bytes)
            except FileNotFoundError:
                continue
            for r in ranges:
                own = (r.stop or r.size or 0) - r.start
                if held and (size + own > self.range_bytes or len(held) >= 1000):
                    out.append(Ranges(tuple(held)))
                    held, size = [], 0
                held.append(r)
                size += own
        return [*out, Ranges(tuple(held))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _batches(partition.ranges, self.needles)


class FilteringLogReader(LogReader):
    """Takes filters on ``line`` too; Spark accepts it only where its push-down of filters to Python sources is enabled."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, StringContains) and f.attribute == ("line",):
                self.needles = (*self.needles, f.value.encode())
            yield f  # Spark looks again, since rows with a status have no line


class LogSource(DataSource):
    """``usage_logs``: a path (or ``roots``, a JSON list of paths), ``rangeBytes``, ``pushFilters``."""

    @classmethod
    def name(cls) -> str:
        return "usage_logs"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogReader:
        roots = json.loads(self.options.get("roots") or "[]") or [self.options["path"]]
        kind = FilteringLogReader if self.options.get("pushFilters", "false") == "true" else LogReader
        return kind([r.removeprefix("file://") for r in roots], _bytes(self.options.get("rangeBytes", str(RANGE_BYTES))))


def load_logs(spark: SparkSession, roots: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All lines below the roots through the data source."""
    spark.dataSource.register(LogSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("usage_logs").options(roots=json.dumps(list(roots)), rangeBytes=str(range_bytes), pushFilters=filters).load()

"""Log files: listing, scopes, failures, and writing them exactly once."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import SCOPES, split_paths

SUFFIXES = (".jsonl", ".jsonl.zst")


def list_logs(roots: Iterable[str]) -> list[str]:
    """All log files below the roots, each once, in binary order; roots that do not exist are skipped."""
    found = set()
    for root in roots:
        if "://" in root:
            found |= _list_store(root)
            continue
        if not os.path.isdir(root):
            if os.path.exists(root):
                raise NotADirectoryError(root)
            continue

        def fail(e: OSError) -> None:
            if not isinstance(e, FileNotFoundError):
                raise e

        for folder, _, names in os.walk(root, onerror=fail):
            found |= {os.path.join(folder, n) for n in names if n.endswith(SUFFIXES)}
    return sorted(found, key=os.fsencode)


def _list_store(root: str) -> set[str]:
    """Log files below a URI of any store that pyarrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(root)
    kind = store.get_file_info(inner).type
    if kind == fs.FileType.NotFound:
        return set()
    if kind != fs.FileType.Directory:
        raise NotADirectoryError(root)
    scheme = root[: root.index("://") + 3]
    head = root.rstrip("/")[: len(root.rstrip("/")) - len(inner.rstrip("/"))] or scheme
    return {head + x.path for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(SUFFIXES)}


def source_scopes(home: str, env: dict[str, str], platform: str = "linux", listing: Callable[[str], list[str]] | None = None) -> dict[str, list[str]]:
    """Roots by scope: the configured list, or ``sessions`` and ``archived_sessions`` below the home and, where it is
    mounted, below every Windows user; on Windows also below the homes of WSL distributions."""
    listing = listing or (lambda p: sorted(os.listdir(p)) if os.path.isdir(p) else [])
    kinds = ("sessions", "archived_sessions")
    base = os.path.basename(home)
    local = split_paths(env.get("QUILLMETER_ROOTS")) or [os.path.join(home, k) for k in kinds]
    windows, wsl = [], []
    if platform == "windows":
        windows = list(local)
        for host in (r"\\wsl.localhost", r"\\wsl$"):
            wsl += [f"{host}\\{d}\\home\\{u}\\{base}\\{k}" for d in listing(host) for u in listing(f"{host}\\{d}\\home") for k in kinds]
    else:
        wsl = list(local) if env.get("WSL_DISTRO_NAME") else []
        users = "/mnt/c/Users"
        windows = [f"{users}/{u}/{base}/{k}" for u in listing(users) if u not in ("All Users", "Default", "Default User", "Public") for k in kinds]
    return dict(zip(SCOPES, (list(dict.fromkeys([*local, *wsl, *windows])), local, wsl, windows), strict=True))


def failures_of(lines: DataFrame) -> DataFrame:
    """``file_path, code, message`` of the files that could not be read (in any of their ranges)."""
    status = F.from_json("status", "code string, message string")
    failed = lines.where(F.col("status").isNotNull()).select("file_path", status.alias("s")).where("s.code IS NOT NULL")
    return failed.groupBy("file_path").agg(F.min(F.struct("s.code", "s.message")).alias("s")).select("file_path", "s.*")


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new local path in the folder that driver and executors share (``spark.checkpoint.dir``); other stores are refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillmeter-")
    root = re.sub(r"^file:(//)?(?=/)", "", root.rstrip("/"))
    if re.match(r"\w+:", root):
        raise ValueError(f"{root}: files with appends need a mounted folder")
    return f"{root}/{tag}-{uuid.uuid4().hex}"


_STAGED = "name string, piece string, base long"


def write_logs(lines: DataFrame, folder: str, batch: str | None = None) -> int:
    """Append ``name, line_no, line`` to log files below a mounted folder, in order and exactly once; compressed names get their
    lines as one new frame that replaces the file. Returns the number of files.

    Tasks write pieces under names of their own; which pieces count is a table that the job commits. A second job then puts
    each piece at the place where its file ended when it was staged, so a task that runs twice, at the same time or after
    half its work, leaves the same bytes. A ``batch`` that was committed before is not written again.
    """
    spark = lines.sparkSession
    staged = f"{folder}/.staged-{batch or uuid.uuid4().hex}"
    done = f"{staged}/done"
    if os.path.exists(done):
        return 0

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        name, out, rows = None, None, []
        os.makedirs(staged, exist_ok=True)
        for rows_ in batches:
            for own, line in zip(rows_.column(0).to_pylist(), rows_.column(1).to_pylist(), strict=True):
                if own != name:
                    if out:
                        out.close()
                    name, piece = own, f"{staged}/{uuid.uuid4().hex}.piece"
                    final = f"{folder}/{own}"
                    packed = own.endswith(".zst")
                    rows.append((own, piece, 0 if packed or not os.path.exists(final) else os.path.getsize(final)))
                    out = zstandard.open(piece, "wb") if packed else open(piece, "wb")
                out.write(line.encode() + b"\n")
        if out:
            out.close()
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["name", "piece", "base"])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for rows_ in batches:
            for name, piece, base in zip(*(c.to_pylist() for c in rows_.columns), strict=True):
                place(piece, f"{folder}/{name}", base)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    table = f"{staged}/pieces"
    if not os.path.exists(f"{table}/_SUCCESS"):
        dealt = lines.select("name", "line_no", "line").repartition("name").sortWithinPartitions("name", "line_no").select("name", "line")
        dealt.mapInArrow(put, _STAGED).write.mode("overwrite").parquet(table)
    pieces = spark.read.schema(_STAGED).parquet(table).repartition(spark.sparkContext.defaultParallelism)  # few bytes, but files to write
    n = pieces.mapInArrow(commit, "n long").agg(F.sum("n")).first()[0] or 0
    if batch:
        with open(done, "w", encoding="utf-8"):
            pass
        for piece in [x for x in os.listdir(staged) if x.endswith(".piece")]:
            os.unlink(f"{staged}/{piece}")
    else:
        shutil.rmtree(staged, ignore_errors=True)
    return n


def place(piece: str, final: str, base: int) -> None:
    """Put the bytes of ``piece`` at ``base`` of ``final``; doing so again changes nothing. A piece for a compressed log replaces it."""
    os.makedirs(os.path.dirname(final), exist_ok=True)
    if final.endswith(".zst"):
        beside = f"{final}.{uuid.uuid4().hex}.tmp"
        shutil.copyfile(piece, beside)
        os.replace(beside, final)
        return
    with open(final, "r+b" if os.path.exists(final) else "w+b") as out, open(piece, "rb") as new:
        out.seek(base)
        shutil.copyfileobj(new, out, 1 << 20)
        out.truncate()

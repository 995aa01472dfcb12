"""Deterministic sharded WARC writer, and its reader.

Records are dealt into shards by ranges of ``page_id`` of about ``shard_bytes`` payload bytes. The cuts come from counts of
payload bytes by ranges of ids, halved where they are full, so they depend on the data alone; a single id (or a null one)
with more than a shard is dealt by ranges of a hash of its payloads. A task sorts one shard, writes a gzip member per
record, and rolls to the next file once the compressed size passes ``roll_bytes``. Files get temporary names that carry the
attempt; the manifest lists the files of the attempts that Spark counted, the driver renames these to their final names,
writes the manifest under a temporary name and renames that last. A folder without a manifest is not an archive; leftovers
of lost attempts are removed at commit. The driver holds a line of the manifest for each file and a number for each shard.

Headers are made anew from the rows: fixed date, record ids from ``page_id``, payload digest and a count among equal ones,
block and payload digests (SHA-1). Of equal payloads of at least ``least`` bytes one record with the largest ``page_id`` is
the response; all others are revisits with an empty body that refer to it.

Defined cases: null html is an empty payload; very long payloads are whole; null urls become ``about:blank`` and CR, LF and
spaces in urls are percent-encoded; rows with the same ``page_id`` all get a record; of rows that tie for the largest
``page_id`` of a payload the least url is the response and the others revisit it; a null ``page_id`` comes before all
others, is written as an empty field and revisits like any other, but cannot be referred to: payloads that only such rows
have are all responses; an empty table makes an archive without files; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, discard, lookup, save, scratch_path, table

LEAST, ROLL_BYTES, SHARD_BYTES, BINS = 1000, 64 << 20, 256 << 20, 1024
#: Repeated payloads up to which their digests are broadcast (36 bytes each); above, rows are joined by a shuffle.
FEW = 200_000
DATE = "2024-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
_READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def _store(uri: str):
    """A pyarrow file system and path; made on the executor that uses it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _url(url: str | None) -> str:
    return (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(page_id: int | None, sha: bytes, count: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{sha.hex()}:{count}>"


def record(page_id: int | None, count: int, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One uncompressed record; ``refers`` is the page that holds the payload, for a revisit."""
    sha = hashlib.sha1(payload).digest()
    kind = "response" if refers is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, sha, count)), ("WARC-Date", DATE), ("WARC-Target-URI", _url(url))]
    if refers is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, sha, 0)), ("X-Payload-Length", str(len(payload)))]
    head += [("WARC-Payload-Digest", _base32(sha)), ("WARC-Block-Digest", _base32(hashlib.sha1(body).digest())), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time or name, so equal records give equal bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _cuts(rows: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ids of the runs that make up the shards, each run's shard, and in how many shards a run is dealt (1, or more
    for a single id that is larger than a shard).
    """
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first()
    done: list[tuple[int, int]] = []
    open_ = [] if low is None else [(low, high)]
    while open_:
        # Full ranges are cut into ``BINS`` parts each, in one pass for all of them.
        starts, widths = np.array([a for a, _ in open_], np.int64), np.array([max(1, -(-(b - a + 1) // BINS)) for a, b in open_], np.int64)
        ends = np.array([b for _, b in open_], np.int64)
        parts = rows.where(F.col("page_id").isNotNull()).select(_bin(starts, ends, widths)("page_id").alias("bin"), "bytes").where("bin >= 0")
        found = sorted(tuple(r) for r in parts.groupBy("bin").agg(F.sum("bytes")).collect())
        again = []
        for number, size in found:
            i, k = divmod(number, 1 << 12)
            a = int(starts[i]) + k * int(widths[i])
            b = min(int(ends[i]), a + int(widths[i]) - 1)
            if size > shard_bytes and b > a:
                again.append((a, b))
            else:
                done.append((a, size))
        open_ = again
    first, shard, many, number, size = [], [], [], 0, 0
    for a, n in sorted(done):
        if size and size + n > shard_bytes:
            number, size = number + 1, 0
        first.append(a)
        shard.append(number)
        many.append(max(1, -(-n // shard_bytes)))
        size += n
        number += many[-1] - 1
    return np.array(first, np.int64), np.array(shard, np.int64), np.array(many, np.int64)


def _bin(starts: np.ndarray, ends: np.ndarray, widths: np.ndarray):
    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        i = np.maximum(np.searchsorted(starts, ids, side="right") - 1, 0)
        inside = (ids >= starts[i]) & (ids <= ends[i])
        return pd.Series(np.where(inside, i * (1 << 12) + (ids - starts[i]) // widths[i], -1))

    return place


def _shards(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with ``shard``, and the number of shards; rows without a ``page_id`` are in the first ones."""
    without = rows.where(F.col("page_id").isNull()).agg(F.sum("bytes")).first()[0]
    base = 0 if without is None else max(1, -(-without // shard_bytes))
    first, shard, many = _cuts(rows, shard_bytes)

    @F.pandas_udf("long")
    def place(ids: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        h, null = h.to_numpy(np.int64) / 2.0**64 + 0.5, null.to_numpy(bool)
        out = np.minimum((h * base).astype(np.int64), max(base, 1) - 1)
        if len(first):
            i = np.maximum(np.searchsorted(first, ids.to_numpy(np.int64), side="right") - 1, 0)
            out = np.where(null, out, base + shard[i] + np.minimum((h * many[i]).astype(np.int64), many[i] - 1))
        return pd.Series(out)

    number = place(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), F.xxhash64("payload"))
    return rows.withColumn("shard", number.cast("int")), base + int((shard + many - 1).max() + 1 if len(first) else 0)


def write(pages: DataFrame, folder: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> dict:
    """Write ``pages`` (page_id, url, html) as gzip WARC files into the new ``folder``; returns the manifest."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"))
    # Payloads are equal if both digests are.
    key = F.when(F.col("bytes") >= least, F.concat(F.unhex(F.sha1("payload")), F.unhex(F.sha2("payload", 256))))
    held = save(rows.where(F.col("bytes") >= least).select("page_id", key.alias("key")), "payload-digests")
    same = held.groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1 AND holder IS NOT NULL")
    same = save(same, "repeated-payloads")
    rows, shards = _shards(rows, shard_bytes)
    if not shards:
        rows, shards = rows.where("false"), 1
    rows = rows.withColumn("key", key)
    if at_most(same, FEW):
        rows = rows.join(F.broadcast(same.select("key", "holder")), "key", "left")
    else:
        rows = lookup(rows, same, "key", "copies")
    dealt = rows.select("shard", "page_id", "url", "payload", "holder").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", F.xxhash64("payload"), "payload", "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = _store(folder)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        out, done, shard, number, size, count, last = None, [], None, 0, 0, 0, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in batches:
            for s, page, url, text, holder in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard or size >= roll_bytes:
                    close()
                    shard, number = s, number + 1 if s == shard else 0
                    size = 0
                if out is None:
                    name = f"part-{shard:06d}-{number:05d}.warc.gz"
                    temporary = f"{path}/_temporary/{attempt}-{name}"
                    store.create_dir(f"{path}/_temporary", recursive=True)
                    out = store.open_output_stream(temporary, compression=None)
                    done.append([name, temporary.rpartition("/")[2], 0, 0, hashlib.sha256()])
                data = text.encode()
                this = (page, hashlib.sha1(data).digest())
                count = count + 1 if this == last else 0
                last = this
                refers = None if holder is None or (page == holder and not count) else holder
                packed = member(record(page, count, url, data, refers))
                out.write(packed)
                size += len(packed)
                done[-1][2] += 1
                done[-1][3] += len(packed)
                done[-1][4].update(packed)
        close()
        yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done]), pa.array([d[2] for d in done], pa.int64()), pa.array([d[3] for d in done], pa.int64()), pa.array([d[4].hexdigest() for d in done])], names=["name", "temporary", "records", "bytes", "sha256"])

    files = dealt.mapInArrow(put, "name string, temporary string, records long, bytes long, sha256 string").collect()
    discard(held, same)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    for f in files:
        store.move(f"{path}/_temporary/{f.temporary}", f"{path}/{f.name}")
    manifest = {"format": "WARC/1.1", "files": [{"name": f.name, "records": f.records, "bytes": f.bytes, "sha256": f.sha256} for f in sorted(files)]}
    with store.open_output_stream(f"{path}/manifest.json.tmp", compression=None) as out:
        out.write(json.dumps(manifest, indent=1).encode())
    store.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    from pyarrow import fs

    if store.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{path}/_temporary")
    return manifest


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or _base32(hashlib.sha1(block).digest()) != head["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
        yield head, block


def _page(urn: str | None) -> int | None:
    part = urn.strip("<>").split(":")[2] if urn else ""
    return int(part) if part else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a committed archive; ``payload`` is null for revisits. Digests are checked on the way."""
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/manifest.json", compression=None) as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    if not names:
        return spark.createDataFrame([], FIELDS)
    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)), "name")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "url", "payload") else pa.int64()) for n in _READ])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for head, block in parse(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2])
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"payload digest differs in {head['WARC-Record-ID']}")
                        length = int(head["X-Payload-Length"]) if revisit else len(payload)
                        rows.append((_page(head["WARC-Record-ID"]), length, digest.hex(), head["WARC-Type"], _page(head.get("WARC-Refers-To")), head["WARC-Target-URI"], None if revisit else payload.decode()))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True), schema.types)), schema=schema)

    return files.mapInArrow(get, FIELDS)


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder, shard_bytes=16 << 20, roll_bytes=2 << 20)
    return read(spark, folder).select(*_READ[:5])


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND place > 1 AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND place > 1 THEN holder END AS refers_to FROM q
"""

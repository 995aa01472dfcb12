"""Shared pieces of the corpus operators: scratch tables, checked broadcasts, vectorised hashing.

Nothing here keeps state between calls. Scratch tables are written below ``spark.checkpoint.dir`` (the folder that
driver and executors share), so a lost executor never takes intermediate data with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a key-only side may be broadcast (at most 16 bytes a row: about 16 MB as longs).
BROADCAST_ROWS = 1_000_000
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillmeter-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's own settings: remove a query's shuffle files when it has ended, not when the driver collects its garbage; and
#: keep no longer texts of plans on the driver, which would hold plans' constants many times over.
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "20000", "spark.sql.debug.maxToStringFields": "0"}


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it: cuts lineage, survives lost executors.

    The shuffle files behind it go at once, since the written table takes their place.
    """
    spark, conf = df.sparkSession, df.sparkSession.conf
    path, before = scratch_path(spark, tag), {k: conf.get(k, None) for k in WHILE_SAVING}
    for k, v in WHILE_SAVING.items():
        conf.set(k, v)
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*saved: DataFrame) -> None:
    """Delete tables that ``save`` wrote and nothing reads any more."""
    for df in saved:
        spark, path = df.sparkSession, getattr(df, "_scratch", None)
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast only if the row count was checked; otherwise leave the join to a shuffle."""
    return F.broadcast(small) if at_most(small, rows) else small


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# ---------------------------------------------------------------------------------------------------------------
# Vectorised word hashing over Arrow text columns
# ---------------------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Cut a text column into runs of rows of at most ``most_bytes`` (a longer text is a run of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, column.slice(at, to - at)
        at = to


def word_hashes(texts: pa.Array, fold: bool, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of large_string rows, and each row's first word (n + 1 offsets).

    ``breaks`` may name other bytes between words (256 flags).
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    bounds = offsets - lo
    word = ~(_SPACE if breaks is None else breaks)[data]
    edges = np.unique(bounds)
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[edges[:-1]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    positions = np.flatnonzero(word)
    first = np.searchsorted(positions, starts)
    lengths = np.diff(np.append(first, len(positions)))
    inside = np.arange(len(positions), dtype=np.int64) - np.repeat(first, lengths)
    kept = data[positions]
    if fold:
        kept = _FOLD[kept]
    h = np.add.reduceat(_BYTE[kept] * _power(int(lengths.max()))[inside], first)
    h = mix(h + lengths.astype(np.uint64) * _STEP[15])
    return h, np.searchsorted(starts, bounds, side="left").astype(np.int64)


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring word hashes (``len(h) - k + 1`` values)."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out = mix(out + h[j : j + n] * _STEP[j]) if j else h[:n] * _STEP[0]
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes (words folded A-Z) of each large_string row; fewer words make one shingle."""
    h, at = word_hashes(texts, fold=True)
    runs = chained(h, k)
    out = []
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = chained(h[a:b], b - a)
            out.append(mix(whole + np.uint64(b - a) * _STEP[14:15]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------------------------------------------------------
# Packed integer columns: many small rows of a shuffle as a few compressed ones
# ---------------------------------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Columns of integers, compressed byte plane by byte plane; the first bytes tell shape and width."""
    a = np.ascontiguousarray(np.atleast_2d(a))
    head = np.array([*a.shape, a.itemsize], np.int32).tobytes()
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return head + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    rows, n, width = (int(x) for x in np.frombuffer(data, np.int32, 3))
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[12:], rows * n * width, asbytes=True), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view({8: np.uint64, 4: np.int32, 1: np.int8}[width]).reshape(rows, n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)[0], dtype=np.uint64)


# ---------------------------------------------------------------------------------------------------------------
# Two Bloom filters: keys seen once, keys seen twice
# ---------------------------------------------------------------------------------------------------------------

CHUNK = 1 << 16


def filter_bits(keys: int, most: int) -> int:
    """A power of two of about 16 to 32 bits a key, between 2**20 and ``most``."""
    return min(most, max(1 << 20, 1 << (max(1, keys) * 16 - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(h + _STEP[13])
    return (m >> np.uint64(32)) & np.uint64(bits - 1), (m ^ (m << np.uint64(29))) * _STEP[12] >> np.uint64(64 - bits.bit_length() + 1)


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (places >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (places & np.uint64(7)).astype(np.uint8)))


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1


def seen_twice(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the second filter holds: every key that occurs twice, and a few that do not."""
    a, b = _places(h.astype(np.uint64, copy=False), len(bitmap) * 8)
    return _has(bitmap, a) & _has(bitmap, b)


def twice_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The second filter over a DataFrame of one column of longs (null: no key), as a bitmap of ``bits`` bits.

    Each task fills its own pair of filters; pairs merge as (once | once', twice | twice' | once & once'), which keeps
    every key that two tasks saw. Only non-empty compressed 64 KiB pieces travel, merged piece by piece on the
    executors; the driver receives the finished filter, whose size is fixed by ``bits``.
    """
    name = hashes.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        once, twice, any_key = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), False
        for batch in batches:
            column = batch.column(0).drop_null()
            if not len(column):
                continue
            any_key = True
            values, counts = np.unique(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True)
            a, b = _places(values, bits)
            repeated = (counts > 1) | (_has(once, a) & _has(once, b))
            for places in (a, b):
                _set(twice, places[repeated])
                _set(once, places)
        if not any_key:
            return
        step = min(CHUNK, bits // 8)
        ids, ones, twos = [], [], []
        for i in range(0, bits // 8, step):
            if once[i : i + step].any():
                ids.append(i // step)
                ones.append(zlib.compress(once[i : i + step].tobytes(), 1))
                twos.append(zlib.compress(twice[i : i + step].tobytes(), 1))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], names=["piece", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        current, once, twice = None, None, None

        def done():
            return pa.record_batch([pa.array([current], pa.int64()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["piece", "twice"])

        for batch in batches:
            for piece, o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if piece != current:
                    if current is not None:
                        yield done()
                    current, once, twice = piece, o.copy(), t.copy()
                else:
                    twice |= t | (once & o)
                    once |= o
        if current is not None:
            yield done()

    pieces = hashes.select(name).mapInArrow(fill, "piece long, once binary, twice binary")
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece long, twice binary")
    out, step = np.zeros(bits // 8, np.uint8), min(CHUNK, bits // 8)
    import zlib

    for row in merged.collect():
        out[row.piece * step : (row.piece + 1) * step] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out


# ---------------------------------------------------------------------------------------------------------------
# Joins that a hot key does not stall
# ---------------------------------------------------------------------------------------------------------------


HOT_BYTES = 4096
#: Rows up to which facts of fixed width are broadcast whole (a few MB).
FACT_ROWS = 100_000
_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def lookup(rows: DataFrame, facts: DataFrame, key: str, weight: str, hot: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one-row-a-key ``facts`` whose ``weight`` tells how many rows the key has.

    Keys that hold at least a thousandth of the rows (``1 / hot``; so at most ``hot`` keys) are broadcast; the rows of
    these keys then bear a key of their own and spread over the shuffle of the remaining join. Texts of more than
    ``HOT_BYTES`` are not broadcast, so what is has a bound; a shuffle by their hash joins them. Up to ``FACT_ROWS`` facts
    of fixed width are broadcast together, in one join instead of two.
    """
    values = [c for c in facts.columns if c not in (key, weight)]
    total, n = facts.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    if n <= FACT_ROWS and all(t in _FIXED for c, t in facts.dtypes if c != weight):
        all_facts = facts.select(F.col(key).alias("__k"), F.struct(*values).alias("__fact"))
        joined = rows.join(F.broadcast(all_facts), rows[key].eqNullSafe(F.col("__k")), "left")
        return joined.select(*rows.columns, *[F.col(f"__fact.{c}").alias(c) for c in values])
    often = F.col(weight) >= max(1000, total // hot)
    if dict(facts.dtypes)[key] in ("string", "binary"):
        often = often & F.coalesce(F.octet_length(key) <= HOT_BYTES, F.lit(True))
    common = facts.where(often).select(F.col(key).alias("__k"), F.struct(*values).alias("__hot"))
    # Always 0, but not a constant to the optimiser, which would drop it from the keys that rows are dealt by.
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    rest = facts.where(~often).select(F.col(key).alias("__r"), zero.alias("__s"), F.struct(*values).alias("__cold"))
    marked = rows.join(F.broadcast(common), rows[key].eqNullSafe(F.col("__k")), "left").drop("__k")
    spread = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("int") + 1).otherwise(F.lit(0))
    marked = marked.withColumn("__t", spread)
    joined = marked.join(rest, (marked[key] == F.col("__r")) & (F.col("__t") == F.col("__s")), "left")
    picked = [F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in values]
    return joined.select(*rows.columns, *picked)

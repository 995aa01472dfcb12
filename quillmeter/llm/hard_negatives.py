"""Hard negatives from inverted lists with stored radii: exact, by bounds.

Rows are dealt to the nearest of at most ``CLUSTERS`` centroids (k-means on a sample of ``EACH`` rows a centroid, in the
order of a hash of ``vec_id``; every row is dealt). A cluster keeps its centroid and its radius, the largest distance of a
row from it, and is cut into parts of about ``LIST_ROWS`` rows, so no list grows with the data, whatever its cluster holds.

By Cauchy and Schwarz no row of a cluster scores above ``a.c + |a| r`` for an anchor ``a``, nor below ``a.c - |a| r``. An
anchor visits clusters in the order of the upper bound, a few first and then eight times as many in each round. It skips a
cluster whose scores all lie outside its windows, and stops when the bound falls strictly below its kth score (an equal
one may still win by its id). Rounds are shuffles by list part: anchors travel in blocks, each part answers with its best
rows only, and the best of all parts are kept in a written table.

There are two searches: the first ``top`` rows of an anchor's label (its positives), then, for all of its positives at once,
the first ``top`` rows of other labels with ``80 p <= 100 s <= 100 p`` for a positive of score ``p``.

Defined cases: rows whose id, label or vector is null, or that hold a null or non-finite component, take no part; vectors
shorter than the longest count as ended with zeros; every repeated row is a candidate, one row of a repeated anchor id
(the least by label, then vector) is the anchor, and rows of the anchor's own id are not its candidates; ties go to the
smaller ``vec_id``; negative positive scores have no negatives; components so large that a score might pass 63 bits raise
an error; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, save, table

CLUSTERS, EACH, PER_CLUSTER, LIST_ROWS = 1024, 32, 512, 4096
ANCHORS, TOP, FIRST, GROWTH = 256, 5, 8, 8
_NONE = np.iinfo(np.int64).min
_FOUND = "anchor_id long, slot int, score long, vec_id long"
_REQUEST = "cluster int, anchors binary, vectors binary, windows binary"


def finite(vector: Column) -> Column:
    """A vector that is there and has neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: Column, by: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("long"))


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column, ended with zeros where they are shorter than ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def lists_of(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def _nearest(x: np.ndarray, centroids: np.ndarray, squares: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 2048):
        out[i : i + 2048] = (squares - 2 * (x[i : i + 2048] @ centroids.T)).argmin(axis=1)
    return out


def k_means(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample, begun with its first different rows."""
    centroids = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])[:k]].astype(np.float64)
    for _ in range(rounds):
        of = _nearest(sample, centroids, (centroids**2).sum(axis=1))
        sizes = np.bincount(of, minlength=len(centroids))
        for c in np.flatnonzero(sizes):
            centroids[c] = sample[of == c].mean(axis=0)
    return centroids


@dataclass(frozen=True)
class InvertedLists:
    """``rows``: cluster, part, vec_id, label, vector. The rest has an entry for each cluster, at most ``CLUSTERS``."""

    rows: DataFrame
    width: int
    centroids: np.ndarray
    radii: np.ndarray
    parts: list[int]


def build_lists(rows: DataFrame, clusters: int = CLUSTERS, list_rows: int = LIST_ROWS) -> InvertedLists:
    """Inverted lists over ``vec_id, label, vector`` (whole numbers), all rows of them."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    k = max(1, min(clusters, n // PER_CLUSTER))
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(k * EACH).toArrow()
    centroids = k_means(matrix(sample.column("vector"), width).astype(np.float64), k) if n else np.zeros((1, width))
    squares = (centroids**2).sum(axis=1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width).astype(np.float64)
            cluster = _nearest(x, centroids, squares)
            away = np.sqrt(((x - centroids[cluster]) ** 2).sum(axis=1))
            yield pa.record_batch([pa.array(cluster, pa.int32()), *batch.columns, pa.array(away)], names=["cluster", "vec_id", "label", "vector", "away"])

    dealt = save(rows.mapInArrow(deal, "cluster int, vec_id long, label long, vector array<long>, away double"), "inverted-lists")
    radii, parts = np.zeros(len(centroids)), [1] * len(centroids)
    for r in dealt.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row a cluster
        radii[r.cluster], parts[r.cluster] = r.radius, -(-r.n // list_rows)
    cuts = spark.createDataFrame(list(enumerate(parts)), "cluster int, parts int")
    placed = dealt.join(F.broadcast(cuts), "cluster").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int"))
    placed = placed.select("cluster", "part", "vec_id", "label", "vector")
    placed._scratch = dealt._scratch
    return InvertedLists(placed, width, centroids, radii, parts)


def _best(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``top`` largest of each row, the first column first among equals; ``_NONE`` is no score."""
    if scores.shape[1] > top:
        kth = np.partition(scores, -top, axis=1)[:, -top]
        chosen = (scores >= kth[:, None]) & (scores > _NONE)
    else:
        chosen = scores > _NONE
    r, c = np.nonzero(chosen)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < top], c[rank < top]


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: as doubles while no sum can pass 53 bits."""
    norm = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
    most = norm(a) * norm(x)
    if most < 2**52:
        return np.rint(a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return a @ x.T


def _requests(lists: InvertedLists, start: int, stop: int):
    """Blocks of anchors for each cluster among places ``start`` to ``stop`` of their visiting orders that may still matter."""
    width, centroids, radii = lists.width, lists.centroids, lists.radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ANCHORS):
                block = batch.slice(i, ANCHORS)
                m = len(block)
                anchors = np.column_stack([block.column(0).to_numpy(), block.column(1).to_numpy()])
                a = matrix(block.column(2), width)
                counts = np.diff(block.column(3).offsets.to_numpy()) // 3
                windows = matrix(block.column(3), 3 * counts.max(initial=0)).reshape(m, -1, 3).copy()
                windows[np.arange(windows.shape[1]) >= counts[:, None]] = (1, 0, 0)  # nothing lies between 1 and 0
                middle = a.astype(np.float64) @ centroids.T
                reach = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))[:, None] * radii
                if (np.abs(middle) + reach).max(initial=0) >= 2**62:
                    raise ValueError("components are too large: a score might pass 63 bits")
                slack = 1 + 1e-9 * (np.abs(middle) + reach)  # what rounding may hide
                upper, lower = middle + reach + slack, middle - reach - slack
                order = np.argsort(-upper, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
                low, high, kth = (windows[:, :, j][:, :, None].astype(np.float64) for j in range(3))
                open_ = (low <= high) & (upper[:, None] >= low) & (lower[:, None] <= high) & (upper[:, None] >= kth)
                asked = open_.any(axis=1) & (place >= start) & (place < stop)
                out = []
                for c in np.flatnonzero(asked.any(axis=0)):
                    who = np.flatnonzero(asked[:, c])
                    out.append((c, anchors[who].tobytes(), a[who].tobytes(), windows[who].tobytes()))
                if out:
                    yield pa.record_batch([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[j] for o in out], pa.binary()) for j in (1, 2, 3))], names=["cluster", "anchors", "vectors", "windows"])

    return run


def _visit(width: int, top: int, same: bool):
    """Answers of list parts: rows of a part come first, then the blocks that ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, x, ids, labels = None, [], None, None, None
        for batch in batches:
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            kinds = batch.column(2).to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])]) if len(keys) else []
            for at, to in zip(starts, [*starts[1:], len(keys)], strict=True):
                run_, key = batch.slice(at, to - at), tuple(keys[at])
                if key != current:
                    current, held, x = key, [], None
                if kinds[at] == 0:
                    held.append(run_)
                    continue
                if x is None:
                    ids = np.concatenate([h.column(3).to_numpy() for h in held]) if held else np.zeros(0, np.int64)
                    labels = np.concatenate([h.column(4).to_numpy() for h in held]) if held else np.zeros(0, np.int64)
                    x = np.concatenate([matrix(h.column(5), width) for h in held]) if held else np.zeros((0, width), np.int64)
                    order = np.argsort(ids, kind="stable")
                    ids, labels, x, held = ids[order], labels[order], x[order], []
                if not len(ids):
                    continue
                for anchors, vectors, windows in zip(*(run_.column(j).to_pylist() for j in (6, 7, 8)), strict=True):
                    anchors = np.frombuffer(anchors, np.int64).reshape(-1, 2)
                    m = len(anchors)
                    windows = np.frombuffer(windows, np.int64).reshape(m, -1, 3)
                    scores = _products(np.frombuffer(vectors, np.int64).reshape(m, width), x)
                    fits = ((anchors[:, 1:] == labels) == same) & (anchors[:, :1] != ids)
                    for slot in range(windows.shape[1]):
                        low, high, kth = (windows[:, slot, j, None] for j in range(3))
                        r, c = _best(np.where(fits & (scores >= np.maximum(low, kth)) & (scores <= high), scores, _NONE), top)
                        if len(r):
                            yield pa.record_batch([pa.array(anchors[r, 0]), pa.array(np.full(len(r), slot), pa.int32()), pa.array(scores[r, c]), pa.array(ids[c])], names=["anchor_id", "slot", "score", "vec_id"])

    return run


def search(asks: DataFrame, lists: InvertedLists, same: bool, top: int = TOP) -> DataFrame:
    """``anchor_id, slot, score, vec_id``: for each window of each anchor the first ``top`` rows of the same label (or of others).

    ``asks``: ``anchor_id, label, vector`` and ``windows``, lows and highs one after the other; slots count windows from 0.
    """
    spark = asks.sparkSession
    empty = lambda kind: F.lit(None).cast(kind)
    cuts = spark.createDataFrame(list(enumerate(lists.parts)), "cluster int, parts int")
    found, start, size, clusters = None, 0, FIRST, len(lists.parts)
    keep = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    while start < clusters:
        stop = min(clusters, start + size)
        asking = asks
        if found is not None:
            full = found.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == top)
            asking = asks.join(full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths")), "anchor_id", "left")
        else:
            asking = asks.withColumn("kths", empty("map<int,long>"))
        kth = lambda i: F.coalesce(F.element_at("kths", i), F.lit(_NONE))
        triples = F.flatten(F.transform("windows", lambda w, i: F.array(w["low"], w["high"], kth(i))))
        wanted = asking.select("anchor_id", "label", "vector", triples.alias("windows"))
        requests = save(wanted.mapInArrow(_requests(lists, start, stop), _REQUEST), "anchor-requests")
        start, size = stop, size * GROWTH
        visited = [r.cluster for r in requests.select("cluster").distinct().collect()]  # at most CLUSTERS
        if not visited:
            discard(requests)
            break
        each = requests.join(F.broadcast(cuts), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        each = each.select("cluster", "part", F.lit(1).alias("kind"), empty("long").alias("vec_id"), empty("long").alias("label"), empty("array<long>").alias("vector"), "anchors", "vectors", "windows")
        held = lists.rows.where(F.col("cluster").isin(visited)).select("cluster", "part", F.lit(0).alias("kind"), "vec_id", "label", "vector", *(empty("binary").alias(c) for c in ("anchors", "vectors", "windows")))
        met = held.unionByName(each).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "kind")
        answers = met.mapInArrow(_visit(lists.width, top, same), _FOUND)
        merged = (answers if found is None else found.unionByName(answers)).withColumn("__rank", keep).where(F.col("__rank") <= top).drop("__rank")
        before, found = found, save(merged, "hard-rows")
        discard(requests, *([before] if before is not None else []))
    return found if found is not None else spark.createDataFrame([], _FOUND)


def hard_negatives(rows: DataFrame, anchors: Column, top: int = TOP, clusters: int = CLUSTERS, list_rows: int = LIST_ROWS) -> DataFrame:
    """Mine ``vec_id, label, vector`` (whole numbers): for every row that meets ``anchors``, each of its first ``top`` positives
    and the first ``top`` negatives in that positive's window: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``.
    """
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    lists = build_lists(rows, clusters, list_rows)
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "vector"))
    chosen = lists.rows.where(anchors).withColumn("__row", one).where("__row = 1")
    asks = chosen.select(F.col("vec_id").alias("anchor_id"), "label", "vector")
    everything = F.struct(F.lit(_NONE + 1).alias("low"), F.lit(-_NONE - 1).alias("high"))
    positives = search(asks.withColumn("windows", F.array(everything)), lists, True, top)
    in_order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = positives.select("anchor_id", (F.row_number().over(in_order) - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The least whole score s with 5 s >= 4 p, without a product that might overflow.
    low = F.expr("positive_score - (positive_score - pmod(positive_score, 5)) div 5")
    windows = positives.withColumn("window", F.struct(low.alias("low"), F.col("positive_score").alias("high"))).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "window"))).alias("w"))
    narrowed = asks.join(windows.select("anchor_id", F.transform("w", lambda w: w["window"]).alias("windows")), "anchor_id")
    negatives = search(narrowed, lists, False, top)
    discard(lists.rows)
    ranked = negatives.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")))
    return ranked.join(positives, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""

"""N-gram Jaccard join in the metric space of shingle sets, and its connected components.

Distance is one minus Jaccard similarity, a metric; documents link within ``eps``.

1. Documents with equal sets form a class; only one of a class (the smallest ``doc_id``) goes on.
2. Projection. Pivots that are whole documents cannot cut a corpus of text by themselves: nearly all documents are at
   distance 1 from nearly all of them, so the triangle inequality excludes nothing. So the space of shingles is first cut
   into ``B`` ranges of hashes. In each range the symmetric difference is a distance of its own, and these add up to that
   of the whole sets, which is at most ``D`` for linked sets of a size class. With ``B > D`` ranges, linked sets are at
   distance 0 in at least ``B - D`` of them; of those that a set fills, all but ``D``. This step rests on counting (the
   pigeonhole), not on a pivot.
3. Voronoi regions. Sets that agree in a range gather around the first of them, their pivot; a set is replicated to the
   regions of all ranges in which it agrees with others, so every link lies inside a region. Sets that agree with others
   in too few ranges to have a link leave. The distance of every member to its pivot is measured exactly. Members within
   ``eps`` are linked to the pivot, and so need no comparison with each other for the components.
4. What is left of a region joins: members out of the pivot's reach against each other and, by the triangle inequality,
   against linked members in the window ``d(y, p) >= min d(x, p) - eps``. Regions too large for a task are cut into
   distance bands, of which only those within ``eps`` of each other meet. Inside a task, the set is cut recursively by
   further pivots, with boundary members in every cell within ``2 * eps``, down to leaves.
5. Links join into components.

Shingles are told apart by 64-bit hashes, and classes by 64-bit sums of these. Cells (a range with its content) travel
packed, about five bytes each; a task that finds those which recur holds one entry a distinct cell, so a cell that many
documents share streams through. Nothing is broadcast but lists of checked size.

Defined cases: null or wordless text has an empty set and links with nothing (its component is itself); rows with the
same ``doc_id`` are one node of the graph, with a row each in the result; rows with a null ``doc_id`` get their count and
a null component; very long texts are whole; ties between pivots go by the order of reading and change no result; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, discard, lookup, mix, pack, pack_sorted, save, shingle_sets, sized, slices, table, unpack, unpack_sorted
from .components import components

#: Shingles in one block of a region, and rows of members that meet one copy of their pivot in a task.
BLOCK, CHUNK = 1_000_000, 512
#: Pairs up to which a side is broadcast (24 bytes each); above, the join shuffles.
PAIRS = 500_000
#: Cells of documents that are packed together, and of a bucket that are looked through at once.
PACKED, AT_ONCE = 2_000_000, 500_000
_FIELDS = [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("slot", pa.int64()), ("bucket", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("owners", pa.binary()), ("marks", pa.binary())]
_SCHEMA = "doc_id long, n long, node long, slot long, bucket int, block long, cells binary, owners binary, marks binary"
_SPARE = 8


class Ranges:
    """Size classes up to a factor of the similarity, and the hash ranges of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tops, self.kinds = num, den, [1], {}

    def kinds_of(self, n: int) -> range:
        """The classes in which a set of ``n`` may link: by the size of the larger partner, from its own up."""
        most = n * self.den // self.num
        while self.tops[-1] < most:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * self.den // self.num))
        return range(bisect.bisect_left(self.tops, n), bisect.bisect_left(self.tops, most) + 1)

    def apart(self, n: int, top: int) -> int:
        """How many elements at most one of two linked sets has, if one has ``n`` and the other ``top`` or fewer."""
        return (n + top) * (self.den - self.num) // (self.den + self.num)

    def kind(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Inner edges of the ranges and a number of its own for each range; None if only equal sets link."""
        if c not in self.kinds:
            top, below = self.tops[c], self.tops[c - 1] if c else 0
            least, most = max(1, -(-self.num * (below + 1) // self.den)), self.apart(top, top)
            count = most + 2
            while count < most + 2 + _SPARE + most // 16:
                # So many ranges that sets with too many empty ones are rare.
                empty = [(n, count * (1 - 1 / count) ** n) for n in (least, (least + top) // 2, top)]
                if all(count - e - 4 * math.sqrt(e) - self.apart(n, top) >= 1 for n, e in empty):
                    break
                count += 1
            edges = np.array([-(-(j << 64) // count) for j in range(1, count)], np.uint64)
            self.kinds[c] = (edges, mix(np.arange(count, dtype=np.uint64) + np.uint64((c + 1) << 32))) if most else None
        return self.kinds[c]

    def cells(self, s: np.ndarray, sums: np.ndarray, c: int) -> tuple[np.ndarray, int] | None:
        """The cells of a sorted set in a class, and how many of them a linked set has at least.

        Ranges in which two linked sets differ are at most ``apart``, so the others that the set fills agree. Two sets of
        which both fill too few for that have cells for their least hashes too, of which any two linked sets share one.
        """
        kind = self.kind(c)
        if kind is None:
            return None
        edges, own = kind
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        full = at[1:] > at[:-1]
        found = mix((sums[at[1:]] - sums[at[:-1]] + own)[full])
        need = len(found) - self.apart(len(s), self.tops[c])
        if need < 1:
            least = s[: len(s) - -(-self.num * len(s) // self.den) + 1]
            return np.concatenate([found, mix(least + np.uint64((c + 1) << 40))]), 1
        return found, min(need, 100)


def signatures(docs: DataFrame, k: int, num: int, den: int, packed: int = PACKED) -> DataFrame:
    """A row for each document (``doc_id, n, node, slot``), and rows of packed cells (``bucket, block, cells, owners, marks``)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, int(size / 6 * 2.4 * (den - num) / den))
    bits = min(22, max(4, (expected // 400_000).bit_length()))
    width = min(62, max(bits + 10, expected.bit_length() + 12))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranges, first = Ranges(num, den), TaskContext.get().partitionId() << 16
        seq, nodes, held, size = 0, {}, [], 0

        def row(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.record_batch([pa.array(columns[f], t) if f in columns else pa.nulls(n, t) for f, t in _FIELDS], names=[f for f, _ in _FIELDS])

        def done() -> pa.RecordBatch:
            cells = np.concatenate([h[0] for h in held]) >> np.uint64(64 - width)
            lengths = [len(h[0]) for h in held]
            owners = np.repeat(np.array([h[1] for h in held], np.int32), lengths)
            marks = np.repeat(np.array([h[2:] for h in held], np.int8), lengths, axis=0).T
            order = np.argsort(cells, kind="stable")
            cells, owners, marks = cells[order], owners[order], marks[:, order]
            at = np.append(np.searchsorted(cells, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)), len(cells))
            some = np.flatnonzero(np.diff(at))
            parts = [slice(at[i], at[i + 1]) for i in some]
            return row(bucket=some, block=[first | seq] * len(some), cells=[pack_sorted(cells[p]) for p in parts], owners=[pack(owners[p]) for p in parts], marks=[pack(marks[:, p]) for p in parts])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, part in slices(batch.column(1)):
                n, node, slot = [], [], []
                for i, s in enumerate(shingle_sets(part, k), start):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
                    own = int(mix(sums[-1:] + np.uint64(len(s)))[0])
                    n.append(len(s))
                    node.append(own - (1 << 64) if own >> 63 else own)
                    slot.append(None)
                    if not len(s) or ids[i] is None:
                        continue
                    if own not in nodes:
                        nodes[own] = len(nodes)
                        for c in ranges.kinds_of(len(s)):
                            found = ranges.cells(s, sums, c)
                            if found is not None:
                                held.append((found[0], nodes[own], c, found[1]))
                                size += len(found[0])
                    slot[-1] = (first | seq) << 20 | nodes[own]
                    if size >= packed or len(nodes) == 1 << 20:
                        yield row(doc_id=ids[i + 1 - len(n) : i + 1], n=n, node=node, slot=slot)
                        n, node, slot = [], [], []
                        if held:
                            yield done()
                        seq, nodes, held, size = seq + 1, {}, [], 0
                yield row(doc_id=ids[start + len(part) - len(n) : start + len(part)], n=n, node=node, slot=slot)
        if held:
            yield done()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, _SCHEMA)


def agreeing(packed: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``x, p, mark, cells``: in how many cells of a class the set at slot ``x`` agrees with others, by the first of them.

    Rows of a bucket are read in the order of their blocks. ``mark`` is the class times 128 and the least number that a link
    of ``x`` needs. The first of a cell has a row with itself.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunk, size, seen = None, [], 0, None

        def look() -> pa.RecordBatch:
            nonlocal seen
            keys, slots, marks = (np.concatenate(c) for c in zip(*chunk, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, slots, marks = keys[order], slots[order], marks[order]
            own, first, where, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            place = np.minimum(np.searchsorted(seen[0], own), max(len(seen[0]) - 1, 0))
            known = seen[0][place] == own if len(seen[0]) else np.zeros(len(own), bool)
            head, mark, told = slots[first], marks[first], np.zeros(len(own), bool)
            for column, values in zip((head, mark, told), seen[1:], strict=True):
                column[known] = values[place[known]]
            again = known | (counts > 1)
            rest = again[where]
            rest[first[~known]] = False
            fresh = again & ~told
            x, p, m = (np.concatenate(c) for c in ((slots[rest], head[fresh]), (head[where[rest]], head[fresh]), (marks[rest], mark[fresh])))
            if len(seen[0]):
                seen[3][place[known]] = True
            merged = [np.concatenate([a, b[~known]]) for a, b in zip(seen, (own, head, mark, again), strict=True)]
            order = np.argsort(merged[0], kind="stable")
            seen = [c[order] for c in merged]
            return pa.record_batch([pa.array(x), pa.array(p), pa.array(m.astype(np.int32))], names=["x", "p", "mark"])

        for batch in batches:
            for b, block, cells, owners, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if chunk:
                        yield look()
                    bucket, chunk, size = b, [], 0
                    seen = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
                keys, (kind, need) = unpack_sorted(cells), unpack(marks).astype(np.int64)
                chunk.append((keys, (block << 20) + unpack(owners)[0].astype(np.int64), kind * 128 + need))
                size += len(keys)
                if size >= at_once:
                    yield look()
                    chunk, size = [], 0
        if chunk:
            yield look()

    dealt = packed.select("bucket", "block", "cells", "owners", "marks").repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(find, "x long, p long, mark int").groupBy("x", "p", "mark").agg(F.count("*").alias("cells"))


def region_members(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``x, p, n, n_pivot, members``: every set that may have a link, with the pivots of its regions, both by the class's first id.

    ``members`` is about how many sets the pivot has, so nothing later needs to count and look that up.
    """
    pairs = save(agreeing(signed.where(F.col("bucket").isNotNull())), "agreeing")
    alive = pairs.groupBy("x", "mark").agg(F.sum("cells").alias("total")).where(F.col("total") >= F.col("mark") % 128).select("x", "mark")
    members = save(pairs.join(alive, ["x", "mark"], "left_semi").where("x <> p").select("x", "p").distinct(), "slots")
    slots = signed.where(F.col("slot").isNotNull()).select("slot", "node").distinct()
    named = slots.join(classes.select("node", "rep", "n"), "node")
    weights = members.groupBy(F.col("p").alias("slot")).agg(F.count("*").alias("m"))
    pivots = named.join(weights, "slot").select(F.col("slot").alias("p"), F.col("rep").alias("pivot"), F.col("n").alias("n_pivot"), F.col("m").alias("members"), "m")
    both = lookup(members, save(pivots, "pivots"), "p", "m")
    both = both.join(named.select(F.col("slot").alias("x"), F.col("rep").alias("own"), "n"), "x")
    out = save(both.where("own <> pivot").select(F.col("own").alias("x"), F.col("pivot").alias("p"), "n", "n_pivot", "members").distinct(), "members")
    discard(pairs, members)
    return out


def _with_texts(rows: DataFrame, key: str, docs: DataFrame) -> DataFrame:
    """``rows`` with the text of the document that ``key`` names; only the rows' side may be broadcast, if small."""
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).where(F.col("__id").isNotNull() & F.col("__text").isNotNull())
    return texts.join(sized(rows, PAIRS), F.col("__id") == F.col(key)).drop("__id")


def _measure(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``x, p, shared, nx, np`` for every pair of ids (``x, p, members``): exact set sizes and the size of the intersection."""
    chunked = pairs.select("x", "p", F.pmod(F.xxhash64("x"), F.ceil(F.col("members") / CHUNK)).cast("int").alias("chunk"))
    own = _with_texts(chunked.select("p", "chunk").distinct(), "p", docs).select("p", "chunk", F.lit(0).alias("kind"), F.col("p").alias("x"), "__text")
    members = _with_texts(chunked, "x", docs).select("p", "chunk", F.lit(1).alias("kind"), "x", "__text")
    rows = own.union(members).repartition("p", "chunk").sortWithinPartitions("p", "chunk", "kind", "x")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, out = None, [], ([], [], [], [], [])
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(4)]
            for start, part in slices(batch.column(4)):
                for i, s in enumerate(shingle_sets(part, k), start):
                    p, chunk, kind, x = (c[i] for c in ids)
                    if (p, chunk) != at:
                        at, pivot = (p, chunk), []
                    if kind == 0:
                        pivot.append(s)
                        continue
                    for q in pivot:  # several only where rows share a doc_id
                        for column, v in zip(out, (x, p, len(np.intersect1d(s, q, assume_unique=True)), len(s), len(q)), strict=True):
                            column.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["x", "p", "shared", "nx", "np"])
            out = ([], [], [], [], [])

    return rows.mapInArrow(measure, "x long, p long, shared long, nx long, np long")


class _Region:
    """Members of one region in one task: finds links, skipping pairs known to be connected."""

    def __init__(self, sets: list[np.ndarray], outer: np.ndarray, near: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int):
        self.n = np.array([len(s) for s in sets])
        flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.ids = inverse.reshape(-1)
        self.outer, self.low, self.high = outer, low, high
        self.num, self.den, self.eps = num, den, 1 - num / den
        self.root = np.arange(len(sets))
        self.words = len(flat)
        linked = np.flatnonzero(near)
        if len(linked):
            self.root[linked] = linked[0]
        self.links: list[tuple[int, int]] = []

    def shared(self, i: int, among: np.ndarray) -> np.ndarray:
        mark = np.zeros(self.words, bool)
        mark[self.ids[self.at[i] : self.at[i + 1]]] = True
        hits = np.concatenate([[0], np.cumsum(mark[self.ids])])
        return hits[self.at[among + 1]] - hits[self.at[among]]

    def link(self, i: int, j: int) -> None:
        self.links.append((i, j))
        self.root[self.root == self.root[j]] = self.root[i]

    def leaf(self, members: np.ndarray) -> None:
        members = members[np.argsort(self.n[members], kind="stable")]
        sub = np.concatenate([self.ids[self.at[m] : self.at[m + 1]] for m in members])
        owner = np.repeat(np.arange(len(members)), self.n[members])
        order = np.argsort(sub, kind="stable")
        sub, owner = sub[order], owner[order]
        first = np.searchsorted(sub, np.arange(self.words + 1)) if self.words < 4 * len(sub) else None
        for a, i in enumerate(members):
            later = members[a + 1 :]
            fits = (self.n[later] * self.num <= self.n[i] * self.den) & (self.root[later] != self.root[i]) & (self.outer[i] | self.outer[later])
            fits &= (self.low[later] - self.high[i] <= self.eps + 1e-9) & (self.low[i] - self.high[later] <= self.eps + 1e-9)
            if not fits.any():
                continue
            mine = self.ids[self.at[i] : self.at[i + 1]]
            lo, hi = (first[mine], first[mine + 1]) if first is not None else (np.searchsorted(sub, mine), np.searchsorted(sub, mine, side="right"))
            more = hi - lo > 1
            lo, hi = lo[more], hi[more]
            counts = np.zeros(len(members), np.int64)
            if len(lo):
                runs = hi - lo
                places = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                counts = np.bincount(owner[places], minlength=len(members))
            both = counts[a + 1 :]
            good = fits & (self.den * both >= self.num * (self.n[i] + self.n[later] - both))
            for j in later[good]:
                if self.root[i] != self.root[j]:
                    self.link(int(i), int(j))

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        if len(members) <= 256 or depth >= 8:
            return self.leaf(members)
        pivots = members[np.linspace(0, len(members) - 1, 4).astype(int)]
        d = np.empty((4, len(members)))
        for k, p in enumerate(pivots):
            s = self.shared(int(p), members)
            d[k] = 1 - s / (self.n[p] + self.n[members] - s)
            for j in members[d[k] <= self.eps / 2]:  # pairwise within eps, by the triangle inequality
                if self.root[j] != self.root[p]:
                    s1 = self.shared(int(p), np.array([j]))[0]
                    if self.den * s1 >= self.num * (self.n[p] + self.n[j] - s1):
                        self.link(int(p), int(j))
        cells = [np.flatnonzero(d[k] <= d.min(axis=0) + 2 * self.eps + 1e-9) for k in range(4)]
        if max(map(len, cells)) > 0.7 * len(members):
            return self.leaf(members)
        for cell in cells:
            if len(cell) > 1:
                self.join(members[cell], depth + 1)


def _fits(num: int, den: int) -> Column:
    """Whether a member and its pivot are near enough in size to link."""
    return F.least("n", "n_pivot") * den >= F.greatest("n", "n_pivot") * num


def _region_links(star: DataFrame, members: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``x, y``: links among the members of pivots' regions that the pivots themselves do not settle."""
    eps = 1 - num / den
    union = F.col("nx") + F.col("np") - F.col("shared")
    known = star.groupBy("x", "p").agg(F.max_by(F.struct("shared", "nx", "np"), F.col("shared") / union).alias("s")).select("x", "p", "s.*")
    known = known.withColumn("d", 1 - F.col("shared") / union).withColumn("linked", den * F.col("shared") >= num * union)
    measured = known.select("x", "p", F.col("nx").alias("n"), F.col("linked").alias("near"), F.col("d").alias("low"), F.col("d").alias("high"))
    bound = 1 - F.least("n", "n_pivot") / F.greatest("n", "n_pivot")
    bounded = members.where(~_fits(num, den)).select("x", "p", "n", F.lit(False).alias("near"), bound.alias("low"), F.lit(1.0).alias("high"))
    rows = save(measured.union(bounded), "region-members")
    # All that a region's members need to know of it, in one pass: the least distance of those out of the pivot's reach,
    # whether there are two members left to meet, and whether they might be too many for a task.
    regions = rows.groupBy("p").agg(F.min(F.when(~F.col("near"), F.col("low"))).alias("nearest"), F.count_if(~F.col("near")).alias("out"), F.max(F.when(F.col("near"), F.col("low"))).alias("reach"), (F.sum("n") > BLOCK).alias("many"), F.count("*").alias("m"))
    boundary = F.col("nearest") - eps - 1e-9
    regions = regions.where(F.col("nearest").isNotNull() & ((F.col("out") > 1) | (F.col("reach") >= boundary))).select("p", "nearest", "many", "m")
    # Only members out of reach of the pivot, and linked ones in the boundary.
    left = lookup(rows, regions, "p", "m").where(F.col("nearest").isNotNull() & (~F.col("near") | (F.col("low") >= boundary))).drop("nearest")
    band = F.when(F.col("low") < F.col("high"), F.lit(-1)).otherwise(F.floor(F.col("low") * 2 / eps)).cast("int")
    banded = save(left.withColumn("band", F.when(F.col("many"), band).otherwise(F.lit(0))), "region-open")
    parts = banded.where("many").groupBy("p", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    blocks = parts.select("p", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    a = blocks.select(F.col("p").alias("p"), F.struct("band", "part").alias("a"))
    b = blocks.select(F.col("p").alias("q"), F.struct("band", "part").alias("b"))
    meets = (F.col("a.band") < 0) | (F.col("b.band") < 0) | (F.abs(F.col("a.band") - F.col("b.band")) <= 3)
    tasks = a.join(b, (F.col("p") == F.col("q")) & (F.col("a") <= F.col("b")) & meets).select("p", "a", "b")
    tasks = tasks.select("p", F.explode(F.array_distinct(F.array("a", "b"))).alias("own"), F.concat_ws("/", "a.band", "a.part", "b.band", "b.part").alias("task"))
    large = banded.where("many").join(parts, ["p", "band"]).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    large = large.join(tasks.select("p", "own.band", "own.part", "task"), ["p", "band", "part"])
    keep = ["p", "task", "x", "near", "low", "high"]
    placed = save(banded.where(~F.col("many")).withColumn("task", F.lit("")).select(*keep).union(large.select(*keep)), "region-tasks")
    rows = _with_texts(placed, "x", docs).select(*keep, "__text").repartition("p", "task").sortWithinPartitions("p", "task", "x")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def done() -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            usable = [g for g in group if len(g[4])]
            if len(usable) > 1:
                near = np.array([g[1] for g in usable])
                region = _Region([g[4] for g in usable], ~near, near, np.array([g[2] for g in usable]), np.array([g[3] for g in usable]), num, den)
                region.join(np.arange(len(usable)))
                out = [(usable[i][0], usable[j][0]) for i, j in region.links]
            return pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["x", "y"])

        for batch in batches:
            p, task, x, near, low, high = (batch.column(i).to_pylist() for i in range(6))
            for start, part in slices(batch.column(6)):
                for i, s in enumerate(shingle_sets(part, k), start):
                    if (p[i], task[i]) != at:
                        if group:
                            yield done()
                        at, group = (p[i], task[i]), []
                    group.append((x[i], near[i], low[i], high[i], s))
        if group:
            yield done()

    return rows.mapInArrow(join, "x long, y long")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, packed: int = PACKED) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; documents link where ``den * |x & y| >= num * |x | y|``."""
    signed = save(signatures(docs, k, num, den, packed), "signatures")
    rows = signed.where(F.col("bucket").isNull()).select("doc_id", "n", "node")
    real = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = save(real.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")), "classes")
    members = region_members(signed, classes)
    star = save(_measure(members.where(_fits(num, den)).select("x", "p", "members"), docs, k), "star")
    linked = star.where(den * F.col("shared") >= num * (F.col("nx") + F.col("np") - F.col("shared"))).select("x", F.col("p").alias("y"))
    found = components(linked.union(_region_links(star, members, docs, k, num, den))).select(F.col("node").alias("rep"), "component")
    facts = save(classes.join(found, "rep", "left").select("node", F.coalesce("component", "rep").alias("c"), "copies"), "class-components")
    # A doc_id with several texts belongs to several classes, which it connects.
    out = lookup(real, facts, "node", "copies").select("doc_id", "n", F.col("c"))
    rest = rows.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("c"))
    return out.union(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


#: Rows without a ``doc_id`` of their own get ids from here on, made from their texts.
OWN_IDS = 1 << 61


def keep_one_per_component(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group that links, directly or not: the one with the smallest ``doc_id``.

    Rows whose ``doc_id`` is null or names several texts go by their text and come after the others; of rows that are
    equal in id and text one stays (by a hash of all columns). Texts without words all stay.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__repeated")).agg(F.count("*").alias("m"), F.min(digest).alias("a"), F.max(digest).alias("b"))
    repeated = save(repeated.where("m > 1").select("__repeated", (F.col("a") != F.col("b")).alias("__shared")), "repeated-ids")
    marked = docs.join(sized(repeated), F.col("doc_id") == F.col("__repeated"), "left")
    by_text = digest.bitwiseAND(F.lit(OWN_IDS - 1)) + F.lit(OWN_IDS)
    marked = marked.withColumn("__id", F.when(F.col("doc_id").isNull() | F.coalesce("__shared", F.lit(False)), by_text).otherwise(F.col("doc_id").cast("long")))
    found = jaccard_components(marked.select(F.col("__id").alias("doc_id"), "text"), k, num, den)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    left = marked.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    several = (F.col("doc_id").isNull() | F.col("__repeated").isNotNull()) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if at_most(left.where(several), 0):
        return left.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = left.where(several).groupBy("__id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return left.where(~several).select(*docs.columns).unionByName(once)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))

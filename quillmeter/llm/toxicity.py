"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text.

Word and bigram counts of both classes are gathered over all labelled rows that are not held out, all of them, in written
tables that grow with the corpus. Each class has an interpolated model: absolute-discounted bigrams, then its discounted
words, then backoff probabilities by continuation counts (how many different words precede a word) that both classes
share; so an expression that one class has rarely or never seen costs both alike.

Documents are cut into blocks of at most ``BLOCK`` words. A block asks for its distinct bigrams and words only, dealt by
hash, so a frequent one is asked for once a block and no task gets more than its share of the keys. What travels are
packed sorted arrays, answered in the order asked, in ``TURNS`` turns over all blocks.

A document's evidence is the log-likelihood ratio of the two models, in three parts: its words by themselves, and what
bigrams add to them that are seen ``OFTEN`` times or more, and all rarer ones. Each part is normalised by length in two
ways: its mean over the words, and what single words add above ``STRONG`` nats, over the root of the word count. A logistic
curve fitted on ``SAMPLE`` labelled rows weighs the six (no weight below 0: evidence never counts against itself), then is
placed with both classes weighing alike, and gives a score from 0 to 1; so how far rare bigrams are to be trusted is
learned, and none is left out. Every document that taught is judged without its own counts,
in the fit and in the result.

Defined cases: null or wordless text scores as a text without evidence; very long texts are whole; repeated rows are judged alike, so
there are no ties to break; labels that are
null or of unknown documents teach nothing, a document with several labels is toxic if any is 1; without rows of both
classes the score is 0 everywhere; an empty table gives an empty result; a null ``doc_id`` is not held out and teaches
nothing; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, mix, pack, pack_sorted, save, sized, slices, table, unpack, unpack_sorted, word_hashes

SAMPLE, BLOCK, TURNS = 10_000, 1_000_000, 4
DISCOUNT, STRONG, OFTEN, THRESHOLD, PULL = 0.75, 3.0, 5, 0.7, 1e-3
#: Bytes between words: everything in ASCII but letters and digits.
_BREAKS = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127) for b in range(256)])
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_KEYS = "bucket int, block string, keys binary, counts binary"
#: Counts of a word: words before it, toxic, plain; toxic and plain words after it, different ones of each.
_WORD = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int8 if a.size == 0 or a.max() < 128 else np.int32 if a.max() < 1 << 31 else np.uint64)


@dataclass(frozen=True)
class Widths:
    """Bits of a bucket's number, of a pair's key and of a word's key."""

    bucket: int
    pair: int
    word: int

    @classmethod
    def of(cls, words: int) -> Widths:
        """By the number of words: of a billion lookups of pairs that nothing holds, fewer than 100,000 meet another pair's
        counts, and words share a key as rarely; wider keys would only fill the shuffles.
        """
        bucket = max(10, (words * 6 >> 22).bit_length())
        return cls(bucket, min(62, max(bucket + 8, words.bit_length() + 11)), min(62, max(bucket + 8, words.bit_length() + 14)))


def _cuts(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where each of the 2**bits ranges of sorted keys of ``width`` bits begins, and the end."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)), len(keys))


def _pair_keys(before: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    return mix(before * _PAIR + word) >> np.uint64(64 - width)


def _befores(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each word's predecessor (0 before a text's first word)."""
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[at[:-1][at[:-1] < at[1:]]] = 0
    return before


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Runs of rows: doc_ids (Arrow), marks (1 toxic, 0 plain, -1 untaught), word hashes and each row's first word."""
    ids, marks, hashes, sizes, n = [], [], [], [], 0

    def done():
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        return pa.concat_arrays(ids), np.concatenate(marks), np.concatenate(hashes), at

    for batch in batches:
        toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, part in slices(batch.column(1)):
            h, at = word_hashes(part, fold=True, breaks=_BREAKS)
            h = h >> np.uint64(64 - width)
            ids.append(batch.column(0).slice(start, len(part)))
            marks.append(toxic[start : start + len(part)])
            hashes.append(h)
            sizes.append(np.diff(at))
            n += len(h)
            if n >= BLOCK:
                yield done()
                ids, marks, hashes, sizes, n = [], [], [], [], 0
    if ids:
        yield done()


def _rows(names: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(names)


def _keyed(bucket: list, block: list, keys: list, counts: list) -> pa.RecordBatch:
    return _rows({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.string()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _dealt(keys: np.ndarray, counts: np.ndarray, widths: Widths) -> pa.RecordBatch:
    """Sorted keys and their counts, a row for each bucket that has any."""
    at = _cuts(keys, widths.bucket, widths.word)
    full = np.flatnonzero(np.diff(at))
    return _keyed(full, [None] * len(full), [pack_sorted(keys[at[i] : at[i + 1]]) for i in full], [pack(_small(counts[:, at[i] : at[i + 1]])) for i in full])


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.array([np.bincount(inverse, weights=c, minlength=len(unique)) for c in counts], np.float64).astype(np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Bucket and its (keys, counts) of sorted rows."""
    current, rows = None, []
    for batch in batches:
        for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
            if bucket != current and rows:
                yield current, rows
                rows = []
            current = bucket
            rows.append((keys, counts))
    if rows:
        yield current, rows


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def pair_counts(rows: DataFrame, widths: Widths) -> DataFrame:
    """Buckets of (before, word) and (toxic, plain) counts over rows of (doc_id, text, toxic)."""
    bits, width = widths.bucket, widths.pair

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, marks, h, at in _blocks(batches, widths.word):
            before, toxic = _befores(h, at), np.repeat(marks, np.diff(at))
            _, first, inverse = np.unique(_pair_keys(before, h, width), return_index=True, return_inverse=True)
            t = np.bincount(inverse, weights=toxic, minlength=len(first)).astype(np.int64)
            counts = np.array([t, np.bincount(inverse, minlength=len(first)) - t])
            before, word = before[first], h[first]
            bucket = (_pair_keys(before, word, width) >> np.uint64(width - bits)).astype(np.int64)
            order = np.lexsort((before, word, bucket))
            ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(ends))
            runs = [order[ends[i] : ends[i + 1]] for i in full]
            yield _keyed(full, [None] * len(full), [pack(np.array([before[r], np.diff(word[r], prepend=np.uint64(0))])) for r in runs], [pack(_small(counts[:, r])) for r in runs])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys = [unpack(k) for k, _ in rows]
            before = np.concatenate([k[0] for k in keys])
            word = np.concatenate([np.cumsum(k[1], dtype=np.uint64) for k in keys])
            pair = _pair_keys(before, word, width)
            unique, counts = _sums(pair, np.concatenate([unpack(c) for _, c in rows], axis=1))
            _, first = np.unique(pair, return_index=True)
            yield _rows({"bucket": pa.array([bucket], pa.int32()), "block": pa.array([None], pa.string()), "keys": [pack_sorted(unique)], "counts": [pack(_small(counts))], "ends": [pack(np.array([before[first], word[first]]))]})

    return _together(rows.select("doc_id", "text", "toxic").mapInArrow(count, _KEYS)).mapInArrow(merge, _KEYS + ", ends binary")


def word_counts(pairs: DataFrame, widths: Widths) -> DataFrame:
    """Buckets of words and their ``_WORD`` counts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for counts, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, (before, word) = unpack(counts).astype(np.int64), unpack(ends)
                one, none = np.ones(n.shape[1], np.int64), np.zeros(n.shape[1], np.int64)
                of_word = np.array([one, *n, none, none, none, none])
                of_before = np.array([none, none, none, *n, *(n > 0)])
                held.append(_sums(np.concatenate([word, before]), np.concatenate([of_word, of_before], axis=1)))
                size += len(held[-1][0])
                if size >= BLOCK:
                    yield _dealt(*_sums(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))), widths)
                    held, size = [], 0
        if held:
            yield _dealt(*_sums(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))), widths)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys, counts = _sums(np.concatenate([unpack_sorted(k) for k, _ in rows]), np.concatenate([unpack(c) for _, c in rows], axis=1))
            totals = [counts[1].sum(), counts[2].sum(), (counts[1] > 0).sum(), (counts[2] > 0).sum(), counts[0].sum(), (counts[0] > 0).sum()]
            yield _rows({"bucket": pa.array([bucket], pa.int32()), "block": pa.array([None], pa.string()), "keys": [pack_sorted(keys)], "counts": [pack(_small(counts))], "totals": pa.array([totals], pa.list_(pa.int64()))})

    return _together(pairs.select("counts", "ends").mapInArrow(parts, _KEYS)).mapInArrow(merge, _KEYS + ", totals array<long>")


def _answers(asked: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """``block, bucket, counts`` for every row of asked keys, in their order; keys that are not known count 0."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table, counts = None, None, None
        for batch in batches:
            out = []
            for bucket, block, keys, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != current:
                    current, table, counts = bucket, np.zeros(0, np.uint64), np.zeros((width, 0), np.int64)
                if block is None:
                    table, counts = unpack_sorted(keys), unpack(values)
                    continue
                keys = unpack_sorted(keys)
                found = np.zeros((width, len(keys)), np.int64)
                if len(table):
                    spot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                    hit = table[spot] == keys
                    found[:, hit] = counts[:, spot[hit]]
                out.append((block, bucket, pack(_small(found))))
            if out:
                yield _rows({"block": [x[0] for x in out], "bucket": pa.array([x[1] for x in out], pa.int32()), "counts": [x[2] for x in out]})

    both = asked.select("bucket", "block", "keys", "counts").unionByName(known.select("bucket", "block", "keys", "counts"))
    both = both.repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    return both.mapInArrow(answer, "block string, bucket int, counts binary")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float) -> np.ndarray:
    """Intercept and slopes, none below 0, of a logistic curve on standardised columns.

    ``pull`` is the penalty for each row, so it means the same at every size. Newton steps over the slopes that are not held
    at 0 are halved until the penalised loss falls, so rows that are (nearly) separable cannot make them run away.
    """
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - middle) / spread])
    penalty = np.diag([pull / 1000, *[pull] * x.shape[1]]) * len(x)

    def loss(b: np.ndarray) -> float:
        m = z @ b
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + b @ penalty @ b / 2)

    b = np.zeros(z.shape[1])
    now = loss(b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        slope = z.T @ (weight * (p - y)) + penalty @ b
        curvature = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + penalty
        free = (b > 0) | (slope < 0)
        free[0] = True
        step = np.zeros(len(b))
        step[free] = np.linalg.solve(curvature[np.ix_(free, free)], slope[free])
        for halving in range(60):
            tried = b - step / 2**halving
            tried[1:] = np.maximum(tried[1:], 0)
            new = loss(tried)
            if new <= now:
                break
        else:
            new, tried = now, b
        moved, gained = np.abs(tried - b).max(), now - new
        b, now = tried, new
        if moved < 1e-9 or gained <= 1e-10 * max(1.0, now):
            break
    else:
        raise RuntimeError("the logistic curve did not settle")
    slopes = b[1:] / spread
    return np.concatenate([[b[0] - slopes @ middle], slopes])


@dataclass
class Model:
    """Both classes' written tables, ``totals`` and the curve."""

    pairs: DataFrame
    words: DataFrame
    taught: DataFrame
    widths: Widths
    #: Toxic and plain words, different toxic and plain words, different pairs, different words.
    totals: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([-20.0] + [0.0] * 6))

    def ready(self) -> bool:
        return bool((self.totals[:2] > 0).all())

    def fit(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """The curve over rows of features: their weights first, then its place and slope with both classes weighing alike."""
        y = toxic.astype(float)
        direction = _logistic(x, y, np.ones(len(y)), PULL)
        along = x @ direction[1:]
        alike = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        place, slope = _logistic(along[:, None], y, alike, PULL / 100)
        self.curve = np.concatenate([[place], slope * direction[1:]])


def _ratio(w, v, pair, doc, marks, vocab_counts, pair_n, totals) -> np.ndarray:
    """log P(toxic) - log P(ordinary) of every word by itself, and what frequent and rare bigrams add to it.

    ``w``, ``v``, ``pair``, ``doc`` are places a word. Counts of a document that taught are taken out for itself.
    """
    if not len(w):
        return np.zeros((3, 0))
    mark = marks[doc]
    some = np.flatnonzero(mark >= 0)
    sizes = np.bincount(doc, minlength=len(marks))[doc[some]]
    own_some, own_types, by_class = np.zeros(len(some)), np.zeros(len(some)), []
    if len(some):

        def own(places):
            places = places[some]
            _, first, inverse, counts = np.unique(doc[some] * (np.int64(places.max()) + 1) + places, return_index=True, return_inverse=True, return_counts=True)
            return first, inverse, counts[inverse]

        first, _, own_some = own(pair)
        by_word, by_before = own(w), own(v)

        def alone(inverse, flags):
            """Pairs of the document that nothing else has, by its words (or the words before)."""
            return np.bincount(inverse[first], weights=flags[first], minlength=inverse.max() + 1)[inverse]

        own_types = alone(by_word[1], pair_n.sum(axis=0)[pair[some]] == own_some)
        for c in (0, 1):
            mine = mark[some] == 1 - c
            by_class.append((mine * own_some, mine * by_before[2], alone(by_before[1], mine & (pair_n[c][pair[some]] == own_some)), mine * by_word[2], mine * sizes))

    def less(counts, out):
        counts = counts.astype(np.float64)
        counts[some] -= out
        return counts

    shared = (less(vocab_counts[0][w], own_types) + 1) / (totals[4] + totals[5] + 1)
    out = []
    for c in (0, 1):
        own_pair, own_follow, own_different, own_n, own_all = by_class[c] if by_class else [np.zeros(0)] * 5
        n_pair = less(pair_n[c][pair], own_pair)
        follow = less(vocab_counts[3 + c][v], own_follow)
        different = less(vocab_counts[5 + c][v], own_different)
        n = less(vocab_counts[1 + c][w], own_n)
        total = np.maximum(less(np.full(len(w), totals[c]), own_all), 1)
        p = np.maximum(n - DISCOUNT, 0) / total + DISCOUNT * totals[2 + c] / total * shared
        gamma = np.where(follow > 0, DISCOUNT * different / np.maximum(follow, 1), 1)
        both = gamma * p + np.maximum(n_pair - DISCOUNT, 0) / np.maximum(follow, 1)
        out.append((np.log(np.maximum(p, 1e-30)), np.log(np.maximum(both, 1e-30))))
    word, full = (out[0][i] - out[1][i] for i in (0, 1))
    often = less(pair_n.sum(axis=0)[pair], own_some) >= OFTEN
    return np.array([word, np.where(often, full - word, 0), np.where(often, 0, full - word)])


def features(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, toxic, evidence`` (means, then strong ones) for every row of ``docs``; toxic is -1 if the row taught nothing.

    The result is read from written tables.
    """
    widths, totals = model.widths, model.totals

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, h, at in _blocks(batches, widths.word):
            vocab, places, counts = np.unique(h, return_inverse=True, return_counts=True)
            # Frequent words get the small places, which pack best.
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield _rows({"block": [uuid.uuid4().hex], "ids": listed, "words": [pack(rank[places])], "vocab": [pack(vocab[order])], "rows": [pack(np.array([marks + 1, np.diff(at)], np.int32))]})

    def load(words, vocab, rows):
        """Vocabulary with 0 first, places of each word and the one before in it, pairs and their places, rows."""
        vocab = unpack(vocab)[0]
        order = np.argsort(vocab)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        vocab = np.concatenate([np.zeros(1, np.uint64), vocab[order]])
        w, (marks, sizes) = place[unpack(words)[0]], unpack(rows).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        v = _befores(w, at)
        pairs, place = np.unique(_pair_keys(vocab[v], vocab[w], widths.pair), return_inverse=True)
        return vocab, w, v, pairs, place, marks - 1, at

    def ask(which: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, *rest in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "vocab", "rows")), strict=True):
                    keys = load(*rest)[which]
                    at = _cuts(keys, widths.bucket, widths.pair if which == 3 else widths.word)
                    full = np.flatnonzero(np.diff(at))
                    yield _keyed(full, [block] * len(full), [pack_sorted(keys[at[i] : at[i + 1]]) for i in full], [None] * len(full))

        return run

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got = None, {}

        def done():
            ids, *rest = got["rows"]
            vocab, w, v, pairs, place, marks, at = load(*rest)
            sized_ = np.diff(at)
            ratio = _ratio(w, v, place, np.repeat(np.arange(len(sized_)), sized_), marks, np.concatenate(got[2], axis=1), np.concatenate(got[1], axis=1), totals) if len(w) else np.zeros((3, 0))
            sums = np.concatenate([np.zeros((6, 1)), np.cumsum(np.concatenate([ratio, np.maximum(ratio - STRONG, 0)]), axis=1)], axis=1)
            n = np.maximum(sized_, 1)
            found = (sums[:, at[1:]] - sums[:, at[:-1]]) / np.concatenate([[n] * 3, [np.sqrt(n)] * 3])
            return _rows({"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(marks, pa.int32()), "evidence": pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 6, pa.int32()), pa.array(found.T.ravel()))})

        for batch in batches:
            for key, kind, counts, ids, *rest in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "counts", "ids", "words", "vocab", "rows")), strict=True):
                if key != block and block is not None:
                    yield done()
                    got = {}
                block = key
                if kind == 0:
                    got["rows"] = (ids, *rest)
                else:
                    got.setdefault(kind, []).append(unpack(counts))
        if block is not None:
            yield done()

    marked = docs.select(F.col("doc_id").cast("long"), "text").join(sized(model.taught), F.col("doc_id") == F.col("__id"), "left")
    marked = marked.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.coalesce("toxic", F.lit(-1))).otherwise(-1).cast("int").alias("toxic"))
    blocks = save(marked.mapInArrow(store, "block string, ids array<long>, words binary, vocab binary, rows binary"), "toxicity-blocks")
    parts = []
    # The blocks ask in turns, so the scratch space of questions and answers is that of a part of them.
    for turn in range(TURNS):
        some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(TURNS)) == turn)
        rows, answered = some.withColumn("kind", F.lit(0)), []
        for kind, which, known, columns in ((1, 3, model.pairs, 2), (2, 0, model.words, _WORD)):
            asked = some.select("block", "words", "vocab", "rows").mapInArrow(ask(which), _KEYS)
            answered.append(save(_answers(asked, known, columns), "toxicity-counts"))
            rows = rows.unionByName(answered[-1].withColumn("kind", F.lit(kind)), True)
        rows = rows.repartition("block").sortWithinPartitions("block", "kind", "bucket")
        parts.append(save(rows.mapInArrow(judge, "doc_id long, toxic int, evidence array<double>"), "toxicity-evidence"))
        discard(*answered)
    discard(blocks)
    return reduce(DataFrame.union, parts)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Count the rows of ``docs`` that have a label and are not held out; ``fit`` makes the curve."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    taught = marks.where(~held_out(F.col("__id")))
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    widths = Widths.of(max(1, size // 6))
    rows = texts.join(sized(taught), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic")
    counted = save(pair_counts(rows, widths), "pair-counts")
    words = save(word_counts(counted, widths), "word-counts")
    pairs = save(counted.select("bucket", "block", "keys", "counts"), "pairs")
    discard(counted)
    totals = np.zeros(6, np.int64)
    for row in words.agg(*[F.coalesce(F.sum(F.get("totals", F.lit(i))), F.lit(0)) for i in range(6)]).collect():
        totals += np.array(row)
    return Model(pairs, words, taught, widths, totals)


def fit(model: Model, evidence: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the curve on at most ``sample`` of the rows that taught, in the order of a hash of ``doc_id``."""
    known = evidence.where("toxic >= 0").orderBy(F.xxhash64("doc_id"), "doc_id", "evidence").limit(sample).toPandas()
    if known["toxic"].nunique() == 2:
        model.fit(np.array(known["evidence"].tolist()), known["toxic"].to_numpy())
    return model


def score(evidence: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``features``."""
    logit = F.lit(float(model.curve[0])) + sum((float(b) * F.get("evidence", F.lit(i)) for i, b in enumerate(model.curve[1:])), F.lit(0.0))
    scored = evidence.select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from ``docs`` and ``labels`` and score every row of ``docs``."""
    model = train(docs, labels)
    if not model.ready():
        none = docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))
        return none.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.lit(0).alias("predicted"))
    evidence = features(docs, model)
    discard(model.pairs, model.words)
    return score(evidence, fit(model, evidence, sample), threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels"))

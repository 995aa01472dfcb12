"""Quality classifier by co-training of two views.

The content view sees the words of a text (hashed) and nothing else. The metadata view sees what describes the page and not
its words: source, language, length class and layout (shares of capitals, symbols, marks, digits, line breaks, and of words
said twice in a row). Both start from a bounded labelled sample. In each round both judge all unlabelled documents in a
distributed pass, and each hands the documents of each label that it is surest of to the other, as training rows chosen
anew each round. Afterwards each view's logit is calibrated on labelled rows that neither trained on, and a logistic curve
with weights of at least 0 over both combines them. Every document is then scored from its whole text.

Bounds (parameters) hold for the rows of a fit only: ``LABELLED`` labelled rows in the order of a hash of ``doc_id``, of
which every third calibrates, and in round r at most r times ``EACH`` pseudo-labelled rows of a label and view, dealt in
turns over the groups of source and language, the surest of each first, if they are at least ``CONFIDENT``. What the driver
gets are feature rows made on the executors, at most 64 KiB each, not texts.

Defined cases: null text has no words; very long texts are whole; null source, lang or n_chars are classes of their own;
ties between documents of which a view is equally sure go by a hash of ``doc_id``; a null ``doc_id`` is scored and teaches
nothing; labels that are null or of unknown documents are ignored, of several labels of a document the least counts;
without both classes among the labels every score is 0.5 and all is kept; repeated rows are scored alike; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, save, sized, slices, table, word_hashes

LABELLED, ROUNDS, CONFIDENT, EACH = 3000, 3, 0.9, 300
WORDS, META, LAYOUT, PARTS = 1 << 14, 1 << 12, 6, 32
THRESHOLD = 0.5
_KINDS = np.zeros((5, 256), np.float32)
_KINDS[0, 65:91] = 1  # capitals
_KINDS[1, [ord(c) for c in "#*$%&|<>"]] = 1
_KINDS[2, [ord(c) for c in "!?"]] = 1
_KINDS[3, 48:58] = 1
_KINDS[4, 10] = 1


class Rows:
    """Sparse rows (places, values, each row's first) with dense columns beside them."""

    def __init__(self, places, values, at, dense):
        self.places, self.values, self.at, self.dense = places, values, at, dense

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, ids: np.ndarray) -> Rows:
        sizes = self.at[ids + 1] - self.at[ids]
        to = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(self.at[ids] - to[:-1], sizes) + np.arange(to[-1])
        return Rows(self.places[where], self.values[where], to, self.dense[ids])

    def plus(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("places", "values")), np.concatenate([self.at, self.at[-1] + other.at[1:]]), np.concatenate([self.dense, other.dense]))


def content_rows(texts: pa.Array) -> Rows:
    """The words of texts: share of each bucket, by the root of the word count."""
    h, at = word_hashes(texts, fold=True)
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    keys, counts = np.unique(owner * WORDS + (h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64), return_counts=True)
    values = counts / np.sqrt(np.maximum(np.diff(at), 1))[keys // WORDS]
    return Rows((keys % WORDS).astype(np.uint16), values.astype(np.float16), np.searchsorted(keys, np.arange(n + 1) * WORDS), np.zeros((n, 0), np.float32))


def layout(texts: pa.Array) -> np.ndarray:
    """Six figures a text: shares of five kinds of characters, and of words that repeat the one before."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds, size = offsets - offsets[0], np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, LAYOUT), np.float32)
    for k in range(5):
        sums = np.concatenate([[0], np.cumsum(_KINDS[k][data], dtype=np.float64)])
        out[:, k] = (sums[bounds[1:]] - sums[bounds[:-1]]) / size
    h, at = word_hashes(texts, fold=False)
    again = np.zeros(len(h) + 1)
    if len(h) > 1:
        again[2:] = np.cumsum(h[1:] == h[:-1])
    out[:, 5] = (again[at[1:]] - again[np.minimum(at[:-1] + 1, at[1:])]) / np.maximum(np.diff(at), 1)
    return out * 10


def meta_rows(texts: pa.Array, source, lang, n_chars) -> Rows:
    """Hashed places of (source), (lang), (source, lang) and length class, and the layout."""
    places = np.empty((len(source), 4), np.uint16)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        length = "none" if n is None else str(int(n).bit_length())
        for k, part in enumerate((f"s {s}", f"l {g}", f"b {s} {g}", f"n {length}")):
            places[i, k] = zlib.crc32(part.encode()) % META
    return Rows(places.ravel(), np.full(places.size, 0.5, np.float16), np.arange(len(places) + 1) * 4, layout(texts))


class Linear:
    """Logistic regression over sparse and dense features, by damped full-batch steps."""

    def __init__(self, size: int, dense: int):
        self.w, self.v, self.b = np.zeros(size), np.zeros(dense), 0.0

    def logit(self, x: Rows) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.w[x.places] * x.values)])
        return self.b + sums[x.at[1:]] - sums[x.at[:-1]] + x.dense @ self.v

    def fit(self, x: Rows, y: np.ndarray, steps: int = 80, rate: float = 0.5, pull: float = 1e-4) -> Linear:
        share = max(y.mean(), 1e-3), max(1 - y.mean(), 1e-3)
        weight = np.where(y > 0.5, 0.5 / share[0], 0.5 / share[1]) / len(y)
        owner, values = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(x.at)), x.values.astype(np.float64)
        squares = [np.full(len(self.w), 1e-8), np.full(len(self.v), 1e-8), 1e-8]
        for _ in range(steps):
            g = (_sigmoid(self.logit(x)) - y) * weight
            grads = [np.bincount(x.places, weights=g[owner] * values, minlength=len(self.w)) + pull * self.w, x.dense.T @ g + pull * self.v, g.sum()]
            squares = [s + d * d for s, d in zip(squares, grads, strict=True)]
            moves = [rate * d / np.sqrt(s) for s, d in zip(squares, grads, strict=True)]
            self.w, self.v, self.b = self.w - moves[0], self.v - moves[1], self.b - moves[2]
        return self


def _platt(logits: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic curve over columns of logits (and 1) with slopes of at least 0, and a weak pull to 0."""
    use = list(range(logits.shape[1]))
    while True:
        x = np.column_stack([np.ones(len(y)), logits[:, use]])
        b = np.zeros(x.shape[1])
        for _ in range(steps):
            p = _sigmoid(x @ b)
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(len(b)), x.T @ (p - y) + 0.05 * b)
            b = b - np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        if len(b) == 1 or b[1:].min() >= 0:
            out = np.zeros(logits.shape[1] + 1)
            out[[0, *(i + 1 for i in use)]] = b
            return out
        use.pop(int(np.argmin(b[1:])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


VIEWS = ("text", "meta")


class CoTrained:
    """Both views, their calibration and the curve that combines them."""

    def __init__(self):
        self.views = {"text": Linear(WORDS, 0), "meta": Linear(META, LAYOUT)}
        self.curves = {v: np.zeros(2) for v in VIEWS}
        self.both = np.zeros(3)
        #: A round's rows handed to each view, by label: {"text": [bad, good], "meta": [bad, good]}.
        self.exchanged: list[dict[str, list[int]]] = []
        #: Share of the calibration rows that each view, and both, judge as labelled.
        self.agreement: dict[str, float] = {}

    def logits(self, rows: dict[str, Rows]) -> np.ndarray:
        return np.column_stack([self.curves[v][0] + self.curves[v][1] * self.views[v].logit(rows[v]) for v in VIEWS])

    def scores(self, rows: dict[str, Rows]) -> np.ndarray:
        """Columns: text, meta, both."""
        z = self.logits(rows)
        return np.column_stack([_sigmoid(z), _sigmoid(self.both[0] + z @ self.both[1:])])

    def fit(self, known: dict[str, Rows], y: np.ndarray, rounds: int, exchange) -> CoTrained:
        """``exchange``: from the model as it is to ``{view: (rows, labels)}`` of what the other view is sure of."""
        base, held = np.flatnonzero(np.arange(len(y)) % 3 != 2), np.flatnonzero(np.arange(len(y)) % 3 == 2)
        extra = {}
        for r in range(rounds + 1):
            for v in VIEWS:
                rows, labels = known[v].take(base), y[base]
                if v in extra:
                    rows, labels = rows.plus(extra[v][0]), np.concatenate([labels, extra[v][1]])
                self.views[v] = Linear(len(self.views[v].w), len(self.views[v].v)).fit(rows, labels)
                self.curves[v] = _platt(self.views[v].logit(known[v].take(held))[:, None], y[held])
            if r < rounds:
                extra = exchange(self)
                self.exchanged.append({v: [int((extra[v][1] == q).sum()) if v in extra else 0 for q in (0, 1)] for v in VIEWS})
        rows = {v: known[v].take(held) for v in VIEWS}
        self.both = _platt(self.logits(rows), y[held])
        self.agreement = {name: float(((s >= 0.5) == (y[held] > 0.5)).mean()) for name, s in zip((*VIEWS, "both"), self.scores(rows).T, strict=True)}
        return self


COLUMNS = ["text", "source", "lang", "n_chars"]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, dict[str, Rows]]]:
    meta = [batch.column(c).to_pylist() for c in COLUMNS[1:]]
    for start, part in slices(batch.column("text")):
        end = start + len(part)
        yield start, end, {"text": content_rows(part), "meta": meta_rows(part, *(c[start:end] for c in meta))}


def _columns(docs: DataFrame, *more) -> DataFrame:
    return docs.select("doc_id", "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long").alias("n_chars"), *more)


def judged(docs: DataFrame, model: CoTrained, keep: list[str]) -> DataFrame:
    """``keep`` columns and the views' scores of every row, in one distributed pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, rows in _parts(batch):
                kept = [batch.column(c).slice(start, end - start) for c in keep]
                yield pa.record_batch([*kept, *map(pa.array, shared.value.scores(rows).T.copy())], names=[*keep, "text_score", "meta_score", "score"])

    rows = _columns(docs)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(judge, f"{schema}, text_score double, meta_score double, score double")


def feature_rows(docs: DataFrame, most: int) -> tuple[dict[str, Rows], np.ndarray]:
    """Both views' rows of at most ``most`` rows of ``docs`` (with ``quality``), made on the executors, and the labels."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, rows in _parts(batch):
                packed = [[getattr(x, c)[a:b].tobytes() for a, b in zip(x.at, x.at[1:], strict=False)] for c in ("places", "values") for x in rows.values()]
                dense = [x.tobytes() for x in rows["meta"].dense]
                yield pa.record_batch([*(batch.column(c).slice(start, end - start) for c in ("doc_id", "quality")), *(pa.array(c, pa.binary()) for c in (*packed, dense))], names=["doc_id", "quality", "a", "b", "c", "d", "dense"])

    rows = _columns(docs, F.col("quality").cast("int"))
    found = rows.mapInArrow(make, "doc_id long, quality int, a binary, b binary, c binary, d binary, dense binary")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "a", "dense").limit(most).toPandas()

    def view(places, values, dense) -> Rows:
        at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in places])]).astype(np.int64)
        return Rows(np.frombuffer(b"".join(places), np.uint16), np.frombuffer(b"".join(values), np.float16), at, dense)

    layouts = np.frombuffer(b"".join(got["dense"]), np.float32).reshape(len(got), LAYOUT)
    return {"text": view(got["a"], got["c"], np.zeros((len(got), 0), np.float32)), "meta": view(got["b"], got["d"], layouts)}, got["quality"].to_numpy(float)


def surest(judged: DataFrame, view: str, size: int, confident: float) -> DataFrame:
    """``__id, quality``: at most ``size`` documents of each label that a view is surest of, in turns over source and lang."""
    p = F.col(f"{view}_score")
    label = F.when(p >= confident, 1).when(1 - p >= confident, 0)
    sure = judged.select("doc_id", "source", "lang", label.alias("quality"), F.abs(p - 0.5).alias("sure")).where(F.col("quality").isNotNull())
    # A group gives at most ``size`` rows to the choice; ties go by a hash. Parts of a group choose first, so a task ranks
    # at most ``PARTS`` times as many rows of one group, however many documents it has.
    ranked = sure.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for by in (("quality", "source", "lang", "part"), ("quality", "source", "lang")):
        group = Window.partitionBy(*by).orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id")
        ranked = ranked.withColumn("turn", F.row_number().over(group)).where(F.col("turn") <= size)
    picks = [ranked.where(F.col("quality") == q).orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(size) for q in (1, 0)]
    return picks[0].unionByName(picks[1]).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT, each: int = EACH) -> CoTrained:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("__id"), "__id").limit(labelled)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", *COLUMNS)
    known, y = feature_rows(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")), labelled)
    model = CoTrained()
    if len(set(y)) < 2:
        return model
    free = rows.join(sized(marks.select("__id")), F.col("doc_id") == F.col("__id"), "left_anti")

    def exchange(model: CoTrained) -> dict:
        found = save(judged(free, model, ["doc_id", "source", "lang"]), "co-training")
        size, out = each * (len(model.exchanged) + 1), {}
        for view, other in (("meta", "text"), ("text", "meta")):
            ids = F.broadcast(surest(found, view, size, confident))
            made, labels = feature_rows(free.join(ids, F.col("doc_id") == F.col("__id")), 2 * size)
            if len(labels):
                out[other] = made[other], labels
        discard(found)
        return out

    return model.fit(known, y, rounds, exchange)


def classify(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` for every row."""
    scored = judged(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"])
    return scored.withColumn("kept", F.col("score") >= threshold)


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))

"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared as their words ``[^\\W_]+`` in lower case, joined by one space. An item of ``m`` characters may differ in
``k = m * error_percent // 100`` edits; it is split into ``k + 1`` pieces, of which at least one survives any ``k`` edits
unchanged. One Aho-Corasick pass over a document finds exact piece hits; each diagonal of hits is verified with Myers'
bit-parallel distance over the window around it. A document is contaminated if it contains any item within its budget.

Items are a stated query set: they are broadcast in blocks of at most ``block`` items of bounded length, and every block
runs over all documents.

Items so short that ``k`` is 0 must stand in a text as whole words.

Defined cases: null or wordless texts contain nothing, very long ones are searched whole; items without text and items
without a letter or digit match nothing; every row of the benchmark is an item of its own, whether its id is null or
repeated (a null id is listed as ``null``); ``drop_contaminated`` judges each row by its own text, ``contaminated`` has one row
for all rows of a ``doc_id`` (and one for those without); of places with equal distance the first counts; an empty table
gives an empty result; further columns stay as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

ERROR_PERCENT = 6
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def canonical(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` runs of nearly equal length that make up ``item``, each with its place."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_end(pattern_masks: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of the whole pattern to any substring of ``text`` (Myers 1999, one word of ``m`` bits)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for ch in text:
        eq = pattern_masks.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        plus = ((mh << 1) & full) | (~(xv | ph) & full)
        minus = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best


class Matcher:
    """Items of one block, ready to search documents."""

    def __init__(self, items: list[tuple[tuple, str]], error_percent: int):
        import ahocorasick

        self.items, self.masks = {}, {}
        places = defaultdict(list)
        for number, (item, text) in enumerate(items):
            text = canonical(text)
            if not text:
                continue
            budget = len(text) * error_percent // 100
            if not budget:
                text = f" {text} "  # whole words
            self.items[number] = (item, text, budget)
            for at, piece in pieces(text, budget):
                places[piece].append((number, at))
        self.search = ahocorasick.Automaton()
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()

    def find(self, text: str | None) -> list[tuple[tuple, int, int]]:
        """``(item, distance, place)`` of every item within its budget; the place is of the first window that is near enough."""
        if not self.items:
            return []
        text = f" {canonical(text)} "
        hits = defaultdict(set)
        for end, (length, where) in self.search.iter(text):
            start = end - length + 1
            for number, at in where:
                hits[number].add(start - at)
        found = []
        for number, diagonals in hits.items():
            item, pattern, budget = self.items[number]
            if number not in self.masks:
                masks: dict[str, int] = defaultdict(int)
                for i, ch in enumerate(pattern):
                    masks[ch] |= 1 << i
                self.masks[number] = dict(masks)
            last, best = None, None
            for start in sorted(diagonals):
                if last is not None and start <= last + budget:
                    continue  # the window of the last diagonal is widened for these
                last = start
                window = text[max(0, start - budget) : start + len(pattern) + 2 * budget + 1]
                distance = myers_end(self.masks[number], len(pattern), window)
                if distance <= budget and (best is None or distance < best[0]):
                    # Places count from the first word; a short item begins with the space before it.
                    best = (distance, max(0, start - (pattern[0] != " ")))
                    if not distance:
                        break
            if best is not None:
                found.append((item, *best))
        return found


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[tuple, str]]]:
    """``((number, item_id), text)`` in blocks of at most ``most`` characters, one block in memory at a time."""
    block, size = [], 0
    for number, row in enumerate( benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator()):
        if block and size + len(row.text) > most:
            yield block
            block, size = [], 0
        block.append(((number, row.item_id), row.text))
        size += len(row.text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, error_percent: int = ERROR_PERCENT, block_chars: int = BLOCK_CHARS, key: str = "doc_id") -> DataFrame:
    """``doc_id, item, item_id, distance, place``: every document and item it contains; ``item`` numbers the benchmark's rows."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item long, item_id long, distance long, place long"
    for block in _blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_percent)
            for batch in batches:
                rows: list[tuple] = []
                for start, part in slices(batch.column(1)):
                    ids = batch.column(0).slice(start, len(part)).to_pylist()
                    for doc, text in zip(ids, part.to_pylist(), strict=True):
                        rows += [(doc, *item, *hit) for item, *hit in matcher.find(text)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["doc_id", "item", "item_id", "distance", "place"])

        found = docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for every contaminated document: how many items it contains, which, and the least distance."""
    found = matches(docs, benchmark, **options)
    ids = F.sort_array(F.collect_set(F.struct("item_id", "item")))
    items = F.concat_ws(",", F.array_distinct(F.transform(ids, lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null")))))
    return found.groupBy("doc_id").agg(F.lit(True).alias("contaminated"), F.count_distinct("item").alias("n_items"), items.alias("items"), F.min("distance").alias("least_distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_percent: int = ERROR_PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the contaminated rows; each row is judged by its own text, whatever its ``doc_id``."""
    for block in _blocks(benchmark, block_chars):
        docs = docs.where(_free_of(docs.sparkSession.sparkContext.broadcast(block), error_percent)("text"))
    return docs


def _free_of(shared, error_percent: int):
    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, error_percent)
        for texts in batches:
            yield pd.Series([not matcher.find(t) for t in texts], dtype=bool)

    return free


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

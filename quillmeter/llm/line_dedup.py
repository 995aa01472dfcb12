"""Line dedup with two Bloom filters: keys seen once, keys seen twice.

Line keys (lines without white space at their ends, A-Z folded) of at least ``least`` code points go through the filter
pair in one pass. Only lines that the second filter suspects are shuffled; an exact group over the key text then confirms
which keys at least two documents hold and picks the smallest ``doc_id`` as the one that keeps its lines.

Defined cases: null or empty text is one empty line; rows that share a ``doc_id`` are one holder; a key that one document
repeats is not a repeat across documents; rows with a null ``doc_id`` hold nothing, and keep all their lines; an empty
table gives an empty result; very long texts and lines are whole; further columns stay, but for those named ``n_lines``
or ``n_dropped``, which give way to the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, filter_bits, lookup, lower_ascii, save, seen_twice, table, twice_filter

LEAST = 10
#: The largest filter in bits (64 MiB). Beyond about 30 million keys it suspects more lines, and no result changes.
MOST_BITS = 1 << 29
_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hash(line: Column) -> Column:
    """What the filters see of a line. Lower case of all letters is coarser than the key's and much cheaper: equal keys
    have equal hashes, and the exact group that follows tells the rest apart.
    """
    return F.xxhash64(F.lower(F.btrim(line, F.lit(SPACES))))


def repeated_lines(docs: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, keys``: for every document that loses lines, the keys to drop."""
    spark = docs.sparkSession
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    keyed = lines.where(F.char_length(F.btrim("line", F.lit(SPACES))) >= least).select("doc_id", "line", _hash(F.col("line")).alias("h"))
    keys = docs.agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    twice = spark.sparkContext.broadcast(twice_filter(keyed.select("h"), filter_bits(keys, most_bits)))

    @F.pandas_udf("boolean")
    def suspected(h: pd.Series) -> pd.Series:
        return pd.Series(seen_twice(twice.value, h.to_numpy().view("uint64")))

    suspects = keyed.where(suspected("h")).select("doc_id", line_key(F.col("line")).alias("key"))
    held = save(suspects.groupBy("key", "doc_id").agg(F.count("*").alias("n")), "suspected-lines")
    firsts = held.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n_docs"))
    repeated = firsts.where(F.col("keeper") < F.col("last")).select("key", "keeper", "n_docs")
    losing = lookup(held.select("key", "doc_id"), repeated, "key", "n_docs").where(F.col("doc_id") != F.col("keeper"))
    return losing.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, least: int = LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, plus ``n_lines`` (before) and ``n_dropped``."""
    drops = repeated_lines(docs, least, most_bits).select(F.col("doc_id").alias("__id"), F.col("keys").alias("__keys"))

    @F.pandas_udf("text string, n_dropped long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            out, lost = [], []
            for text, drop in zip(texts, keys, strict=True):
                if drop is None:
                    out.append(text or "")
                    lost.append(0)
                    continue
                drop = set(drop)
                lines = text.split("\n")
                kept = [x for x in lines if x.strip(SPACES).translate(_FOLD) not in drop]
                out.append("\n".join(kept))
                lost.append(len(lines) - len(kept))
            yield pd.DataFrame({"text": out, "n_dropped": lost})

    joined = docs.join(drops, docs["doc_id"] == F.col("__id"), "left")
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    done = joined.withColumn("__n", n_lines).withColumn("__cut", F.when(F.col("__keys").isNotNull(), cut(F.when(F.col("__keys").isNotNull(), text), F.col("__keys"))))
    return done.select(*names, F.coalesce("__cut.text", text).alias("text"), F.col("__n").alias("n_lines"), F.coalesce("__cut.n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 AND doc_id IS NOT NULL
      GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(r.key IS NOT NULL AND k.doc_id <> r.keeper, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""

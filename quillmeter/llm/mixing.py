"""Mixing to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens (words) are summed into cells of source, language and topic. Raking scales the cells until their sums by source, by
language and by topic each equal the targets; a cell's factor is its raked tokens over its own. A document is expected
``rate * factor`` times: it gets the whole part as copies, and one more if a uniform number derived from its ``doc_id``
is below the rest. So the choice is the same in every run, and expected tokens meet the targets.

Targets default to tempered shares (``share ** alpha``, scaled to 1), which raises small classes and lowers hot ones.
The topic of a text is its form: ``table``, ``shout``, ``brief``, ``long`` or ``prose``, in this order of precedence.

Defined cases: null source or lang is the class ``''``; null or empty text has 0 tokens and is sampled with the factor of
its cell (1 in a cell without tokens); a null ``doc_id`` draws by the text instead; equal rows draw equally; classes that
a given target leaves out get 0; an empty table gives an empty result; very long texts are whole; further columns stay,
but for those named as the results, which give way to these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, save, table

ALPHA, ROUNDS, RATE = 0.9, 12, 1.0
#: Cells up to which raking runs in memory and factors are broadcast; above, both run as joins.
CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _occurrences(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def topic_of(text: Column, words: Column) -> Column:
    return (
        F.when(_occurrences(text, "|") * 5 >= F.greatest(words, F.lit(1)), "table")
        .when(_occurrences(text, "!") * 5 >= F.greatest(words, F.lit(1)), "shout")
        .when(words < 100, "brief")
        .when(words >= 1500, "long")
        .otherwise("prose")
    )


def tempered(shares: dict[str, float], alpha: float) -> dict[str, float]:
    raised = {k: v**alpha if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def _rake_local(cells: DataFrame, targets: dict[str, dict[str, float]], alpha: float, rounds: int) -> DataFrame:
    """Raking of a bounded number of cells with NumPy."""
    rows = cells.orderBy(*DIMENSIONS).toPandas()
    tokens = rows["tokens"].to_numpy(float)
    total, raked = tokens.sum(), tokens.copy()
    codes, wanted = [], []
    for d in DIMENSIONS:
        names, code = np.unique(rows[d].to_numpy(str), return_inverse=True)
        sums = np.bincount(code, weights=tokens, minlength=len(names))
        shares = targets.get(d) or tempered({k: s / total if total else 0.0 for k, s in zip(names, sums, strict=True)}, alpha)
        codes.append(code)
        wanted.append(np.array([shares.get(k, 0.0) for k in names]) * total)
    for _ in range(rounds):
        for code, want in zip(codes, wanted, strict=True):
            sums = np.bincount(code, weights=raked, minlength=len(want))
            raked = raked * np.divide(want, sums, out=np.zeros(len(want)), where=sums > 0)[code]
    rows["factor"] = np.divide(raked, tokens, out=np.ones(len(rows)), where=tokens > 0)
    fields = ", ".join(f"{d} string" for d in DIMENSIONS) + ", n_docs long, factor double"
    return cells.sparkSession.createDataFrame(rows[[*DIMENSIONS, "n_docs", "factor"]].to_dict("records"), fields)


def _rake_tables(cells: DataFrame, targets: dict[str, dict[str, float]], alpha: float, rounds: int) -> DataFrame:
    """The same raking as joins on marginal sums, for any number of cells."""
    spark, total = cells.sparkSession, cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for d in DIMENSIONS:
        if targets.get(d):
            want = spark.createDataFrame([(k, float(v) * total) for k, v in targets[d].items()], f"{d} string, want double")
        else:
            raised = cells.groupBy(d).agg(F.sum("tokens").alias("s")).select(d, F.when(F.col("s") > 0, F.pow(F.col("s") / F.lit(float(total or 1)), F.lit(alpha))).otherwise(0.0).alias("r"))
            scale = total / (raised.agg(F.sum("r")).first()[0] or 1.0)
            want = raised.select(d, (F.col("r") * F.lit(float(scale))).alias("want"))
        wanted[d] = save(want, "wanted")
    raked = cells.withColumn("raked", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            sums = raked.groupBy(d).agg(F.sum("raked").alias("__sum"), F.count("*").alias("__n")).join(wanted[d], d, "left")
            step = sums.select(d, F.when(F.col("__sum") > 0, F.coalesce("want", F.lit(0.0)) / F.col("__sum")).otherwise(0.0).alias("__by"), "__n")
            raked = lookup(raked, step, d, "__n").withColumn("raked", F.col("raked") * F.col("__by")).drop("__by")
        raked = save(raked, "raked")
    return raked.select(*DIMENSIONS, "n_docs", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0).alias("factor"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, rate: float = RATE, most_cells: int = CELLS) -> DataFrame:
    """Every row of ``docs`` with ``topic, n_tokens, weight, probability, copies`` (0 copies: not sampled).

    ``targets`` maps source, lang or topic to the wanted shares of its classes.
    """
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "weight", "probability", "copies")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*own, n_words(text).alias("__tokens"))
    rows = rows.withColumn("__cell", F.struct(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(text, F.col("__tokens")).alias("topic")))
    cells = rows.groupBy("__cell").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("n_docs"))
    cells = save(cells.select("__cell.*", "tokens", "n_docs"), "mixing-cells")
    few = cells.count() <= most_cells
    raked = (_rake_local if few else _rake_tables)(cells, targets or {}, alpha, rounds)
    facts = raked.select(F.struct(*DIMENSIONS).alias("__cell"), F.col("factor").alias("__factor"), "n_docs")
    joined = rows.join(F.broadcast(facts.drop("n_docs")), "__cell", "left") if few else lookup(rows, facts, "__cell", "n_docs")
    expected = F.col("__factor") * rate
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text)))
    draw = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.floor(expected) + F.when(draw < expected - F.floor(expected), 1).otherwise(0)
    return joined.select(*own, F.col("__cell.topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__factor").alias("weight"), F.least(expected, F.lit(1.0)).alias("probability"), copies.cast("long").alias("copies"))


def op1_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "copies")


def _sql(alpha: float = ALPHA, rounds: int = ROUNDS) -> str:
    count = lambda sign: f"(length(text) - length(replace(text, '{sign}', '')))"
    steps = [rf"""
WITH d AS MATERIALIZED (SELECT *, CASE WHEN {count('|')} * 5 >= greatest(n_tokens, 1) THEN 'table' WHEN {count('!')} * 5 >= greatest(n_tokens, 1) THEN 'shout'
    WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens >= 1500 THEN 'long' ELSE 'prose' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, coalesce(text, '') AS text,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents)),
c AS MATERIALIZED (SELECT s AS source, l AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
r0 AS MATERIALIZED (SELECT *, tokens AS raked FROM c)"""]
    for d in DIMENSIONS:
        steps.append(f"w_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () * (SELECT sum(tokens) FROM c) AS want FROM (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens) / (SELECT sum(tokens) FROM c), {alpha}) ELSE 0 END AS p FROM c GROUP BY {d}))")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, r.raked * CASE WHEN sum(r.raked) OVER (PARTITION BY r.{d}) > 0 THEN w.want / sum(r.raked) OVER (PARTITION BY r.{d}) ELSE 0 END AS raked FROM r{n} r JOIN w_{d} w ON r.{d} = w.{d})")
            n += 1
    steps.append(f"f AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN raked / tokens ELSE 1 END AS factor FROM r{n})")
    return ",\n".join(steps) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n_tokens AS BIGINT) AS n_tokens, round(f.factor, 6) AS weight, round(least(f.factor * {RATE}, 1.0), 6) AS probability,
  CAST(floor(f.factor * {RATE}) + CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'text ' || md5(d.text))), 1, 8)) AS BIGINT) / 4294967296.0 < f.factor * {RATE} - floor(f.factor * {RATE}) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN f ON d.s = f.source AND d.l = f.lang AND d.topic = f.topic"""


SQL = _sql()

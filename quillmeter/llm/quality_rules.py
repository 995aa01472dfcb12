"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, all in built-in expressions.

Two multinomials over ``buckets`` hashed word unigrams and bigrams are counted over all documents: one over the trusted
documents (labelled ``quality = 1``), one over the whole corpus. In the trusted one each language has its share of the
corpus and is smoothed towards its own corpus shares. A document's score is the mean over its n-grams of
``ln p_trusted(bucket) - ln p_corpus(bucket)``, so it does not depend on length; it is kept if no base rule fails and the
score reaches the threshold. The query and the pipeline score trusted documents without their own counts and derive the
threshold from these scores. The same threshold decides every document, and hashes are fixed, so runs agree.

Defined cases: null text has no words and fails the base rules; the same row twice gets the same answer twice; an empty
table gives an empty result; very long texts are whole; a ratio equal to the threshold is kept; further columns are
ignored; without trusted documents every score is 0 (kept by the method).
Labels with a null id or quality trust nothing. A document with several labels is trusted if any of them is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, discard, save, sized, table

BUCKETS = 1 << 16
THRESHOLD = -0.107
#: How far below the mean of trusted documents the derived threshold is, in standard deviations.
DEVIATIONS = 4.0
#: Words of a text up to which positions fit in the low bits of a sortable long.
POSITION_BITS = 21


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def _neighbours(left: Column, right: Column, skip: int, body) -> Column:
    """``body`` of every element of ``left`` and the element of ``right`` that is ``skip`` places on; both as long, but for these."""
    n = F.greatest(F.size(right) - skip, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + skip), n), body)


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _covered(positions: Column, width: int) -> Column:
    """How many places the windows of ``width`` starting at sorted ``positions`` cover."""
    steps = F.zip_with(
        F.slice(positions, F.lit(1), F.greatest(F.size(positions) - 1, F.lit(0))),
        F.slice(positions, F.lit(2), F.greatest(F.size(positions) - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(width).cast("long")),
    )
    return F.when(F.size(positions) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(width).cast("long"), lambda acc, x: acc + x))


#: The bits of a packed window that hold its place, and all others.
_PLACE = (1 << POSITION_BITS) - 1


def _windows(hashes: Column) -> Column:
    """Sorted windows, hash above and place below; null where no two hashes are equal or the text has too many."""
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_PLACE).cast("long")).bitwiseOR(i.cast("long"))))
    return F.when((F.size(F.array_distinct(hashes)) < F.size(hashes)) & (F.size(hashes) <= _PLACE), packed)


def _equal_pairs(windows: Column) -> Column:
    """Places in ``windows`` at which the next one has the same hash."""
    high = lambda i: F.shiftright(F.get(windows, i), POSITION_BITS)
    return F.filter(_upto(F.size(windows) - 1), lambda i: high(i) == high(i + 1))


def _repeated(words: Column, hashes: Column, windows: Column, pairs: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from ``_windows`` and its ``_equal_pairs``.

    If neighbours of equal hash differ in a word, or a text has too many windows, the windows themselves are sorted.
    """
    place = lambda i: F.get(windows, i).bitwiseAND(F.lit(_PLACE).cast("long"))

    def same(i: Column) -> Column:
        a, b = place(i).cast("int"), place(i + 1).cast("int")
        equal = F.get(words, a) == F.get(words, b)
        for k in (1, 2):
            equal = equal & (F.get(words, a + k) == F.get(words, b + k))
        return equal

    def wide(s: Column) -> Column:
        def equal(i, j):
            return F.coalesce(F.get(s, i)["w"] == F.get(s, j)["w"], F.lit(False))

        return F.sort_array(F.transform(F.filter(_upto(F.size(s)), lambda i: equal(i, i - 1) | equal(i, i + 1)), lambda i: F.get(s, i)["i"].cast("long")))

    found = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda i: F.array(place(i), place(i + 1))))))
    long = F.sort_array(F.transform(hashes, lambda h, i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
    sure = F.forall(pairs, same)
    exact = _let(_let(long, wide), lambda p: _covered(p, 3))
    return F.when(F.size(hashes) > _PLACE, exact).when(windows.isNull(), F.lit(0).cast("long")).when(sure, _let(found, lambda p: _covered(p, 3))).otherwise(exact)


def _hashes(words: Column) -> tuple[Column, Column]:
    """A hash of every word, and of every pair of neighbours."""
    return F.transform(words, lambda w: F.xxhash64(w)), _neighbours(words, words, 1, lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column, buckets: int) -> Column:
    rest = h.bitwiseAND(F.lit(buckets - 1).cast("long")) if buckets & (buckets - 1) == 0 else F.pmod(h, F.lit(buckets))
    return F.coalesce(rest.cast("int"), F.lit(0))


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__good")).distinct()


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def gram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``lang, bucket, trusted, corpus``: n-gram counts of the trusted and of all documents, over the whole tables."""
    # Languages go by number meanwhile: the hash table of the counts compares numbers at less cost than strings.
    langs = docs.select(_lang(docs).alias("lang")).distinct().select("lang", F.monotonically_increasing_id().alias("code"))
    langs = sized(save(langs, "languages"))
    rows = docs.select("doc_id", _lang(docs).alias("lang"), F.coalesce("text", F.lit("")).alias("__text")).join(langs, "lang")
    rows = rows.join(sized(_trusted(labels)), F.col("doc_id") == F.col("__good"), "left")
    rows = rows.select("code", F.col("__good").isNotNull().cast("long").alias("t"), _words(F.col("__text")).alias("w"))
    # Words come out with the next one beside them, so that both hashes run in compiled code, not in a lambda.
    after = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    rows = rows.select("code", "t", F.explode(F.arrays_zip(F.col("w").alias("a"), after.alias("b"))).alias("z"))
    both = F.array(F.xxhash64("z.a"), F.when(F.col("z.b").isNotNull(), F.xxhash64("z.a", "z.b")))
    grams = rows.select("code", "t", F.explode(both).alias("h")).where(F.col("h").isNotNull())
    cells = grams.select("code", "t", _bucket(F.col("h"), buckets).alias("bucket")).groupBy("bucket", "code").agg(F.sum("t").alias("trusted"), F.count("*").alias("corpus"))
    return cells.join(langs, "code").select("lang", "bucket", "trusted", "corpus")


def lang_shares(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """``lang, unit, nc``: what one trusted n-gram of a language adds to the trusted shares, and its n-grams."""
    sums = counts.groupBy("lang").agg(F.sum("trusted").alias("nt"), F.sum("corpus").alias("nc"))
    total = sums.agg(F.sum("nc").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("lang", (F.col("nc") / F.col("all") / (F.col("nt") + smoothing * buckets)).alias("unit"), "nc")


def gram_weights(counts: DataFrame, shares: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> tuple[Column, Column]:
    """Two arrays of ``buckets``: log ratios and trusted shares, as constants of a plan.

    Their size does not depend on the input, so they pass through the driver, as one row. As constants they cost a row
    nothing; as columns each row would carry them from one operator to the next. Of each number twelve digits count, so
    the order in which a shuffle adds does not show.

    Each language has the weight in the trusted shares that it has in the corpus, and is smoothed towards its own corpus
    shares; so languages with few or no trusted documents are not far from 0.
    """
    prior = smoothing * buckets
    cells = counts.join(sized(shares).withColumnRenamed("lang", "__l"), F.col("lang") == F.col("__l"))
    cells = cells.groupBy("bucket").agg(F.sum(F.col("unit") * (F.col("trusted") + prior * F.col("corpus") / F.col("nc"))).alias("p"), F.sum("corpus").alias("c"))
    total = F.lit(float(cells.agg(F.sum("c")).first()[0] or 0))
    cells = cells.where(F.col("c") > 0).select("bucket", (F.log("p") - F.log(F.col("c") / total)).alias("ratio"), "p")
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(cells), "bucket", "left")
    texts = [F.when(F.col(c).isNull(), "0.0").otherwise(F.format_string("%.11e", c)).alias(c) for c in ("ratio", "p")]
    cells = F.array_sort(F.collect_list(F.struct("bucket", *texts)))
    row = every.agg(cells.alias("r")).select(F.concat_ws(",", "r.ratio").alias("ratios"), F.concat_ws(",", "r.p").alias("shares")).first()
    return tuple(F.split(F.lit(x), ",").cast("array<double>") for x in row)


def _own_counts(grams: Column, starts: Column, shares: Column, unit: Column) -> Column:
    """What a trusted text's sum of log ratios changes by when its own counts are taken out of the trusted shares.

    ``grams`` are its sorted buckets, ``starts`` the places where a bucket begins.
    """

    def part(at: Column, k: Column) -> Column:
        def of(n: Column) -> Column:
            return n * F.log(F.greatest(1 - unit * n / F.get(shares, F.get(grams, at)), F.lit(1e-9)))

        return _let(F.coalesce(F.get(starts, k + 1), F.size(grams)) - at, of)

    return F.aggregate(F.transform(starts, part), F.lit(0.0), lambda acc, x: acc + x) - F.size(grams) * F.log(F.greatest(1 - unit * F.size(grams), F.lit(1e-9)))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = THRESHOLD, keep_columns: bool | list[str] = False) -> DataFrame:
    """Judge every row of ``docs``; ``keep_columns`` carries the input's columns along, all or those named.

    Of columns that share a name with a result the result stays.

    With ``threshold`` None, trusted documents are judged without their own counts, and the threshold is ``DEVIATIONS``
    standard deviations below the mean of the trusted documents that pass the base rules.
    """
    counted = save(gram_counts(docs, labels, buckets), "gram-counts")
    shares = lang_shares(counted, buckets)
    weights, trusted = gram_weights(counted, shares, buckets)
    if threshold is not None:
        discard(counted)
    words, text = F.col("__w"), F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    wanted = docs.columns if keep_columns is True else [*(keep_columns or []), "doc_id"]
    kept = [c for c in docs.columns if c in wanted and c not in made]
    rows, unit = docs.withColumn("__lang", _lang(docs)), F.lit(None).cast("double")
    if threshold is None:
        rows = rows.join(sized(_trusted(labels)), F.col("doc_id") == F.col("__good"), "left")
        rows = rows.join(sized(shares.select(F.col("lang").alias("__l"), F.col("unit").alias("__unit"))), F.col("__lang") == F.col("__l"), "left")
        unit = F.when(F.col("__good").isNotNull(), F.col("__unit"))
    rows = rows.select(*kept, F.coalesce("text", F.lit("")).alias("__text"), unit.alias("__own"))
    rows = rows.withColumn("__w", _words(text)).withColumn("__l", lines)
    # Each step below copies the columns it hands on, so texts, lines and arrays end where they are last read.
    one, two = _hashes(words)
    plain = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select(*kept, "__own", "__w", plain.alias("__plain"), one.alias("__one"), two.alias("__two"))
    # Only tells windows apart that ``_repeated`` then compares, so the cheapest mix of both hashes will do.
    triples = _neighbours(F.col("__two"), F.col("__one"), 2, lambda a, b: a.bitwiseXOR(b))
    rows = rows.select(*kept, "__own", "__w", "__plain", triples.alias("__h"), F.concat("__one", "__two").alias("__grams"))
    # Sorted here, in a projection's compiled code, arrays of longs and ints sort as such.
    trusting = threshold is None
    rows = rows.withColumn("__s", _windows(F.col("__h")))
    if trusting:
        rows = rows.withColumn("__g", F.when(F.col("__own").isNotNull(), F.sort_array(F.transform("__grams", lambda h: _bucket(h, buckets)))))
    # Words are compared only where hashes repeat, or where there are too many to pack.
    rows = rows.withColumn("__w", F.when(F.col("__s").isNotNull() | (F.size("__h") > _PLACE), words)).withColumn("__pairs", _equal_pairs(F.col("__s")))
    if trusting:
        rows = rows.withColumn("__starts", F.filter(_upto(F.size("__g")), lambda i: (i == 0) | (F.get("__g", i) != F.get("__g", i - 1))))
    n_grams = F.size("__grams")
    sums = F.aggregate("__grams", F.lit(0.0), lambda acc, h: acc + F.get(weights, _bucket(h, buckets)))
    if trusting:
        sums = sums + F.when(F.col("__own").isNull(), F.lit(0.0)).otherwise(_own_counts(F.col("__g"), F.col("__starts"), trusted, F.col("__own")))
    score = F.when(n_grams == 0, F.lit(0.0)).otherwise(sums / n_grams)
    counts = F.struct(
        *[F.col(f"__plain.{c}").alias(c) for c in made[:4]],
        _repeated(words, F.col("__h"), F.col("__s"), F.col("__pairs")).alias("n_repeat_words"),
        score.alias("llr"),
    )
    # A generator of one row: filters on the verdict stay above it. Pushed below, they would split the text anew for
    # every element of the arrays.
    rows = rows.select(*kept, F.col("__own").isNotNull().alias("__known"), F.inline(F.array(counts)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    least = F.lit(threshold)
    if threshold is None:
        rows = save(rows, "quality-scores")
        discard(counted)
        known = rows.where(F.col("__known") & ~F.col("base_failed")).agg(F.avg("llr").alias("mean"), F.coalesce(F.stddev_pop("llr"), F.lit(0.0)).alias("sd"))
        # Without trusted documents every score is 0, and all is kept.
        mean, sd = known.first()
        least = F.lit(0.0 if mean is None else mean - DEVIATIONS * sd - 1e-9)
    return rows.drop("__known").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=None)

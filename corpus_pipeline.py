"""The corpus pipeline: five operators, each on all documents that the one before kept.

Every stage is written as Parquet to the session's shared folder and read again, so a lost executor repeats one stage at
most. SQL can express neither the hashed log-likelihood ratio nor the edit matching; the tests hold the pipeline against
a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm.common import save, table
from quillmeter.llm.decontaminate import drop_contaminated
from quillmeter.llm.jaccard_join import keep_one_per_component
from quillmeter.llm.line_dedup import drop_repeated_lines
from quillmeter.llm.mixing import mix
from quillmeter.llm.quality_rules import quality_rules


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """What an operator reads, with the whole row beside it, so no column's name can clash with one of the operator's."""
    return docs.select(*names, F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio, with the threshold that trusted documents give."""
    judged = quality_rules(carried(docs, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"), threshold=None, keep_columns=["__row"])
    return judged.where("kept").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; those left without a word go."""
    cut = drop_repeated_lines(carried(docs, "doc_id", "text"))
    left = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # Texts that lose nothing stay as they are, null ones too.
    text = F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("__row.text"))
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return left.select(*[{"text": text, "n_chars": size}.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8."""
    return keep_one_per_component(carried(docs, "doc_id", "text"), k=5, num=80).select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with topic, tokens, weight, probability and copies."""
    return mix(docs).where("copies > 0")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", decontaminate), ("mixing_weights", mixture)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

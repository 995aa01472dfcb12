"""The corpus operators' queries, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, hard_negatives, line_dedup, mixing, turn_repair, warc
from .chat_format import op10_chat_prefix_targets
from .cotrain import op8_cotrained_quality
from .decontaminate import op7_benchmark_decontamination
from .hard_negatives import op11_hard_negatives
from .jaccard_join import op2_ngram_jaccard_join
from .line_dedup import op6_line_dedup
from .mixing import op1_mixing_weights
from .neighbours import op13_nearest_neighbours
from .quality_rules import op3_quality_rules
from .token_counts import op5_token_counts
from .toxicity import op9_toxicity
from .turn_repair import op12_turn_repair
from .warc import op4_warc_writer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing_weights": op1_mixing_weights,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc_writer": op4_warc_writer,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_cotrained_quality": op8_cotrained_quality,
    "op9_toxicity": op9_toxicity,
    "op10_chat_prefix_targets": op10_chat_prefix_targets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_turn_repair": op12_turn_repair,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

SQL: dict[str, str] = {
    "op1_mixing_weights": mixing.SQL,
    "op4_warc_writer": warc.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op10_chat_prefix_targets": chat_format.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_turn_repair": turn_repair.SQL,
}

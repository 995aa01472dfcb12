"""Log lines to usage events, range by range.

A line passes a marker test before it is parsed. Context (working directory, model, turn) is carried forward to the events
after it; what an event precedes is filled from the first later value, except the turn. Cumulative counters that repeat
within a file are dropped, and requests are the increments (or the reported last usage).

No step sorts or gathers a whole file. Each range (segment) of a file is summed up in one row (``segment_states``): its first
metadata, the first and last value of each context, its last kept counters and how many it kept. These rows merge in any
grouping, in the order of the segments (``merged_states``), so a file of any length, or one that grew, is known by one such
row. A window over these few rows tells each segment what comes in from before and what follows (``carried_in``), and the
lines are read in windows of one segment. Repeated counters are found by a shuffle on file and counters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COUNTERS, UNKNOWN_CWD, UNKNOWN_MODEL, USAGE_EVENTS

#: Quoted names of the record kinds that matter.
MARKERS = ("token_count", "turn_context", "session_meta", "thread_settings_applied", "task_started", "task_complete", "turn_aborted")
_UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"


#: What is taken of a line, in one pass over it; a value of another type is null (numeric text and booleans are numbers too).
_USAGE = "struct<" + ",".join(f"{c}:double" for c in COUNTERS) + ">"
_LINE = (
    "struct<type:variant,timestamp:variant,payload:struct<type:variant,timestamp:variant,id:variant,cwd:variant,model:variant,turn_id:variant,"
    f"thread_settings:struct<model:variant>,info:struct<total_token_usage:{_USAGE},last_token_usage:{_USAGE}>>>"
)


def _text(x: str) -> Column:
    """A trimmed string; empty for anything but a string."""
    return F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string"))).otherwise(F.lit(""))


def _count(x: Column) -> Column:
    """A finite number, 0 for anything else."""
    return F.when(F.abs(x) < float("inf"), x).otherwise(0).cast("long")  # NaN is greater than any number


def _ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def records(lines: DataFrame) -> DataFrame:
    """Parsed lines of the kinds that matter, one row each, and ``bad`` for those that are no JSON."""
    lines = lines if "segment" in lines.columns else lines.withColumn("segment", F.lit(0).cast("long"))
    hit = lines.where(F.col("line").rlike('"(' + "|".join(MARKERS) + ')"'))
    v = F.try_parse_json("line")
    closed = F.col("line").rlike(r"^\s*\{(?s:.*)\}\s*$")
    head = ["file_path", "segment", "line_no", "unterminated"]
    rows = hit.select(*head, F.when(closed, v).alias("v"))
    rows = rows.select(*head, F.col("v").isNull().alias("bad"), F.try_variant_get("v", "$", _LINE).alias("v")).where("NOT (bad AND unterminated)")
    rows = rows.select(*head, "bad", "v", _text("v.type").alias("outer"), _text("v.payload.type").alias("inner"))
    outer, inner = F.col("outer"), F.col("inner")
    named = F.when(outer.isin("session_meta", "turn_context"), outer).when((outer == "event_msg") & inner.isin(*MARKERS), inner)
    token = (outer == "event_msg") & (inner == "token_count")
    counters = lambda part: [F.when(token, _count(F.col(f"v.payload.info.{part}.{c}"))).alias(f"{part[0]}_{c}") for c in COUNTERS]
    return rows.select(
        "file_path",
        "segment",
        "line_no",
        "bad",
        "unterminated",
        named.alias("kind"),
        _text("v.timestamp").alias("at"),
        _text("v.payload.timestamp").alias("meta_at"),
        _text("v.payload.id").alias("id"),
        _text("v.payload.cwd").alias("cwd"),
        F.when(named == "thread_settings_applied", _text("v.payload.thread_settings.model")).otherwise(_text("v.payload.model")).alias("model"),
        _text("v.payload.turn_id").alias("turn"),
        *counters("total_token_usage"),
        *counters("last_token_usage"),
    )


TOTALS = tuple(f"t_{c}" for c in COUNTERS)
#: A segment's state. Its values are structs that begin with their place in the segment, so the least and the greatest are the
#: first and the last. ``leads`` and ``trails``: no turn names a directory before, or after, the first metadata (whose own
#: directory counts only if no earlier segment has metadata).
STATE = (
    "file_path string, segment long, meta struct<line_no:bigint,id:string,created:bigint,cwd:string>, leads boolean, trails boolean,"
    " first_cwd struct<line_no:bigint,value:string>, last_cwd struct<line_no:bigint,value:string>,"
    " first_model struct<line_no:bigint,value:string>, last_model struct<line_no:bigint,value:string>, last_turn struct<line_no:bigint,value:string>,"
    f" last_kept struct<line_no:bigint,{','.join(f'{t}:bigint' for t in TOTALS)}>, kept bigint, raw bigint, bad bigint, unended bigint"
)


def settled(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows that are read more than once, and return a reader of what is written."""
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _with_contexts(rows: DataFrame) -> DataFrame:
    """What each row sets: turn contexts and starts replace the turn (by nothing, if they name none); ends clear it."""
    kind = F.col("kind")
    return rows.withColumns(
        {
            "meta": F.when(kind == "session_meta", F.struct("line_no", _filled(F.col("id")).alias("id"), F.coalesce(_ms(F.col("meta_at")), _ms(F.col("at"))).alias("created"), _filled(F.col("cwd")).alias("cwd"))),
            "cwd_set": F.when(kind == "turn_context", _filled(F.col("cwd"))),
            "model_set": F.when(kind.isin("turn_context", "thread_settings_applied"), _filled(F.col("model"))),
            "turn_set": F.when(kind.isin("turn_context", "task_started"), F.col("turn")).when(kind.isin("task_complete", "turn_aborted"), F.lit("")),
        }
    )


def first_of_repeats(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Rows with ``kept``: the first token count of a file that has these cumulative counters, unless ``seen`` (``file_path`` and
    counters) has them. Other rows pass.
    """
    tokens = rows.where(F.col("kind") == "token_count")
    rank = F.row_number().over(Window.partitionBy("file_path", *TOTALS).orderBy("segment", "line_no"))
    first = tokens.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    if seen is not None:
        first = first.join(seen.select("file_path", *TOTALS), ["file_path", *TOTALS], "left_anti").select(*tokens.columns)
    others = rows.where(F.col("kind").isNull() | (F.col("kind") != "token_count"))
    return first.withColumn("kept", F.lit(True)).unionByName(others.withColumn("kept", F.lit(False)))


def segment_states(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each segment of ``rows``; ``kept`` is ``first_of_repeats`` of them."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("value")))
    counted = rows.groupBy("file_path", "segment").agg(F.count_if(F.col("kind") == "token_count").alias("raw"), F.count_if("bad").alias("bad"), F.count_if("unterminated").alias("unended"))
    found = _with_contexts(kept).groupBy("file_path", "segment").agg(
        F.min("meta").alias("meta"),
        F.min(at("cwd_set")).alias("first_cwd"),
        F.max(at("cwd_set")).alias("last_cwd"),
        F.min(at("model_set")).alias("first_model"),
        F.max(at("model_set")).alias("last_model"),
        F.max(at("turn_set")).alias("last_turn"),
        F.max(F.when(F.col("kept"), F.struct("line_no", *TOTALS))).alias("last_kept"),
        F.count_if("kept").alias("kept"),
    )
    found = found.withColumns(
        {
            "leads": F.coalesce(F.col("meta.line_no") < F.col("first_cwd.line_no"), F.lit(True)),
            "trails": F.coalesce(F.col("meta.line_no") > F.col("last_cwd.line_no"), F.lit(True)),
        }
    )
    return counted.join(found, ["file_path", "segment"], "left").select(*_state_columns(F.coalesce("kept", F.lit(0)).alias("kept")))


def _state_columns(kept=None) -> list:
    names = ["file_path", "segment", "meta", "leads", "trails", "first_cwd", "last_cwd", "first_model", "last_model", "last_turn", "last_kept", "kept", "raw", "bad", "unended"]
    return [kept if n == "kept" and kept is not None else F.col(n) for n in names]


def merged_states(states: DataFrame) -> DataFrame:
    """The states of consecutive segments of a file as one, at the first segment's place; merging twice is merging once."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("segment"))).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("segment"))).alias(c)
    where = lambda how, c: how(F.when(F.col(c).isNotNull(), F.col("segment")))
    meta_at = where(F.min, "meta")
    leads = F.min_by("leads", F.when(F.col("meta").isNotNull(), F.col("segment"))) & F.coalesce(where(F.min, "first_cwd") >= meta_at, F.lit(True))
    trails = F.min_by("trails", F.when(F.col("meta").isNotNull(), F.col("segment"))) & F.coalesce(where(F.max, "last_cwd") <= meta_at, F.lit(True))
    rows = states.groupBy("file_path").agg(
        F.min("segment").alias("segment"),
        first("meta"),
        F.coalesce(leads, F.lit(True)).alias("leads"),
        F.coalesce(trails, F.lit(True)).alias("trails"),
        *(first(c) for c in ("first_cwd", "first_model")),
        *(last(c) for c in ("last_cwd", "last_model", "last_turn", "last_kept")),
        *(F.sum(c).alias(c) for c in ("kept", "raw", "bad", "unended")),
    )
    return rows.select(*_state_columns())


def carried_in(states: DataFrame) -> DataFrame:
    """For each segment: what holds before its first line, what follows its last, the file's session, metadata and kept counts before."""
    order = Window.partitionBy("file_path").orderBy("segment")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = states.withColumn("file_meta", F.first("meta", ignorenulls=True).over(whole)).withColumn("meta_here", F.col("meta").isNotNull() & F.coalesce(F.count("meta").over(before) == 0, F.lit(True)))
    own = lambda side: F.when(F.col("meta_here") & F.col(side) & F.col("meta.cwd").isNotNull(), F.struct(F.col("meta.line_no"), F.col("meta.cwd").alias("value")))
    rows = rows.withColumns({"first_cwd": F.coalesce(own("leads"), "first_cwd"), "last_cwd": F.coalesce(own("trails"), "last_cwd")})
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    later = lambda c: F.first(c, ignorenulls=True).over(after)
    name = F.regexp_extract(F.col("file_path"), r"([^/\\]+?)(\.jsonl(\.zst)?)?$", 1)
    uuid = F.regexp_extract(name, _UUID, 1)
    return rows.select(
        "file_path",
        "segment",
        F.coalesce("file_meta.id", F.when(uuid != "", uuid), name).alias("session"),
        F.col("file_meta.created").alias("created"),
        F.when(F.col("meta_here"), F.col("meta.line_no")).alias("meta_line"),
        last("last_cwd")["value"].alias("cwd_in"),
        later("first_cwd")["value"].alias("cwd_later"),
        last("last_model")["value"].alias("model_in"),
        later("first_model")["value"].alias("model_later"),
        last("last_turn")["value"].alias("turn_in"),
        last("last_kept").alias("kept_in"),
        F.coalesce(F.sum("kept").over(before), F.lit(0)).alias("events_before"),
    )


def events_of(kept: DataFrame, carried: DataFrame) -> DataFrame:
    """Usage events of the segments, by windows of one segment each."""
    part = Window.partitionBy("file_path", "segment")
    order = part.orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    from_end = part.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that looks ahead starts anew at every row
    rows = _with_contexts(kept).join(carried, ["file_path", "segment"])
    rows = rows.withColumn("cwd_set", F.when(F.col("line_no") == F.col("meta_line"), F.col("meta.cwd")).otherwise(F.col("cwd_set")))
    back = lambda c: F.last(c, ignorenulls=True).over(so_far)
    later = lambda c: F.last(c, ignorenulls=True).over(from_end)
    previous = F.last(F.when(F.col("kept"), F.struct(*TOTALS)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns(
        {
            "cwd_at": F.coalesce(back("cwd_set"), "cwd_in", later("cwd_set"), "cwd_later", F.lit(UNKNOWN_CWD)),
            "model_at": F.coalesce(back("model_set"), "model_in", later("model_set"), "model_later", F.lit(UNKNOWN_MODEL)),
            "turn_at": F.coalesce(back("turn_set"), "turn_in", F.lit("")),
            "previous": previous,
            "event_index": F.col("events_before") + F.count_if("kept").over(so_far) - 1,
        }
    )
    events = rows.where("kept")
    reported = reduce(lambda a, b: a | b, (F.col(f"l_{c}") > 0 for c in COUNTERS))
    base = lambda c: F.coalesce(F.col("previous")[f"t_{c}"], F.col("kept_in")[f"t_{c}"], F.lit(0))
    step = {c: F.when(reported, F.col(f"l_{c}")).otherwise(F.greatest(F.lit(0), F.col(f"t_{c}") - base(c))) for c in COUNTERS}
    events = events.withColumns({**step, "own": _ms(F.col("at"))})
    key = F.concat_ws(",", *TOTALS)
    bare = (F.col("turn_at") == "") & F.col("own").isNull()
    print_ = F.sha2(
        F.concat_ws(
            "\x1f",
            F.when(F.col("turn_at") != "", F.concat(F.lit("turn:"), F.col("turn_at"))).when(F.col("own").isNotNull(), F.concat(F.lit("time:"), F.col("own").cast("string"))).otherwise("none"),
            key,
            F.concat_ws(",", *COUNTERS),
            F.when(bare, F.concat_ws("\x1f", "session", "cwd_at", "model_at")).otherwise(""),
        ),
        256,
    )
    out = events.select(
        "file_path",
        "event_index",
        F.coalesce("own", "created").alias("timestamp_ms"),
        F.col("own").isNotNull().alias("has_event_timestamp"),
        F.col("created").alias("session_created_at_ms"),
        F.col("session").alias("session_id"),
        F.concat(print_, F.lit(":"), key).alias("total_usage_key"),
        F.col("cwd_at").alias("cwd"),
        F.col("model_at").alias("model"),
        *COUNTERS,
    )
    assert out.columns == USAGE_EVENTS.names
    return out


def file_counts(states: DataFrame) -> DataFrame:
    """Per-file counts of events, raw and duplicate counts, and parse errors, from the states of its segments."""
    sums = states.groupBy("file_path").agg(*(F.sum(c).alias(c) for c in ("kept", "raw", "bad")))
    return sums.select("file_path", F.col("kept").alias("events_count"), (F.col("raw") - F.col("kept")).alias("duplicate_token_events"), F.col("bad").alias("parse_errors"), F.col("raw").alias("raw_token_events"))


def usage_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and per-file counts of raw and duplicate events and of parse errors, from ``records``.

    ``rows`` are read three times, so they are best a written table (``settled``).
    """
    kept = first_of_repeats(rows)
    states = segment_states(rows, kept)
    return events_of(kept, carried_in(states)), file_counts(states)

import json
import random

import pytest
import zstandard
from logs import context, event, meta, tokens, usage, write
from pyspark.sql import functions as F

from quillmeter.plans.usage import scan
from quillmeter.sources.logs import list_logs, source_scopes
from quillmeter.sources.parse import carried_in, events_of, first_of_repeats, merged_states, records, segment_states
from quillmeter.sources.ranges import Range, check_compressed, cut, load_logs, range_lines, read_lines


def rows(spark, folder):
    read = scan(spark, [str(folder)])
    return [r.asDict() for r in read.events.orderBy("file_path", "event_index").collect()], {r.file_path: r.asDict() for r in read.files.collect()}, read


def test_deltas_duplicates_and_parse_errors(spark, tmp_path):
    a, b = usage(1000, 400, 0, 100, 20, 1100), usage(1600, 500, 0, 180, 30, 1780)
    path = write(tmp_path / "x.jsonl", meta(), context("m"), tokens(a, a, "2026-07-29T00:00:02Z"), tokens(a, at="2026-07-29T00:00:03Z"), tokens(b, at="2026-07-29T00:00:04Z"), tail='{"type":"event_msg","payload":{"type":"token_count"\n')
    events, files, _ = rows(spark, tmp_path)
    assert [(e["input_tokens"], e["cached_input_tokens"], e["output_tokens"], e["reasoning_output_tokens"], e["total_tokens"]) for e in events] == [(1000, 400, 100, 20, 1100), (600, 100, 80, 10, 680)]
    assert files[path]["raw_token_events"] == 3 and files[path]["duplicate_token_events"] == 1 and files[path]["parse_errors"] == 1
    assert {e["session_id"] for e in events} == {"s1"} and {e["cwd"] for e in events} == {"/w"}


def test_models_follow_settings_and_context(spark, tmp_path):
    write(tmp_path / "x.jsonl", meta(), tokens(usage(1, 0, 0, 0, 0, 1)), event("thread_settings_applied", thread_settings={"model": "sol"}), tokens(usage(2, 0, 0, 0, 0, 2)), context("terra"), tokens(usage(3, 0, 0, 0, 0, 3)))
    assert [e["model"] for e in rows(spark, tmp_path)[0]] == ["sol", "sol", "terra"]


def test_late_meta_fills_what_came_before(spark, tmp_path):
    write(tmp_path / "x.jsonl", tokens(usage(1, 0, 0, 0, 0, 1)), meta("late", "/late", "2026-01-02T00:00:00Z"), event("thread_settings_applied", thread_settings={"model": "sol"}))
    (e,), _, _ = rows(spark, tmp_path)
    assert (e["session_id"], e["cwd"], e["model"], e["timestamp_ms"], e["has_event_timestamp"]) == ("late", "/late", "sol", 1767312000000, False)


def test_names_and_defaults_without_context(spark, tmp_path):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    write(tmp_path / f"rollout-{u}.jsonl", tokens(usage(1, 0, 0, 0, 0, 1)))
    (e,), _, _ = rows(spark, tmp_path)
    assert (e["session_id"], e["cwd"], e["model"], e["timestamp_ms"]) == (u, "(unknown cwd)", "(unknown model)", None)


def test_null_info_is_a_zero_request_and_resets_the_baseline(spark, tmp_path):
    null = {"type": "event_msg", "payload": {"type": "token_count", "info": None}}
    write(tmp_path / "x.jsonl", tokens(usage(5, 0, 0, 0, 0, 5)), null, tokens(usage(7, 0, 0, 0, 0, 7)))
    assert [e["total_tokens"] for e in rows(spark, tmp_path)[0]] == [5, 0, 7]


def test_counters_accept_what_reads_as_numbers(spark, tmp_path):
    write(tmp_path / "x.jsonl", tokens({"input_tokens": "12", "output_tokens": True, "total_tokens": "x", "cached_input_tokens": None}))
    (e,), _, _ = rows(spark, tmp_path)
    assert (e["input_tokens"], e["output_tokens"], e["total_tokens"], e["cached_input_tokens"]) == (12, 1, 0, 0)


def test_boundary_clears_the_turn(spark, tmp_path):
    u = usage(1, 0, 0, 0, 0, 1)
    write(tmp_path / "a.jsonl", context("m", "old"), event("task_complete", turn_id="old"), tokens(u, at="2026-01-01T00:00:00Z"), context("m", "future"))
    write(tmp_path / "b.jsonl", context("m", "other"), event("turn_aborted"), tokens(u, at="2026-01-01T00:00:00Z"))
    a, b = rows(spark, tmp_path)[0]
    assert a["total_usage_key"] == b["total_usage_key"]


def test_unfinished_last_line_waits(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", meta(), tail='{"type":"event_msg","payload":{"type":"token_count","info":')
    events, files, _ = rows(spark, tmp_path)
    assert not events and files[path]["parse_errors"] == 0


def test_compressed_equals_plain_and_damage_is_isolated(spark, tmp_path):
    write(tmp_path / "p" / "x.jsonl", meta(cwd="/ü"), context("m"), tokens(usage(1, 0, 0, 0, 0, 1)), tokens(usage(2, 0, 0, 0, 0, 2)))
    data = (tmp_path / "p" / "x.jsonl").read_bytes()
    cut = data.index("ü".encode()) + 1
    z = zstandard.ZstdCompressor()
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.jsonl.zst").write_bytes(z.compress(data[:cut]) + z.compress(data[cut:]))
    (tmp_path / "z" / "bad.jsonl.zst").write_bytes(z.compress(data) + b"garbage!")
    (tmp_path / "z" / "cut.jsonl.zst").write_bytes(z.compress(data)[:-5])
    (tmp_path / "z" / "empty.jsonl.zst").write_bytes(b"")
    plain, packed = rows(spark, tmp_path / "p"), rows(spark, tmp_path / "z")
    same = ("session_id", "cwd", "model", "total_tokens", "total_usage_key")
    assert [[e[c] for c in same] for e in plain[0]] == [[e[c] for c in same] for e in packed[0]]
    assert len(packed[2].failures) == 3
    assert check_compressed(str(tmp_path / "z" / "x.jsonl.zst")) is None


def test_listing_is_sorted_and_skips_missing_roots(tmp_path):
    for n in ("b.jsonl", "a.jsonl.zst", "c.txt", "d/e.jsonl"):
        write(tmp_path / n)
    assert [p.removeprefix(f"{tmp_path}/") for p in list_logs([str(tmp_path), str(tmp_path / "none"), str(tmp_path)])] == ["a.jsonl.zst", "b.jsonl", "d/e.jsonl"]


def test_scopes():
    dirs = {"/mnt/c/Users": ["ann", "Public"]}
    found = source_scopes("/home/u/.tool", {"WSL_DISTRO_NAME": "x"}, listing=lambda p: dirs.get(p, []))
    assert found["windows"] == ["/mnt/c/Users/ann/.tool/sessions", "/mnt/c/Users/ann/.tool/archived_sessions"]
    assert found["local"] == found["wsl"] == ["/home/u/.tool/sessions", "/home/u/.tool/archived_sessions"]
    assert len(found["all"]) == 4


def big_logs(folder, seed=3):
    """A plain file and a compressed one of many frames with the same bytes: long lines, unmarked ones, no final line feed."""
    r = random.Random(seed)
    lines = []
    for i in range(120):
        total = usage(*(i * k for k in (10, 1, 0, 3, 1, 13)))
        lines += [tokens(total, at=f"2026-01-01T00:{i % 60:02d}:00Z")] + ([tokens(total)] if i % 7 == 0 else [])
        lines += r.choice([[], [context(f"m{i % 3}", r.choice([None, f"t{i}"]), r.choice([None, f"/ü{i}"]))], [event("task_complete")], [meta(f"s{i}", f"/w{i}")], [{"type": "response_item", "payload": {"text": "é" * r.randint(0, 900)}}]])
    text = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)
    path = folder / "x.jsonl"
    folder.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    data, packed, at = path.read_bytes(), b"", 0
    while at < len(data):
        step = r.choice([1, 40, 700, 3000])
        packed += zstandard.ZstdCompressor(write_checksum=r.random() < 0.5, write_content_size=r.random() < 0.5).compress(data[at : at + step])
        packed += r.choice([b"", b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc", zstandard.ZstdCompressor().compress(b"")])
        at += step
    (folder / "x.jsonl.zst").write_bytes(packed)
    return path, folder / "x.jsonl.zst"


@pytest.mark.parametrize("size", [1, 97, 1000, 1 << 20])
def test_ranges_give_every_line_once(tmp_path, size):
    for path in map(str, big_logs(tmp_path)):
        length = (tmp_path / path).stat().st_size
        whole = [x[1] for x in range_lines(Range(path)) if x[1]]
        parts = [[x for x in range_lines(r) if x[1]] for r in cut(path, 0, length, None, size)]
        assert [x[1] for p in parts for x in p] == whole and len(whole) > 120
        assert all(p == sorted(p, key=lambda x: x[0]) for p in parts)
        if size == 97:
            assert sum(bool(p) for p in parts) > 20


def test_damage_in_any_range_fails_the_file(spark, tmp_path):
    path = big_logs(tmp_path)[1]
    data = path.read_bytes()
    for bad in (data[:-3], data + b"garbage!", data[: len(data) // 2] + b"\x00" * 20 + data[len(data) // 2 :]):
        path.write_bytes(bad)
        read = read_lines(spark, [(str(path), 0, len(bad), None)], range_bytes=500)
        assert read.where("status LIKE '%LOG_DECODE_FAILED%'").count() >= 1


@pytest.mark.parametrize("size", [2000])
def test_events_do_not_depend_on_the_ranges(spark, tmp_path, size):
    big_logs(tmp_path / "logs")
    one, many = (scan(spark, [str(tmp_path / "logs")], n) for n in (1 << 30, size))
    for a, b in ((one.events, many.events), (one.files, many.files)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert many.events.count() == 240 and not many.failures
    plan = many.events._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_path" in plan and not [x for x in plan.split("\n") if "Window" in x and "line_no" in x and "segment" not in x and "t_input_tokens" not in x]


def test_states_merge_in_any_grouping(spark, tmp_path):
    big_logs(tmp_path)
    rows = records(load_logs(spark, [str(tmp_path)], 2500).where("status IS NULL"))
    kept = first_of_repeats(rows)
    states = segment_states(rows, kept).cache()
    whole = sorted(map(str, merged_states(states).collect()))
    for cut_at in (12_000,):
        parts = [merged_states(states.where(F.col("segment") < cut_at)), merged_states(states.where(F.col("segment") >= cut_at))]
        assert sorted(map(str, merged_states(parts[0].unionByName(parts[1])).collect())) == whole
        # What follows is the same whether the earlier segments are known one by one or as one.
        late = states.where(F.col("segment") >= cut_at)
        carried = [carried_in(earlier.unionByName(late)).where(F.col("segment") >= cut_at) for earlier in (states.where(F.col("segment") < cut_at), parts[0])]
        pick = lambda c: sorted(map(tuple, events_of(kept.where(F.col("segment") >= cut_at), c).collect()))  # noqa: B023, E731
        assert pick(carried[0]) == pick(carried[1])


def test_the_data_source_prunes_lines_by_their_bytes(spark, tmp_path):
    big_logs(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = load_logs(spark, [str(tmp_path)], 2000)
        assert read.rdd.getNumPartitions() > 5
        metas = [r.line for r in read.where(F.col("line").contains('"session_meta"')).collect()]
        assert sorted(metas) == sorted(r.line for r in read.collect() if r.line and '"session_meta"' in r.line) and metas
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")

import io
import json
import os
import urllib.error
import urllib.request

import pytest
from logs import context, meta, tokens, usage, write

from pyspark.sql import functions as F

from quillmeter.cli import main
from quillmeter.operators import aggregate as A
from quillmeter.options import UsageQuery, parse_args, parse_bound, parse_duration, rolling, web_limit
from quillmeter.plans.usage import payload, run, scan
from quillmeter.pricing.catalog import built_in
from quillmeter.pricing.spans import priced
from quillmeter.server import query_of, serve
from quillmeter.service import QueryService
from quillmeter.sinks import to_csv, to_text
from quillmeter.sources.logs import place, write_logs
from quillmeter.sources.parse import STATE, carried_in, events_of, first_of_repeats, records
from quillmeter.sources.ranges import LINES, Range, dealt, range_lines, read_lines
from quillmeter.streaming import incremental
from quillmeter.streaming.incremental import Aborted, Conflict, UsageIndex


def fork(tmp_path, with_original=True):
    u = usage(10_000, 0, 0, 1000, 0, 11_000)
    if with_original:
        write(tmp_path / "b.jsonl", meta("orig"), context("gpt-5.6-terra", "t1"), tokens(u, u, "2026-07-29T12:00:00Z"))
    write(tmp_path / "a.jsonl", meta("copy"), context("gpt-5.6-terra", "t1"), tokens(u, u, "2026-08-01T12:00:00Z"))


def test_the_original_wins_before_the_filter(spark, tmp_path):
    fork(tmp_path)
    out = run(spark, UsageQuery(roots=(str(tmp_path),)))
    assert [(r["key"], r["requests"]) for r in out["rows"]] == [("2026-07", 1)] and out["stats"]["global_duplicate_token_events"] == 1
    late = run(spark, UsageQuery(roots=(str(tmp_path),), from_ms=parse_bound("2026-08-01", "UTC")))
    assert late["totals"]["requests"] == 0 and late["rows"] == []
    both = run(spark, UsageQuery(roots=(str(tmp_path),), dedupe="file"))
    assert [r["key"] for r in both["rows"]] == ["2026-07", "2026-08"]


def test_direct_and_index_agree(spark, tmp_path):
    fork(tmp_path / "logs")
    write(tmp_path / "logs" / "c.jsonl", context("codex-auto-review"), tokens(usage(5, 0, 0, 1, 0, 6), at="2026-07-30T00:00:00Z"), context("odd"), tokens(usage(9, 0, 0, 1, 0, 10)))
    roots = (str(tmp_path / "logs"),)
    index = UsageIndex(spark, str(tmp_path / "index"))
    index.refresh(list(roots))
    service, read = QueryService(index), scan(spark, list(roots))
    events = read.events.persist()
    for dedupe in ("global", "file"):
        for group in ("none", "day", "month", "model", "cwd", "session") if dedupe == "global" else ("model",):
            q = UsageQuery(roots=roots, group=group, dedupe=dedupe)
            a, b = payload(events, q, None, read.files, read.failures, read.paths), service.query(q)
            assert a["rows"] == b["rows"] and a["totals"] == b["totals"] and a["unpricedModels"] == b["unpricedModels"] and a["assumedModels"] == b["assumedModels"]
    assert service.query(q) is service.query(q)


def test_refresh_reads_changes_only(spark, tmp_path):
    logs = tmp_path / "logs"
    fork(logs)
    seen = []
    index = UsageIndex(spark, str(tmp_path / "index"))
    plain = index._scan
    index._scan = lambda s, spans: (seen.append([os.path.basename(p[0]) for p in spans]), plain(s, spans))[1]
    first = index.refresh([str(logs)])
    assert index.refresh([str(logs)])["revision"] == first["revision"] and seen == [["a.jsonl", "b.jsonl"]]
    os.unlink(logs / "b.jsonl")  # the copy becomes the representative
    index.refresh([str(logs)])
    assert [r.session_id for r in index.canonical().collect()] == ["copy"]
    (logs / "z.jsonl.zst").write_bytes(b"no zstd")
    index.refresh([str(logs)])
    assert index.status()["failedFiles"] == 1 and index.events().count() == 1
    fork(logs)
    index.refresh([str(logs)])
    assert [r.session_id for r in index.canonical().collect()] == ["orig"]


def test_growth_reads_the_new_bytes_only(spark, tmp_path):
    logs, spans = tmp_path / "logs", []
    one, two = tokens(usage(5, 0, 0, 1, 0, 6), at="2026-07-30T00:00:00Z"), json.dumps(tokens(usage(9, 0, 0, 1, 0, 10), at="2026-07-30T00:00:01Z"))
    path = write(logs / "a.jsonl", meta("s"), one, tail=two[:30])
    write(logs / "other.jsonl", meta("t"), tokens(usage(7, 0, 0, 1, 0, 8), at="2026-07-29T00:00:00Z"))
    index = UsageIndex(spark, str(tmp_path / "index"), lambda s, ranges: (spans.append(ranges), read_lines(s, ranges))[1])
    told = []
    first = index.refresh([str(logs)], progress=told.append)
    assert [t["phase"] for t in told] == ["discover", "scan", "publish"] and index.events().count() == 2
    with open(path, "a") as f:  # ends the open line; the model comes late
        f.write(two[30:] + "\n" + json.dumps(context("late")) + "\n")
    second = index.refresh([str(logs)])
    assert [(s[0], s[1] > 0) for s in spans[-1]] == [(path, True)]
    rows = index.events().where(F.col("file_path") == path).orderBy("event_index").collect()
    assert [(r.input_tokens, r.model) for r in rows] == [(5, "late"), (4, "late")] and index.canonical().count() == 3
    fresh = UsageIndex(spark, str(tmp_path / "again"))
    fresh.refresh([str(logs)])
    assert sorted(map(tuple, fresh.canonical().collect())) == sorted(map(tuple, index.canonical().collect()))
    assert sorted(map(tuple, fresh.files().collect())) == sorted(map(tuple, index.files().collect()))
    # A file that does not go on where it ended is read from its beginning.
    text = open(path).read()
    with open(path, "w") as f:
        f.write(text.replace('"late"', '"soon"') + "\n")
    index.refresh([str(logs)])
    assert {r.model for r in index.events().where(F.col("file_path") == path).collect()} == {"soon"}
    assert first["revision"] + 1 == second["revision"] and index.fingerprint([str(logs)]) != index.fingerprint([str(logs)], first)
    with pytest.raises(Conflict):
        index._publish(second)


def test_failures_keep_what_was_known(spark, tmp_path):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    logs = tmp_path / "logs"
    path = write(logs / "day" / f"x-{u}.jsonl", meta("s"), tokens(usage(5, 0, 0, 1, 0, 6), at="2026-07-30T00:00:00Z"))
    index = UsageIndex(spark, str(tmp_path / "index"))
    index.refresh([str(logs)])
    # Moved to another folder and damaged: the events of the old place stay.
    os.unlink(path)
    (logs / "archive").mkdir()
    (logs / "archive" / f"y-{u.upper()}.jsonl.zst").write_bytes(b"\x28\xb5\x2f\xfd\x00")
    index.refresh([str(logs)])
    assert index.events().count() == 1 and index.status()["failures"][0]["usingPreviousIndex"]
    # Changed while it was read: the old rows stay too.
    path = write(logs / "z.jsonl", meta("t"), tokens(usage(7, 0, 0, 1, 0, 8), at="2026-07-30T00:00:00Z"))
    index.refresh([str(logs)])
    write(logs / "z.jsonl", meta("t"))
    index._scan = lambda s, spans: s.createDataFrame([(p[0], 0, 0, None, False, json.dumps({"code": "LOG_CHANGED", "message": "m"})) for p in spans], LINES)
    index.refresh([str(logs)])
    assert index.events().count() == 2 and {f["code"] for f in index.status()["failures"]} == {"LOG_CHANGED", "LOG_DECODE_FAILED"}
    index._scan = read_lines
    index.refresh([str(logs)])
    assert index.events().count() == 2  # retried only when it changes, or on request
    index.refresh([str(logs)], retry_failures=True)
    assert index.events().count() == 1


def test_a_refresh_can_be_called_off(spark, tmp_path):
    write(tmp_path / "logs" / "a.jsonl", meta("s"), tokens(usage(5, 0, 0, 1, 0, 6)))
    index = UsageIndex(spark, str(tmp_path / "index"))
    index._scan = lambda s, spans: (index.abort(), read_lines(s, spans))[1]
    with pytest.raises(Aborted):
        index.refresh([str(tmp_path / "logs")])
    assert index.manifest()["revision"] == 0 and not [d for d in os.listdir(tmp_path / "index") if d.startswith("v-")]
    index._scan = read_lines
    assert index.refresh([str(tmp_path / "logs")])["revision"] == 1


def test_a_log_of_any_kind_of_change(tmp_path):
    path = write(tmp_path / "a.jsonl", meta("s"), tokens(usage(5, 0, 0, 1, 0, 6)))
    rows = range_lines(Range(path))
    next(rows)
    os.utime(path, (1, 1))
    assert json.loads(list(rows)[-1][3])["code"] == "LOG_CHANGED"
    size = os.path.getsize(path)
    places = [r[0] for r in range_lines(Range(path)) if r[1]]
    (status,) = [r[3] for r in range_lines(Range(path, places[1], None, size, "another"))]
    assert json.loads(status)["code"] == "LOG_REPLACED"  # the hash differs, so the caller reads the whole file


def test_unknown_times_are_counted_and_left_out(spark, tmp_path):
    write(tmp_path / "x.jsonl", context("gpt-5.4"), tokens(usage(5, 0, 0, 1, 0, 6)))
    out = run(spark, UsageQuery(roots=(str(tmp_path),), group="day"))
    assert out["rows"][0]["key"] == "(unknown time)" and out["totals"]["unpriced_requests"] == 1
    out = run(spark, UsageQuery(roots=(str(tmp_path),), to_ms=10**13))
    assert out["totals"]["requests"] == 0 and out["stats"]["excluded_unknown_timestamp_tokens"] == 6


def test_sort_limit_and_sinks(spark, tmp_path):
    for i, m in enumerate(("a", "B", "c")):
        write(tmp_path / f"{m}.jsonl", meta(m), context(m), tokens(usage(10, 0, 0, i, 0, 10), at="2026-01-01T00:00:00Z"))
    out = run(spark, UsageQuery(roots=(str(tmp_path),), group="model", limit=2))
    assert [r["key"] for r in out["rows"]] == ["c", "B"] and out["rowCount"] == 3
    out = run(spark, UsageQuery(roots=(str(tmp_path),), group="model", sort="key", desc=False))
    assert [r["key"] for r in out["rows"]] == ["a", "B", "c"]
    csv = to_csv(out["rows"] + [{"key": 'x,"y'}]).split("\n")
    assert csv[0].startswith("group,sessions,requests") and len(csv[0].split(",")) == 25 and csv[-1].startswith('"x,""y"')
    assert "unpriced_models:" in to_text(out)


def test_options():
    q = parse_args(["--from", "2026-11-01", "--to", "2026-11-01", "--timezone", "America/Los_Angeles", "--group", "model"], env={})
    assert q.to_ms - q.from_ms == 25 * 3_600_000 and q.descending and q.sort_name == "total"
    assert not parse_args(["--group", "day"], env={}).descending
    assert parse_args(["--last", "2d"], now_ms=10 * 86_400_000, env={}).from_ms == 8 * 86_400_000
    assert parse_duration("2w") == 14 * 86_400_000 and rolling("24h", 90_061_000) == (3_660_000, 90_060_000)
    assert web_limit(None, "cwd") == 30 and web_limit("900", "day") == 500
    for bad in (["--group", "x"], ["--from", "2026-02-30"], ["--limit", "-1"], ["--nope"], ["--tz", "Mars/One"], ["--from"]):
        with pytest.raises(ValueError):
            parse_args(bad, env={})
    with pytest.raises(ValueError, match="does not exist"):
        parse_bound("2011-12-30", "Pacific/Apia")


def test_http(spark, tmp_path):
    fork(tmp_path / "logs")
    index = UsageIndex(spark, str(tmp_path / "index"))
    server = serve(QueryService(index), {"all": [str(tmp_path / "logs")]}, 0)
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda path, method="GET": json.load(urllib.request.urlopen(urllib.request.Request(base + path, method=method)))
    assert get("/api/health") == {"ok": True}
    assert get("/api/index/refresh", "POST")["revision"] == 1
    assert get("/api/usage?group=model")["totals"]["requests"] == 1
    for path, method, code in (("/api/usage?group=x", "GET", 400), ("/api/usage?limit=a", "GET", 400), ("/api/usage", "POST", 405), ("/none", "GET", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path, method)
        assert e.value.code == code
    server.shutdown()
    assert query_of({"range": "7d"}, now_ms=10**12).bounded


def test_cli(spark, tmp_path):
    fork(tmp_path / "logs")
    out, err = io.StringIO(), io.StringIO()
    assert main(["--sessions", str(tmp_path / "logs"), "--json"], out, err) == 0
    assert json.loads(out.getvalue())["totals"]["requests"] == 1
    assert main(["--nope"], out, err) == 1
    (tmp_path / "logs" / "e.jsonl.zst").write_bytes(b"")
    assert main(["--sessions", str(tmp_path / "logs")], io.StringIO(), err) == 2


def test_stream_refreshes_the_index(spark, tmp_path):
    from quillmeter.streaming.incremental import stream_refresh

    fork(tmp_path / "logs")
    index = UsageIndex(spark, str(tmp_path / "index"))
    start = lambda: stream_refresh(spark, index, [str(tmp_path / "logs")], str(tmp_path / "checkpoint")).awaitTermination(120)
    start()
    assert index.canonical().count() == 1 and index.events().count() == 2
    write(tmp_path / "logs" / "c d.jsonl", meta("c"), tokens(usage(7, 0, 0, 1, 0, 8), at="2026-07-30T00:00:00Z"))
    spans = []
    plain = index._scan
    index._scan = lambda s, ranges: (spans.append([os.path.basename(r[0]) for r in ranges]), plain(s, ranges))[1]
    start()  # goes on from its checkpoint: the new file only
    assert spans == [["c d.jsonl"]] and index.canonical().count() == 2
    start()
    assert len(spans) == 1


def test_logs_are_written_exactly_once(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.jsonl", 2, "two"), ("a/x.jsonl", 1, "one"), ("b.jsonl.zst", 1, "packed")], "name string, line_no long, line string")
    folder = str(tmp_path / "logs")
    assert write_logs(rows, folder, "batch-1") == 2 and write_logs(rows, folder, "batch-1") == 0
    assert (tmp_path / "logs" / "a" / "x.jsonl").read_text() == "one\ntwo\n"
    marker = str(tmp_path / "failed")

    def once(batches):  # the first task fails after half its lines
        for batch in batches:
            yield batch.slice(0, 1)
            if not os.path.exists(marker):
                open(marker, "w").close()
                raise OSError("lost")
            yield batch.slice(1)

    more = spark.createDataFrame([("a/x.jsonl", i, f"line {i}") for i in range(3, 9)], rows.schema).coalesce(1)
    with pytest.raises(Exception, match="lost"):  # no retries on one machine
        write_logs(more.mapInArrow(once, more.schema), folder, "batch-2")
    assert (tmp_path / "logs" / "a" / "x.jsonl").read_text() == "one\ntwo\n"
    write_logs(more.mapInArrow(once, more.schema), folder, "batch-2")
    assert (tmp_path / "logs" / "a" / "x.jsonl").read_text().split() == "one two line 3 line 4 line 5 line 6 line 7 line 8".split()
    # A commit that ran half, or twice, leaves the same bytes.
    (tmp_path / "piece").write_text("tail\n")
    final = tmp_path / "f.jsonl"
    final.write_text("head\nta")
    for _ in range(2):
        place(str(tmp_path / "piece"), str(final), 5)
        assert final.read_text() == "head\ntail\n"


def growing(folder, step, r):
    """Logs that grow, are replaced, vanish, share events, and get their context late."""
    folder.mkdir(parents=True, exist_ok=True)
    count = lambda i, k: tokens(usage(i * k, i, 0, k, 0, i * k + k), at=f"2026-03-{1 + i % 20:02d}T00:00:00Z")
    if step == 0:
        for f in range(6):
            write(folder / f"f{f}.jsonl", *([meta(f"s{f}", "/w")] if f % 2 else []), *(x for i in range(1, 30) for x in ([context(f"m{i % 3}", f"t{i}")] if i % 5 == 0 and f != 4 else []) + [count(i, 3 if f < 2 else f + 3)]))
        return
    for f in r.sample(range(6), 2):
        path = folder / f"f{f}.jsonl"
        if path.exists():
            with open(path, "a") as out:
                out.write("".join(json.dumps(x) + "\n" for x in [count(30 * step + i, f + 3) for i in range(4)] + [r.choice([context("late", None, "/late"), meta("late"), count(5, 3)])]))
                out.write(r.choice(["", json.dumps(count(1000 + step, 2))]))
    if step == 2:
        os.unlink(folder / "f0.jsonl")
    if step == 3:
        write(folder / "f1.jsonl", meta("new"), count(7, 3), count(8, 3))
    if step == 4:
        write(folder / "f0.jsonl", meta("back"), *(count(i, 3) for i in range(1, 20)))


@pytest.mark.parametrize("rows", [200_000, 25])
def test_runs_give_what_a_new_index_gives(spark, tmp_path, monkeypatch, rows):
    """With one bucket a table and with many, over growth, replacement, deletion and merging of runs."""
    import random

    monkeypatch.setattr(incremental, "BUCKET_ROWS", rows)
    monkeypatch.setattr(incremental, "TOGETHER", 10)
    monkeypatch.setattr(incremental, "RUNS", 3)
    r, logs = random.Random(5), tmp_path / "logs"
    index, merged = UsageIndex(spark, str(tmp_path / "index")), 0
    for step in range(6):
        growing(logs, step, r)
        manifest = index.refresh([str(logs)])
        merged += any(x["id"].endswith("-m") for x in manifest["runs"])
        if step in (3, 5):
            fresh = UsageIndex(spark, str(tmp_path / f"fresh{step}"))
            fresh.refresh([str(logs)])
            kept = index.canonical()
            for group in ("day", "session"):
                whole = A.grouped(priced(kept, spark, built_in()), UsageQuery(group=group, timezone="Asia/Kolkata")).withColumn("key", F.substring_index("key", " ", -1) if group == "session" else F.col("key"))
                got = index.usage(group, "Asia/Kolkata")
                assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect())), (step, group)
            for table in ("events", "canonical", "files"):
                assert sorted(map(str, getattr(index, table)().collect())) == sorted(map(str, getattr(fresh, table)().collect())), (step, table)
    assert merged and len(manifest["runs"]) < 4
    if rows == 25:
        assert any(x["tables"]["events"].get("directory") for x in manifest["runs"])


def folder_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_a_refresh_costs_what_changed(spark, tmp_path, monkeypatch):
    """One more line in one of many files: what is written does not depend on the index, and few buckets are read."""
    monkeypatch.setattr(incremental, "BUCKET_ROWS", 100)
    monkeypatch.setattr(incremental, "TOGETHER", 20)
    logs = tmp_path / "logs"
    for f in range(30):
        write(logs / f"f{f}.jsonl", meta(f"s{f}"), context("m"), *(tokens(usage(i, 0, 0, f, 0, i + f), at=f"2026-03-01T00:{i:02d}:{f:02d}Z") for i in range(1, 60)))
    index = UsageIndex(spark, str(tmp_path / "index"))
    first = index.refresh([str(logs)])
    whole = folder_bytes(tmp_path / "index" / first["runs"][0]["id"])
    assert first["runs"][0]["tables"]["events"]["of"] == 18 and first["runs"][0]["tables"]["canonical"]["of"] == 18
    with open(logs / "f7.jsonl", "a") as f:
        f.write(json.dumps(tokens(usage(99, 0, 0, 7, 0, 106), at="2026-03-02T00:00:00Z")) + "\n")
    read, table = [], index._table
    index._table = lambda run, name, buckets=None: (read.append((run["id"], name, None if buckets is None else len(buckets & set(run["tables"].get(name, {}).get("buckets", []))))), table(run, name, buckets))[1]
    second = index.refresh([str(logs)])
    assert len(second["runs"]) == 2 and second["runs"][1]["tables"]["events"]["rows"] == 1
    assert folder_bytes(tmp_path / "index" / second["runs"][1]["id"]) < whole / 4
    old = [(name, n) for run, name, n in read if run == first["runs"][0]["id"]]
    assert max(n for name, n in old if name == "events") <= 3  # those of the grown file
    assert max(n for name, n in old if name == "canonical") <= 2  # those whose filter may hold the new fingerprint
    assert index.events().count() == 30 * 59 + 1 == index.canonical().count()


def test_a_change_elsewhere_leaves_answers(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / name / "x.jsonl", meta(name), context("gpt-5.4"), tokens(usage(5, 0, 0, 1, 0, 6), at="2026-07-30T00:00:00Z"))
    index = UsageIndex(spark, str(tmp_path / "index"))
    roots = [str(tmp_path / n) for n in ("a", "b")]
    index.refresh(roots)
    service = QueryService(index)
    one, other = (service.query(UsageQuery(roots=(x,), group="model")) for x in roots)
    write(tmp_path / "b" / "y.jsonl", meta("c"), context("gpt-5.4"), tokens(usage(9, 0, 0, 1, 0, 10), at="2026-07-30T00:00:00Z"))
    index.refresh(roots)
    assert service.query(UsageQuery(roots=(roots[0],), group="model")) is one
    assert service.query(UsageQuery(roots=(roots[1],), group="model"))["totals"]["requests"] == other["totals"]["requests"] + 1


def test_small_files_share_tasks(spark, tmp_path):
    spans = []
    for f in range(200):
        path = write(tmp_path / f"f{f}.jsonl", meta(f"s{f}"), tokens(usage(f, 0, 0, 1, 0, f + 1)))
        spans.append((path, 0, os.path.getsize(path), None))
    rows = read_lines(spark, spans)
    assert rows.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    assert rows.where("status IS NULL").groupBy("file_path").count().where("count = 2").count() == rows.where("status IS NOT NULL").count() == 200
    large, small = [Range("l", 0, None, 300 << 20)] * 2, [Range("s", 0, None, 10)] * 5
    assert dealt([*small, *large, *small], 2) == [small, large[:1], large[1:], small] and dealt(small, 9) == [[x] for x in small]


def test_failures_are_held_against_the_index_once(spark, tmp_path, monkeypatch):
    """Some plain logs give way to damaged compressed ones: work on names grows with the files, not with failures by files."""
    n, asked, plain = 30, [], incremental.identity
    for f in range(n):
        write(tmp_path / "logs" / f"f{f}.jsonl", meta(f"s{f}"), tokens(usage(f, 0, 0, 1, 0, f + 1), at="2026-07-30T00:00:00Z"))
    index = UsageIndex(spark, str(tmp_path / "index"))
    index.refresh([str(tmp_path / "logs")])
    for f in range(n // 2):
        os.rename(tmp_path / "logs" / f"f{f}.jsonl", tmp_path / "logs" / f"f{f}.jsonl.zst")
    monkeypatch.setattr(incremental, "identity", lambda p: (asked.append(p), plain(p))[1])
    index.refresh([str(tmp_path / "logs")])
    assert [f["usingPreviousIndex"] for f in index.status()["failures"]] == [True] * (n // 2) and index.events().count() == n
    assert len(asked) <= 4 * n


def test_no_frame_looks_ahead_from_every_row(spark):
    rows = records(spark.createDataFrame([], LINES))
    carried = spark.createDataFrame([], carried_in(spark.createDataFrame([], STATE)).schema)
    assert "unboundedfollowing" not in events_of(first_of_repeats(rows), carried)._jdf.queryExecution().analyzed().toString().lower()


class CountedPath(str):
    """A path that counts how often it is compared."""

    compared = 0
    __hash__ = str.__hash__

    def __eq__(self, other):
        CountedPath.compared += 1
        return str.__eq__(self, other)


def test_grown_files_are_looked_up(spark, tmp_path):
    """Many files grow and some bring context that they lacked: paths are compared in proportion to the files."""
    n = 40
    for f in range(n):
        write(tmp_path / "logs" / f"f{f:02d}.jsonl", tokens(usage(f + 1, 0, 0, 1, 0, f + 2), at="2026-07-30T00:00:00Z"))
    index = UsageIndex(spark, str(tmp_path / "index"))
    index.refresh([str(tmp_path / "logs")])
    for f in range(n):
        with open(tmp_path / "logs" / f"f{f:02d}.jsonl", "a") as out:
            out.write(json.dumps(context("late") if f % 2 else tokens(usage(900 + f, 0, 0, 1, 0, 901 + f), at="2026-07-30T00:01:00Z")) + "\n")
    stage, reopened = index._stage, index._reopened
    index._stage = lambda *a: {CountedPath(p): s for p, s in stage(*a).items()}
    index._reopened = lambda *a: [CountedPath(p) for p in reopened(*a)]
    index.refresh([str(tmp_path / "logs")])
    assert index.events().count() == n + n // 2 and index.events().where("model = 'late'").count() == n // 2
    assert CountedPath.compared <= 12 * n


def test_logs_are_put_in_place_by_all_cores(spark, tmp_path):
    rows = spark.createDataFrame([(f"d/{i}.jsonl", 0, "x") for i in range(40)], "name string, line_no long, line string")
    sc = spark.sparkContext
    sc.setJobGroup("placing", "")
    try:
        assert write_logs(rows, str(tmp_path / "logs")) == 40 == len(os.listdir(tmp_path / "logs" / "d"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    last = max(tracker.getJobIdsForGroup("placing"))
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("placing") if j >= last - 1 for i in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= sc.defaultParallelism

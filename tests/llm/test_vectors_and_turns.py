"""Searches over vectors and repair of conversations, against plain Python versions."""

import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import hard_negatives, neighbours, turn_repair

VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(seed, n, width, groups, spread=0.2):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [[x + r.gauss(0, spread) for x in centers[i % groups]] for i in range(n)]


def mined(rows, top=5, every=100):
    """Every anchor against all rows."""
    rows = [(i, v, label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in rows), default=0)
    rows = [(i, [math.floor(256 * x) for x in v] + [0] * (width - len(v)), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = set()
    for i, a, own in {i: (i, a, own) for i, a, own in sorted(rows, key=lambda x: (x[2], x[1]), reverse=True) if i % every == 0}.values():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, label) for j, v, label in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == own][:top]:
            fits = [s for s in scored if s[2] != own and 80 * -p <= 100 * -s[0] <= 100 * -p][:top]
            out |= {(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(fits, 1)}
    return out


def float32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def negatives(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit("x"), "cluster": F.lit("y"), "vector": F.lit("z")})
    rows = docs.where(hard_negatives.finite(F.col("embedding"))).select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), hard_negatives.scaled(F.col("embedding")).alias("vector"))
    return [tuple(x) for x in hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, **sizes).collect()]


@pytest.mark.parametrize("clusters, list_rows", [(1024, 4096), (1024, 64), (1, 16)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, clusters, list_rows):
    monkeypatch.setattr(hard_negatives, "PER_CLUSTER", 20)
    monkeypatch.setattr(hard_negatives, "FIRST", 2)
    vectors = clustered(1, 700, 6, 9)
    vectors[100:160] = [vectors[100]] * 60  # copies: ties by id
    rows = [(i, [float32(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    got = negatives(spark, rows, clusters=clusters, list_rows=list_rows)
    assert len(got) == len(set(got)) and set(got) == mined(rows)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (3, [1.0, 2.0], 1), (4, [1.0, 1.9], 2), (5, [1.0], 2), (6, [1.0, nan], 2), (8, [inf, 1.0], 2), (9, [1.0, None], 2), (10, None, 2), (11, [1.0, 2.0], None), (None, [1.0, 2.0], 2)]
    rows += [(4, [1.0, 1.9], 2), (100, [-1.0, -1.0], 4), (200, [0.0, 0.0], 5), (201, [3.0, 1.0], 5), (202, [], 5)]
    got = negatives(spark, rows)
    ids = {(a, p, k, n) for a, p, k, n, _, _ in got}
    assert {(0, 3, 1, 201), (0, 3, 2, 4), (0, 3, 3, 4)} <= ids  # a repeated row is a candidate each time
    assert {n for a, _, _, n, _, _ in got if a == 0} == {4, 201} and {p for a, p, *_ in got if a == 200} == {201, 202}
    assert all(a != n for a, _, _, n, _, _ in got) and not [x for x in got if x[0] == 100]
    assert negatives(spark, rows[:0]) == []
    with pytest.raises(Exception, match="63 bits"):
        negatives(spark, [(0, [1e17], 1), (1, [1e17], 1)])


def nearest(rows, every, top=5):
    """Brute force: query to its (id, cosine), nearest first."""
    rows = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    out = {}
    for q, a in rows:
        if q % every == 0:
            out[q] = sorted((-round(cosine(a, b), 12), j) for j, b in rows if j != q)[:top]
    return out


def recall(got, want):
    found = {}
    for q, rank, j, score in got:
        found.setdefault(q, {})[rank] = (j, score)
    assert set(found) == {q for q in want if want[q]}
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, len(want[q]) + 1))
        assert [(-round(s, 12), j) for _, (j, s) in sorted(ranks.items())] == sorted((-round(s, 12), j) for j, s in ranks.values())
    hits = sum(len({j for _, j in want[q]} & {j for j, _ in found[q].values()}) for q in found)
    return hits / sum(len(want[q]) for q in found)


@pytest.mark.parametrize("groups, spread, shard_rows", [(1, 1.0, 16_384), (40, 0.02, 300)])
def test_neighbours_are_found(spark, groups, spread, shard_rows):
    """Without clusters, and in tight clusters over several shards; copies of a vector come by their ids."""
    vectors = clustered(2, 1500, 16, groups, spread)
    vectors[200:400] = [vectors[200]] * 200
    rows = [(i, [float32(x) for x in v], 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit("x"), "ids": F.lit("y"), "vector": F.lit("z")})
    got = [tuple(x) for x in neighbours.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect()]
    want = nearest([(i, v) for i, v, _ in rows], 20)
    assert recall(got, want) >= 0.98
    found = {(q, r): (j, s) for q, r, j, s in got}
    for q in (220, 380):
        assert [found[q, r][0] for r in range(1, 6)] == [200, 201, 202, 203, 204] and found[q, 1][1] == pytest.approx(1, abs=1e-12)
    assert [found[200, r][0] for r in range(1, 6)] == [201, 202, 203, 204, 205]


def test_neighbours_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = [tuple(x) for x in neighbours.op13_nearest_neighbours(spark, folder).collect()]
    assert recall(got, nearest([tuple(x) for x in rows], 50)) >= 0.9


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [], 0), (6, [2.0], 0), (7, [1e-30, 1e-30], 0), (8, [1e30, -1e30], 0), (7, [1e-30, 1e-30], 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = [tuple(x) for x in neighbours.nearest_neighbours(frame, F.col("vec_id") == 0).collect()]
    assert [(q, r, j) for q, r, j, _ in sorted(got)] == [(0, 1, 6), (0, 2, 7), (0, 3, 7), (0, 4, 8)]
    assert [round(x[3], 9) for x in sorted(got)] == [1.0, *[round(math.sqrt(0.5), 9)] * 3]
    assert neighbours.nearest_neighbours(frame, F.col("vec_id") == 99).count() == 0
    assert neighbours.nearest_neighbours(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest_neighbours(frame.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_pruning_keeps_diverse_edges():
    angles = np.radians([0, 1, 2, 3, 40, 41, 180])
    x = np.column_stack([np.cos(angles), np.sin(angles)]).astype(np.float32)
    kept = neighbours.robust_prune(x, np.array([0], np.int32), np.array([[6, 5, 4, 3, 2, 1, 0, 1, -1]], np.int32), 3, 1.2)[0]
    assert kept.tolist() == [1, 4, 6]  # 2 and 3 lie behind 1, and 5 behind 4


TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def fixed(rows):
    """Best repair of ordered (turn, role, text) rows, by trying every edit."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    follow = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}  # by the initial before
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(2):
            for at, (cost, audit, out) in list(best.items()):
                role = "assistant" if at == "u" else "user"
                new = (cost + 2, audit + "I", (*out, (role, "")))
                best[role[0]] = min(best.get(role[0], new), new)
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for at, (cost, audit, out) in inserts(best).items():
            late = fault == "t"
            forced = "assistant" if at == "u" else "user"
            options = [(at, (cost + 3, audit + "D", out))]
            if fault in ("", "t"):
                options.append((forced[0], (cost + 2 + late, audit + "R", (*out, (forced, text)))))
                if at in follow.get(role[:1], {}):
                    options.append((follow[role[:1]][at], (cost + late, audit + "K", (*out, (role, text)))))
            for state, option in options:
                after[state] = min(after.get(state, option), option)
        best = after
    cost, audit, out = min(v for k, v in inserts(best).items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = ["".join(p) for p in zip([r[1][:1] for r in rows], [r[1][:1] for r in rows[1:]], strict=False)]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest, out


def repaired(spark, rows, schema=TURNS):
    frame = spark.createDataFrame(rows, schema).withColumns({"audit": F.lit(1), "kind": F.lit("x"), "digest": F.lit("y"), "first": F.lit(2)})
    done = turn_repair.repair(frame)
    whole = {x[0]: tuple(x)[1:] for x in turn_repair.conclude(done).collect()}
    kept = sorted(turn_repair.repaired_rows(done).collect(), key=lambda x: (x.part, x.chunk, x.place))
    return whole, {c: tuple((x.role, x.text) for x in kept if x.conv_id == c) for c in whole}


@pytest.mark.parametrize("chunk", [64, 3, 1])
def test_repair_equals_trying_everything(spark, monkeypatch, chunk):
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [(c, t, r.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), r.choice(["Yes.", "no", " \n", "Go!", f"{t} is.", f"{t} is"])) for c in range(60) for t in range(r.choice([1, 2, 5, 8, 30]))]
    whole, kept = repaired(spark, rows)
    for c in range(60):
        want = fixed([(t, role, text) for conv, t, role, text in rows if conv == c])
        assert whole[c] == want[:-1]
        assert kept[c] == want[-1]


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 4, "user", "Hm."), (None, 4, "user", "Hm."), (None, 1, "user", "Hm."), (1, 0, "user", "x" * 5_000_000), (1, 1, "assistant", "y" * 5_000_000 + "."), (1, None, "system", "Be."), (2, 7, "user", ""), (3, -2, "user", "A\u0085"), (3, 3, "assistant", "ok.\x0b ")]
    whole, kept = repaired(spark, rows)
    for c, turns in ((None, [(None, " ", " "), (1, "user", "Hm."), (4, "user", "Hm."), (4, "user", "Hm.")]), (1, [(None, "system", "Be."), (0, "user", "x" * 5_000_000), (1, "assistant", "y" * 5_000_000 + ".")]), (2, [(7, "user", "")]), (3, [(-2, "user", "A\u0085"), (3, "assistant", "ok.\x0b ")])):
        want = fixed(turns)
        assert whole[c] == want[:-1] and kept[c] == want[-1]
    assert whole[1][6] == "KKK" and whole[2][6] == "D" and whole[2][7] == hashlib.sha256(b"").hexdigest() and whole[3][0] == 4
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.conclude(turn_repair.repair(empty)).count() == 0


def test_repair_of_a_long_conversation_spreads(spark):
    """One conversation holds most rows; its chunks come from several tasks, and it is repaired as a whole."""
    rows = [(0, t, ("user", "assistant", "assistant")[t % 3], f"{t}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(1, 40)]
    frame = spark.createDataFrame(rows, TURNS).repartition(8)
    marked = turn_repair.with_faults(frame)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = turn_repair.chunks(marked)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert packed.where("conv_id = 0").select("part").distinct().count() > 1
    assert packed.agg(F.max(F.size("turns"))).first()[0] <= turn_repair.CHUNK
    got = {x[0]: tuple(x)[1:] for x in turn_repair.conclude(turn_repair.audited(packed)).collect()}
    assert got[0] == fixed([(t, role, text) for c, t, role, text in rows if c == 0])[:-1]
    assert {got[c][6] for c in range(1, 40)} == {"KI"}


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in range(5) for t in range(30)] + [(None, None, None, None)]
    got = sorted((tuple(x) for x in turn_repair.damaged(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if kind == 4 else role or " "), ("" if kind == 1 else "a b c" if kind == 2 and text else text or " ")
        want += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=str)

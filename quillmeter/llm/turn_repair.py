"""Repair of a conversation's structure: the cheapest edits that give ``(s?(ua)+)?``, by layers of cost.

The grammar has four states: begun, after the system row, a user row open, closed. Which role an inserted or rewritten row
gets follows from the state, so an audit (the initials of the edits in order: Keep, Rerole, Delete, Insert) settles the
repair. A layer holds, for each row of a conversation, the bitset of the states from which the rest can be accepted
for at most the layer's cost; layers come in the order of their cost, each from those 1, 2 and 3 below it, by tables over
the 16 bitsets. The first layer that holds the initial state before the first row gives the cost, and a walk through
the bits that takes the least initial that keeps within its layer gives the least audit.

Rows are sorted by range over conversation and place, so a conversation of any length spreads over tasks, and packed into
chunks of at most ``CHUNK`` rows and ``CHUNK_BYTES`` bytes of text. A conversation that ends within its chunk is done there.
For others, each chunk tells the costs from each state to each state; a pass over these small tables from the end gives each
chunk the costs of what follows, all chunks are traced at once from every state, and a pass from the start joins the traces.
Only hashing a whole repaired conversation (``conclude``) reads its chunks in order, one at a time.

Faults: the first of blank (nothing but ASCII white space), duplicate (role and text equal to an earlier row's) and truncated
(the last other character is none of ``.!?``). Repeats are found by counting digests before anything is sorted; digests of
many rows are spread.

Defined cases: null roles and texts count as one space; a null ``conv_id`` is a conversation; rows come by turn, nulls first,
rows of one turn by role, then by a digest of the text, and equal rows follow each other; roles of other initials can be
rewritten or deleted; a conversation without rows needs a row of the caller (``op12`` joins all ids); very long texts stand in
chunks of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, discard, lookup, save, table

CHUNK, CHUNK_BYTES = 64, 4 << 20
KEEP, REROLE, DELETE, INSERT = "KRDI"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_NEVER = 1 << 40
_INITIALS = "sua"
#: State after a row of each role (-1: none), the state and role that the grammar asks for, and costs of inserts at the end.
_NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
_FORCED, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_AT_END = (0, 4, 2, 0)


def _before(moves: tuple[int, ...]) -> bytes:
    """For each set of states, the set of states that one move leads into it."""
    return bytes(sum(1 << s for s in range(4) if moves[s] >= 0 and states >> moves[s] & 1) for states in range(16))


_KEPT = {c: _before(m) for c, m in _NEXT.items()}
_NONE, _MADE = bytes(16), _before(_FORCED)


def layers(rows: list[tuple[str, int]], after: tuple[int, ...], needed: int) -> list[bytearray]:
    """Layers over ``(initial, fault)`` rows until one holds all ``needed`` states before the first row.

    ``after`` has the cost of what follows the rows from each state.
    """
    n, out = len(rows), []
    tables = [_KEPT.get(c, _NONE) for c, _ in rows]
    empty = bytearray(n + 1)
    for cost in range(_NEVER):
        below = lambda d: out[cost - d] if cost >= d else empty  # noqa: B023, E731
        one, two, three, layer = below(1), below(2), below(3), bytearray(n + 1)
        layer[n] = sum(1 << s for s in range(4) if after[s] <= cost)
        for i in range(n - 1, -1, -1):
            fault = rows[i][1]
            states = three[i + 1] | _MADE[two[i]]
            if fault == 0:
                states |= tables[i][layer[i + 1]] | _MADE[two[i + 1]]
            elif fault == TRUNCATED:
                states |= tables[i][one[i + 1]] | _MADE[three[i + 1]]
            layer[i] = states
        out.append(layer)
        if layer[0] & needed == needed:
            return out
    raise AssertionError


def costs(found: list[bytearray]) -> list[int]:
    """Of each state before the first row: the first layer that holds it (``_NEVER`` if none does)."""
    return [next((k for k, layer in enumerate(found) if layer[0] >> s & 1), _NEVER) for s in range(4)]


def trace(rows: list[tuple[str, int]], after: tuple[int, ...], found: list[bytearray], state: int, last: bool) -> tuple[str, int]:
    """The least audit from ``state``, and the state at its end."""
    out, left, i, n = [], costs(found)[state], 0, len(rows)
    holds = lambda s, cost, i: s >= 0 and cost >= 0 and found[cost][i] >> s & 1
    while i < n:
        initial, fault = rows[i]
        late = int(fault == TRUNCATED)
        kept = _NEXT[initial][state] if initial in _INITIALS and initial else -1
        if holds(state, left - 3, i + 1):
            edit, left, i = DELETE, left - 3, i + 1
        elif holds(_FORCED[state], left - 2, i):
            edit, left, state = INSERT, left - 2, _FORCED[state]
        elif fault in (0, TRUNCATED) and holds(kept, left - late, i + 1):
            edit, left, i, state = KEEP, left - late, i + 1, kept
        else:
            edit, left, i, state = REROLE, left - 2 - late, i + 1, _FORCED[state]
        out.append(edit)
    if last:
        while _AT_END[state]:
            out.append(INSERT)
            state = _FORCED[state]
    return "".join(out), state


def applied(audit: str, state: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(edit, role, row)`` of every edit; ``row`` is None for an insert and ``role`` None for a deletion."""
    rows = iter(rows)
    for edit in audit:
        row = None if edit == INSERT else next(rows)
        if edit == DELETE:
            yield edit, None, row
            continue
        role = row[1] if edit == KEEP else _ROLE[state]
        state = _NEXT[role[0]][state] if edit == KEEP else _FORCED[state]
        yield edit, role, row


# --- faults -------------------------------------------------------------------------------------------------------


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, fault, first``: ``first`` is the first turn of rows like it if there are several."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    held = F.to_json(F.struct("conv_id"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length(held).cast("string"), F.lit(":"), held, F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    again = rows.groupBy("digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = save(again, "repeated-turns")
    rows = lookup(rows, again, "digest", "n")
    rest = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(rest == "", BLANK).when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), DUPLICATE).when(F.right(rest, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    marked = save(rows.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"), F.col("first").isNotNull().alias("several")), "turns")
    discard(again)
    return marked


# --- chunks -------------------------------------------------------------------------------------------------------

_CHUNK = "part int, chunk int, alone boolean, turns array<long>, roles array<string>, texts array<string>, faults array<int>, passes array<long>"


def _initial(role: str) -> str:
    return role[:1]


def _codes(roles: list[str], faults: list[int]) -> list[tuple[str, int]]:
    return [(_initial(r), f) for r, f in zip(roles, faults, strict=True)]


def _passes(rows: list[tuple[str, int]]) -> list[int]:
    """Costs from each state before the rows (four at a time) to each state after them."""
    out = [_NEVER] * 16
    for end in range(4):
        after = tuple(0 if s == end else _NEVER for s in range(4))
        reached = sum(1 << s for s in range(4) if _reaches(rows, s, end))
        if reached:
            for s, cost in enumerate(costs(layers(rows, after, reached))):
                out[4 * s + end] = cost
    return out


def _reaches(rows: list[tuple[str, int]], start: int, end: int) -> bool:
    """Inserts lead from any state into the open or the closed one; into the others only rows kept, or none."""
    if end >= 2:
        return bool(rows) or start == end
    states = {start}
    for initial, fault in rows:
        states |= {_NEXT[initial][s] for s in states if initial in _INITIALS and initial and fault in (0, TRUNCATED)} - {-1}
    return end in states


def chunks(rows: DataFrame) -> DataFrame:
    """Rows of ``with_faults`` in order, packed; ``alone`` chunks hold a whole conversation."""
    kind = dict(rows.dtypes)["conv_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, held, size, before, cut = TaskContext.get().partitionId(), 0, [], 0, None, False
        out: list[tuple] = []
        first = True

        def close(alone: bool) -> None:
            nonlocal done, held, size
            conv, turns, roles, texts, faults = held[0][0], *(list(x) for x in zip(*(h[1:] for h in held), strict=True))
            out.append((conv, part, done, alone, turns, roles, texts, faults, None if alone else _passes(_codes(roles, faults))))
            done, held, size = done + 1, [], 0

        def sent() -> pa.RecordBatch:
            types = [id_type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            names = ["conv_id", "part", "chunk", "alone", "turns", "roles", "texts", "faults", "passes"]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return batch

        id_type, queued = None, 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, turn, role, text, digest, fault, several in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is not None and conv != before[0]:
                    if held:
                        close(not cut and not first)
                    first, cut = False, False
                elif held and (len(held) >= CHUNK or size + len(text) > CHUNK_BYTES):
                    close(False)
                    cut = True
                if several and fault not in (BLANK, DUPLICATE) and before == (conv, turn, digest):
                    fault = DUPLICATE
                before = (conv, turn, digest)
                held.append((conv, turn, role, text, fault))
                size += len(text)
                queued += len(text)
                if len(out) >= 1000 or queued > CHUNK_BYTES and out:
                    yield sent()
                    queued = size
        if held:
            close(False)  # its conversation may go on in the next task
        if out:
            yield sent()

    place = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest")]
    sorted_ = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    return save(sorted_.mapInArrow(pack, f"conv_id {kind}, {_CHUNK}"), "turn-chunks")


def audited(packed: DataFrame) -> DataFrame:
    """Every chunk with ``state`` (before it) and ``audit``."""
    columns = [c for c in packed.columns if c != "passes"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = []
            for roles, faults in zip(batch.column("roles").to_pylist(), batch.column("faults").to_pylist(), strict=True):
                rows = _codes(roles, faults)
                audits.append(trace(rows, _AT_END, layers(rows, _AT_END, 1), 0, True)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([0] * len(audits), pa.int32()), pa.array(audits, pa.string())], names=[*batch.schema.names, "state", "audit"])

    schema = ", ".join(f"{c} {t}" for c, t in packed.dtypes if c != "passes") + ", state int, audit string"
    alone = packed.where("alone").select(*columns).mapInArrow(whole, schema)

    # Conversations of several chunks (or at a task's edge): costs from the end, traces, then states from the start.
    key = F.struct("conv_id").alias("key")
    parts = packed.where("NOT alone")

    def from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = None, None
        for batch in batches:
            last, costs_ = [], []
            for own, passes in zip(batch.column("key").to_pylist(), batch.column("passes").to_pylist(), strict=True):
                last.append(own != before)
                after, before = list(_AT_END) if own != before else after, own
                costs_.append(after)
                after = [min(min(passes[4 * s + e] + after[e] for e in range(4)), _NEVER) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("chunk"), pa.array(last), pa.array(costs_, pa.list_(pa.int64()))], names=["part", "chunk", "last", "after"])

    back = parts.select(key, "part", "chunk", "passes").repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("chunk"))
    followed = save(back.mapInArrow(from_the_end, "part int, chunk int, last boolean, after array<long>"), "turn-costs")

    def from_every_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, states = [], []
            for roles, faults, after, last in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "after", "last")), strict=True):
                rows, least = _codes(roles, faults), min(after)
                after = tuple(a - least for a in after)
                found = layers(rows, after, 15)
                both = [trace(rows, after, found, s, last) for s in range(4)]
                audits.append([a for a, _ in both])
                states.append([e for _, e in both])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("chunk"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))], names=["key", "part", "chunk", "audits", "ends"])

    kind = dict(packed.dtypes)["conv_id"]
    traced = parts.join(followed, ["part", "chunk"]).select(key, "part", "chunk", "roles", "faults", "after", "last")
    traced = save(traced.mapInArrow(from_every_state, f"key struct<conv_id:{kind}>, part int, chunk int, audits array<string>, ends array<int>"), "turn-traces")

    def from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = 0, None
        for batch in batches:
            states, audits = [], []
            for own, choices, after in zip(*(batch.column(c).to_pylist() for c in ("key", "audits", "ends")), strict=True):
                state = state if own == before else 0
                states.append(state)
                audits.append(choices[state])
                state, before = after[state], own
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("chunk"), pa.array(states, pa.int32()), pa.array(audits, pa.string())], names=["part", "chunk", "state", "audit"])

    ahead = traced.repartition("key").sortWithinPartitions("key", "part", "chunk").mapInArrow(from_the_start, "part int, chunk int, state int, audit string")
    joined = parts.join(save(ahead, "turn-audits"), ["part", "chunk"]).select(*columns, "state", "audit")
    discard(followed, traced)
    return alone.unionByName(joined)


# --- results ------------------------------------------------------------------------------------------------------

_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired_rows(done: DataFrame) -> DataFrame:
    """``conv_id, part, chunk, place, edit, turn, role, text`` of what stays and what is inserted, from ``audited`` chunks."""
    kind = dict(done.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, chunk, state, audit, *columns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "chunk", "state", "audit", "turns", "roles", "texts")), strict=True):
                for place, (edit, role, row) in enumerate(applied(audit, state, zip(*columns, strict=True))):
                    if role is not None:
                        out.append((conv, part, chunk, place, edit, row[0] if row else None, role, row[2] if row else ""))
            types = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "part", "chunk", "place", "edit", "turn", "role", "text"])

    return done.mapInArrow(run, f"conv_id {kind}, part int, chunk int, place int, edit string, turn long, role string, text string")


class _Totals:
    """What a conversation's chunks come to, one after the other."""

    def __init__(self):
        self.faults, self.illegal, self.cost, self.audit, self.any = [0, 0, 0, 0], 0, 0, [], False
        self.low = self.high = self.turn = None
        self.turns, self.before, self.hash = 0, None, hashlib.sha256()

    def add(self, state: int, audit: str, turns: list, roles: list, texts: list, faults: list) -> None:
        for turn, role, fault in zip(turns, roles, faults, strict=True):
            self.faults[fault] += 1
            if self.before is not None and self.before + _initial(role) not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = _initial(role)
            if turn is not None:
                self.turns += turn != self.turn
                self.turn, self.low, self.high = turn, turn if self.low is None else self.low, turn
        place = 0
        for edit, role, row in applied(audit, state, zip(turns, roles, texts, strict=True)):
            self.cost += {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}[edit]
            if edit != INSERT:
                self.cost += edit != DELETE and faults[place] == TRUNCATED
                place += 1
            if role is not None:
                self.hash.update(f"{chr(10) * self.any}{role}:{row[2] if row else ''}".encode())
                self.any = True
        self.audit.append(audit)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def conclude(done: DataFrame) -> DataFrame:
    """A row for each conversation: counts of faults, cost, audit, and a digest of what it was repaired to."""
    kind, names = dict(done.dtypes)["conv_id"], [x.split()[0] for x in _SUMMARY.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, out, conv_type = (), None, [], None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, alone, *chunk in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "alone", "state", "audit", "turns", "roles", "texts", "faults")), strict=True):
                if held != (conv,) or alone:
                    if total:
                        out.append((*held, *total.row()))
                    held, total = (conv,), _Totals()
                total.add(*chunk)
            if len(out) >= 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [conv_type, *types], strict=True)], names=["conv_id", *names])
                out = []
        if total:
            out.append((*held, *total.row()))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [conv_type, *types], strict=True)], names=["conv_id", *names])

    alone, several = done.where("alone"), done.where("NOT alone")
    several = several.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return alone.mapInArrow(run, f"conv_id {kind}, {_SUMMARY}").unionByName(several.mapInArrow(run, f"conv_id {kind}, {_SUMMARY}"))


def repair(rows: DataFrame) -> DataFrame:
    """``audited`` chunks of ``conv_id, turn, role, text``; see ``repaired_rows`` and ``conclude``."""
    marked = with_faults(rows)
    packed = chunks(marked)
    discard(marked)
    return audited(packed)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of the query: some dropped, emptied, without full stops, repeated or given to the user, by a checksum."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = conclude(repair(damaged(rows))).withColumnRenamed("conv_id", "__id")
    every = rows.select("conv_id").distinct()
    zero = hashlib.sha256(b"").hexdigest()
    names = [x.split() for x in _SUMMARY.split(", ")]
    filled = [F.coalesce(n, F.lit(0).cast("long") if t == "long" else F.lit(zero if n == "repaired_sha256" else "")).alias(n) for n, t in names]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("__id")), "left").select("conv_id", *filled)


_CRC = """xor(list_reduce(list_transform(range(length(s)), lambda i: CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)), lambda crc, b: list_reduce([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


def _inserted(reached: str) -> str:
    return f"list_transform({reached}, lambda e: {{'c': e.c + 2, 'a': e.a || 'I', 'o': e.o || chr(10) || CASE WHEN e.s = 2 THEN 'assistant:' ELSE 'user:' END, 's': CASE WHEN e.s = 2 THEN 3 ELSE 2 END}})"


def _with_inserts(reached: str) -> str:
    return f"list_concat({reached}, {_inserted(reached)}, {_inserted(_inserted(reached))})"


SQL = f"""WITH k AS (SELECT *, {_CRC} % 20 AS d FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations)),
m AS (SELECT conv_id, turn, d, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM k WHERE d <> 0),
n AS (SELECT m.*, c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), c) AS i FROM m, range(2) r(c) WHERE c = 0 OR d = 3),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, list({{'r': role, 't': text, 'f': fault}} ORDER BY i) AS turns FROM f GROUP BY conv_id),
h AS (SELECT *, list_reduce(turns, lambda best, x: list_filter(list_transform([0, 1, 2, 3], lambda s: list_sort(list_filter(list_concat(
    list_transform({_with_inserts('best')}, lambda e: {{'c': e.c + 3, 'a': e.a || 'D', 'o': e.o, 's': e.s}}),
    list_transform(list_filter({_with_inserts('best')}, lambda e: x.f IN (0, 3) AND CASE left(x.r, 1) WHEN 's' THEN e.s = 0 WHEN 'u' THEN e.s <> 2 WHEN 'a' THEN e.s = 2 ELSE false END), lambda e: {{'c': e.c + CASE WHEN x.f = 3 THEN 1 ELSE 0 END, 'a': e.a || 'K', 'o': e.o || chr(10) || x.r || ':' || x.t, 's': CASE left(x.r, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END}}),
    list_transform(list_filter({_with_inserts('best')}, lambda e: x.f IN (0, 3)), lambda e: {{'c': e.c + 2 + CASE WHEN x.f = 3 THEN 1 ELSE 0 END, 'a': e.a || 'R', 'o': e.o || chr(10) || CASE WHEN e.s = 2 THEN 'assistant:' ELSE 'user:' END || x.t, 's': CASE WHEN e.s = 2 THEN 3 ELSE 2 END}})),
  lambda e: e.s = s))[1]), lambda e: e IS NOT NULL), [{{'c': CAST(0 AS BIGINT), 'a': '', 'o': '', 's': 0}}]) AS reached FROM g),
b AS (SELECT *, list_sort(list_filter({_with_inserts('reached')}, lambda e: e.s IN (0, 3)))[1] AS best FROM h)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""

"""Repair of conversations: the cheapest edits after which the roles read system?, then user and assistant in turn.

Keeping a turn costs nothing, giving it another role 1, deleting it 2, inserting an empty turn 5; a turn with nothing to read, or one that
repeats an earlier turn, must be deleted, and one without an end (its last character isn't ``.``, ``!`` or ``?``) costs 5 more where it stays.
The edits are a shortest path through pairs of (turns consumed, state of the grammar). Its costs are small integers, so Dial's
bucket queue finds all distances to the end; the audit then follows tight arcs from the start, always by the least letter
(D, I, K, R: delete, insert, keep, rerole), which gives the least of all cheapest audits. From a state each letter leads to one place.

A conversation is cut into blocks of at most ``BLOCK_ROWS`` turns and ``BLOCK_BYTES`` of text, so one that holds a third of all turns
is spread over many tasks: each block's distances from its four states to its four states are a 4 x 4 matrix; the matrices of a
conversation are multiplied (minimum for sum, sum for product) from its end, which gives each block the distances at its end;
then every block walks from each state it may be entered in. What is left for one task are 4 x 4 matrices, and the final
pass that strings blocks together and hashes the repaired text as it streams by, which a single hash of it asks for.

Order: by turn, nulls first; ties go by role, the text's first 64 characters, and its SHA-256. Equal rows are each a turn, the later ones repeats.

Defined results: null roles and texts are one space (so such a text is blank, such a role no known one); a null conv_id is a
conversation like others; conv_id and turn are integers; a conversation that lost all turns has zeros, an empty audit and the hash of
the empty text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Turns that are handed on at once.
BATCH = 2048
SPACES = " \t\n\x0b\x0c\r"

# States: nothing yet, after a system turn, after a user's, after an assistant's. The conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state that a state's one next turn of user or assistant leads to, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
#: Costs from each state at the very end: only insertions are left.
AT_END = (0, 10, 5, 0)
KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: A turn's code: which role it has, and whether it must go or is unended.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, GONE, CUT = 3, 4, 8
#: Buckets; arcs cost 10 at most, and distances at the end of a block lie less than 20 apart.
SPAN = 32

_PLACED = "conv_id bigint, turn bigint, role string, text string, digest binary, part int, index bigint, block bigint"
_BLOCK = "conv_id bigint, part int, block bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint, codes binary, costs array<int>"
_WALK = "conv_id bigint, part int, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint, cost bigint, exits array<int>, audits array<string>"
_DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURN = "conv_id bigint, place bigint, edit string, role string, text string"


def kept_state(state: int, code: int) -> int:
    """The state after keeping a turn with this code; -1 if it can't be kept."""
    if code & GONE:
        return -1
    role = code & 3
    if state == START and role == 0:
        return SYSTEM
    return NEXT[state] if role != OTHER and role == (2 if NEXT[state] == ASSISTANT else 1) else -1


# For each code and state the arcs (into a state at the row's end, from a state before the row, cost).
_ARCS = []
for _code in range(16):
    _into: list[list[tuple[int, int]]] = [[(q, DELETE)] for q in range(STATES)]
    if not _code & GONE:
        _more = UNENDED if _code & CUT else 0
        for _q in range(STATES):
            if (_to := kept_state(_q, _code)) >= 0:
                _into[_to].append((_q, KEEP + _more))
            _into[NEXT[_q]].append((_q, REROLE + _more))
    _ARCS.append(_into)
_INSERTS = [[q for q in range(STATES) if NEXT[q] == to] for to in range(STATES)]


def distances(codes: bytes, goal: tuple[int, ...] | list[int]) -> list[int]:
    """Dial's algorithm backwards: the cost from each (turn, state), at turn * 4 + state, given the costs from the end's four states."""
    n = len(codes)
    dist = [NEVER] * (STATES * (n + 1))
    least = min(goal)
    buckets: list[list[int]] = [[] for _ in range(SPAN)]
    waiting = 0
    for q, d in enumerate(goal):
        if d < NEVER:
            dist[STATES * n + q] = d - least
            buckets[d - least].append(STATES * n + q)
            waiting += 1
    now = 0
    while waiting:
        bucket = buckets[now % SPAN]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            at, q = divmod(node, STATES)
            for p in _INSERTS[q]:
                other, d = STATES * at + p, now + INSERT
                if d < dist[other]:
                    dist[other] = d
                    buckets[d % SPAN].append(other)
                    waiting += 1
            if at:
                for p, cost in _ARCS[codes[at - 1]][q]:
                    other, d = STATES * (at - 1) + p, now + cost
                    if d < dist[other]:
                        dist[other] = d
                        buckets[d % SPAN].append(other)
                        waiting += 1
        now += 1
    return [d + least if d < NEVER else NEVER for d in dist]


def walk(codes: bytes, dist: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least of the cheapest audits from a state, and the state at the end. Only the last block inserts after its last turn."""
    n, at, out = len(codes), 0, []
    while at < n or (last and dist[STATES * at + state]):
        here = dist[STATES * at + state]
        if at < n and here == DELETE + dist[STATES * (at + 1) + state]:
            out.append("D")
            at += 1
        elif here == INSERT + dist[STATES * at + NEXT[state]]:
            out.append("I")
            state = NEXT[state]
        else:
            code = codes[at]
            to, more = kept_state(state, code), UNENDED if code & CUT else 0
            at += 1
            if to >= 0 and here == KEEP + more + dist[STATES * at + to]:
                out.append("K")
            else:
                out.append("R")
                to = NEXT[state]
            state = to
    return "".join(out), state


def _batches(rows: Iterator[tuple], schema: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows as batches with the names and types of a schema."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [()] * len(fields)
        out = pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])
        held.clear()
        return out

    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or size > BLOCK_BYTES:
            yield batch()
            size = 0
    yield batch()


def _place(most: int):
    """Number a sorted part's rows and blocks of at most ``most`` turns."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            block, index, held, size, before = -1, 0, 0, 0, object()
            for batch in batches:
                for conv, turn, role, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if conv != before or held >= most or size >= BLOCK_BYTES:
                        block, held, size, before = block + 1, 0, 0, conv
                    yield conv, turn, role, text, digest, part, index, block
                    index, held, size = index + 1, held + 1, size + len(text)

        return _batches(rows(), _PLACED)

    return run


def placed(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A written table of the turns in order (part, index), cut into blocks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "_head": F.substring("text", 1, 64), "_row": F.monotonically_increasing_id()})
    order = ("conv_id", "turn", "role", "_head", "digest", "_row")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "digest")
    return scratch.table(ordered.mapInArrow(_place(block_rows), _PLACED), "turns")


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """Blocks from rows in order; a row of its own (``first``) follows each turn that no earlier one equals."""

    def rows() -> Iterator[tuple]:
        key, held = None, []
        for batch in batches:
            for conv, turn, initial, blank, ended, part, _, block, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if marks:
                    held[-1][4] = True
                    continue
                if (part, block) != key:
                    if held:
                        yield _block(conv_before, *key, held)
                    key, held, conv_before = (part, block), [], conv
                held.append([turn, initial, blank, ended, False])
        if held:
            yield _block(conv_before, *key, held)

    return _batches(rows(), _BLOCK, 256)


def _block(conv: int | None, part: int, block: int, turns: list[list]) -> tuple:
    codes, faults, numbers, illegal = bytearray(), [0, 0, 0], set(), 0
    for k, (turn, initial, blank, ended, first) in enumerate(turns):
        fault = 0 if blank else 1 if not first else 2 if not ended else None
        if fault is not None:
            faults[fault] += 1
        codes.append(INITIALS.get(initial, OTHER) | (0 if fault is None else CUT if fault == 2 else GONE))
        if turn is not None:
            numbers.add(turn)
        illegal += k > 0 and turns[k - 1][1] + initial not in ("su", "ua", "au")
    codes = bytes(codes)
    costs = [NEVER] * (STATES * STATES)
    for to in range(STATES):
        dist = distances(codes, [0 if q == to else NEVER for q in range(STATES)])
        for q in range(STATES):
            costs[STATES * q + to] = min(dist[q], 1 << 30)
    return conv, part, block, len(turns), *faults, illegal, turns[0][1], turns[-1][1], min(numbers, default=None), max(numbers, default=None), len(numbers), codes, costs


def blocks(table: DataFrame) -> DataFrame:
    """A written table of the blocks: faults, edges, codes of the turns, and costs from each state to each state."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = table.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"), "part", "index", "block", F.lit(False).alias("marks"))
    first = table.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "index", "block")).alias("p")).select("p.part", "p.index", "p.block", F.lit(True).alias("marks"))
    both = narrow.unionByName(first, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "index", "marks")
    return scratch.table(both.select("conv_id", "turn", "initial", "blank", "ended", "part", "index", "block", "marks").mapInArrow(_summaries, _BLOCK), "blocks")


def _goals(batches) -> Iterator[pa.RecordBatch]:
    """The costs at each block's end, from the matrices of a conversation in order."""

    def one(held: list[tuple]) -> Iterator[tuple]:
        goal, last = list(AT_END), True
        for part, block, costs in reversed(held):
            yield part, block, goal, int(last)
            goal, last = [min(costs[STATES * q + to] + goal[to] for to in range(STATES)) for q in range(STATES)], False

    def rows() -> Iterator[tuple]:
        held, before = [], None
        for batch in batches:
            for conv, part, block, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != before:
                    yield from one(held)
                    held = []
                held.append((part, block, costs))
                before = conv
        yield from one(held)

    return _batches(rows(), "part int, block bigint, goal array<int>, final int")


def _walks(batches) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for *kept, codes, goal, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dist = distances(codes, goal)
                ways = [walk(codes, dist, q, bool(final)) for q in range(STATES)]
                yield *kept, dist[START], [to for _, to in ways], [audit for audit, _ in ways]

    return _batches(rows(), _WALK, 256)


def walks(table: DataFrame) -> DataFrame:
    """The blocks with the audit from each state and the state that it ends in; ``cost``: from the start of the grammar to the end."""
    every = blocks(table)
    solved = every.select("conv_id", "part", "block", "costs").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_goals, "part int, block bigint, goal array<int>, final int")
    kept = [x.split()[0] for x in _WALK.split(", ")][:-3]
    return every.join(solved, ["part", "block"]).select(*kept, "codes", "goal", "final").mapInArrow(_walks, _WALK)


class _Reader:
    """A conversation as its blocks and turns stream by."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.state, self.letters, self.audits = conv, START, iter(()), []
        self.sums, self.cost, self.last, self.low, self.high = [0, 0, 0, 0, 0], None, None, None, None

    def block(self, blank: int, duplicate: int, truncated: int, illegal: int, first: str, last: str, low: int | None, high: int | None, turns: int, cost: int, exits: list[int], audits: list[str]) -> None:
        illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
        if low is not None:  # blocks ascend by turn
            turns -= self.high == low
            self.low, self.high = low if self.low is None else self.low, high
        self.sums = [a + b for a, b in zip(self.sums, (blank, duplicate, truncated, illegal, turns), strict=True)]
        self.last = last
        if self.cost is None:
            self.cost, self.entry = cost, START
        self.audits.append(audits[self.entry])
        self.letters, self.entry = iter(audits[self.entry]), exits[self.entry]

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str | None, str]]:
        """(edit, role, text) of the insertions before a turn, and of the turn; the role is None where it goes."""
        for letter in self.letters:
            if letter == "I":
                yield self._insert()
                continue
            if letter == "D":
                yield "D", None, text
            elif letter == "R":
                yield "R", ROLES[self.state], text
                self.state = NEXT[self.state]
            else:
                yield "K", role, text
                self.state = SYSTEM if self.state == START and role.startswith("s") else NEXT[self.state]
            return

    def _insert(self) -> tuple[str, str, str]:
        role, self.state = ROLES[self.state], NEXT[self.state]
        return "I", role, ""

    def rest(self) -> Iterator[tuple[str, str | None, str]]:
        for _ in self.letters:
            yield self._insert()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.sums[4]


def _events(batches) -> Iterator[tuple[_Reader, tuple | None]]:
    """(conversation, an edited turn; None at its end) from sorted rows: a conversation's own row, then each block's and its turns'."""
    reader = None
    for batch in batches:
        for conv, index, role, text, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if reader is None or conv != reader.conv:
                if reader is not None:
                    yield from ((reader, x) for x in reader.rest())
                    yield reader, None
                reader = _Reader(conv)
            if role is not None:
                yield from ((reader, x) for x in reader.turn(role, text))
            elif index is not None:
                reader.block(*block)
    if reader is not None:
        yield from ((reader, x) for x in reader.rest())
        yield reader, None


def _streamed(turns: DataFrame, every: DataFrame, run, schema: str, block_rows: int) -> DataFrame:
    """``run`` over each conversation's blocks and turns in order; ``every``: all conv_ids that get a result."""
    table = placed(turns, block_rows)
    own = walks(table).withColumn("index", F.lit(-1).cast("bigint"))
    ids = every.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    rows = table.select("conv_id", "part", "block", "index", "role", "text")
    both = rows.unionByName(own, allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "index")
    kept = [x.split()[0] for x in _WALK.split(", ")][3:]
    return ordered.select("conv_id", "index", "role", "text", *kept).mapInArrow(run, schema)


def repaired(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the repaired conversations' turns."""

    def run(batches):
        def rows() -> Iterator[tuple]:
            place = 0
            for reader, event in _events(batches):
                if event is None:
                    place = 0
                elif event[1] is not None:
                    yield reader.conv, place, *event
                    place += 1

        return _batches(rows(), _TURN)

    return _streamed(turns, turns, run, _TURN, block_rows)


def digests(turns: DataFrame, every: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each conv_id of ``every`` (the turns' own): gaps, blank, duplicate, truncated, illegal, cost, audit, and the SHA-256 of the repaired ``role:text`` lines."""

    def run(batches):
        def rows() -> Iterator[tuple]:
            digest, some = hashlib.sha256(), False
            for reader, event in _events(batches):
                if event is None:
                    yield reader.conv, reader.gaps(), *reader.sums[:4], reader.cost or 0, "".join(reader.audits), digest.hexdigest()
                    digest, some = hashlib.sha256(), False
                elif event[1] is not None:
                    digest.update(("\n" * some + f"{event[1]}:{event[2]}").encode())
                    some = True

        return _batches(rows(), _DIGEST)

    return _streamed(turns, turns if every is None else every, run, _DIGEST, block_rows)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns damaged by crc32(``conv_id:turn``) modulo 20, as a test bed: 0 lost, 1 emptied, 2 without ends, 3 doubled, 4 given to the user."""

    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")

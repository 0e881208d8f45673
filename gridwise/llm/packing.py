"""Packing: documents into sequences of at most ``SIZE`` tokens by the Sum-of-Squares rule.

Each task packs the documents that it reads, one after another, with the ids at hand. A document longer than a sequence fills
whole sequences first; what remains goes to the fill level that leaves the least sum, over levels, of the squared number of
open sequences at that level. The level array has SIZE + 1 places.

What is open when a task's documents are through is carried on: the pieces in the open sequences of MERGED tasks, and nothing
else, are shuffled to one group, where each is placed anew by the same rule, and so on in rounds until one group is left. (Placed as
whole sequences they would find no fitting level.) Only what is still open there is cut: pieces are joined so that all sequences but the last get full, and the last is cut into runs whose lengths
are powers of two, which need no padding. ``by_rule`` tells where the rule alone filled a sequence.

Defined results: a null text is empty (one piece, the end id); null and repeated doc_ids are packed as they come; a doc_id that
isn't an integer is an error; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens
from .content_store import with_end
from .workers import lean

SIZE = 4096
END_ID = 2
#: Tasks whose open sequences go to one.
MERGED = 8
SCHEMA = "sequence_id bigint, offset bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, by_rule boolean"
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "by_rule")


class Packer:
    """Open sequences by fill level. A piece is (document, start, ids); ``out`` gets (pieces, whether by the rule)."""

    def __init__(self, size: int = SIZE) -> None:
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.out: list[tuple[list, bool]] = []

    def level(self, n: int) -> int:
        """The level (0: a new sequence) at which a piece of n tokens leaves the least sum of squares."""
        count, top = self.count, self.size - n
        # From level h to h + n the sum changes by 2 * (count[h + n] - count[h] + 1); full sequences don't count.
        change = count[n : self.size] - count[:top]
        change[0] = count[n]  # a new one: 2 * count[n] + 1, compared in halves
        doubled = 2 * change + 2
        doubled[0] -= 1
        doubled[1:][count[1:top] == 0] = np.iinfo(np.int64).max
        at = int(doubled.argmin())
        if count[top] and 1 - 2 * count[top] <= doubled[at]:
            return top
        return at

    def place(self, piece: tuple) -> None:
        """Put a piece of fewer ids than a sequence holds where the rule says."""
        n = len(piece[2])
        at = self.level(n)
        own = self.open[at].pop() if at else []
        self.count[at] -= bool(at)
        own.append(piece)
        if at + n == self.size:
            self.out.append((own, True))
        else:
            self.open[at + n].append(own)
            self.count[at + n] += 1

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for a in range(0, whole, self.size):
            self.out.append(([(doc, a, ids[a : a + self.size])], True))
        if whole < len(ids):
            self.place((doc, whole, ids[whole:].copy()))

    def close(self) -> None:
        """Join what is open; pieces are cut where a sequence gets full."""
        rest = [p for level in reversed(self.open) for pieces in level for p in pieces]
        left = sum(len(p[2]) for p in rest)
        pieces: list = []
        room = self.size
        if left < room:
            room = 1 << max(left.bit_length() - 1, 0)
        for doc, at, ids in rest:
            while len(ids):
                took = ids[:room]
                pieces.append((doc, at, took))
                ids, at, room, left = ids[len(took) :], at + len(took), room - len(took), left - len(took)
                if not room:
                    self.out.append((pieces, False))
                    pieces, room = [], self.size
                    if left < room:
                        room = 1 << max(left.bit_length() - 1, 0)
        self.open, self.count = [[] for _ in range(self.size + 1)], np.zeros(self.size + 1, np.int64)

    def carry(self) -> None:
        """Hand out what is open as it is; its rows have their ids."""
        self.out += [(pieces, None) for level in self.open for pieces in level]

    def rows(self, part: int, number: int) -> pa.RecordBatch:
        """The sequences of ``out``; they are numbered from ``number`` in the part."""
        cols: list[list] = [[] for _ in range(9)]
        for k, (pieces, by_rule) in enumerate(self.out):
            offset = 0
            for (doc_id, tokens_), start, ids in pieces:
                data = ids.astype("<u4").tobytes()
                for c, v in zip(cols, ((part << 32) + number + k, offset, doc_id, start, len(ids), zlib.crc32(data), tokens_, by_rule, data if by_rule is None else None), strict=True):
                    c.append(v)
                offset += len(ids)
        self.out = []
        kinds = [*[pa.int64()] * 7, pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*(x.split()[0] for x in SCHEMA.split(", ")), "ids"])


def _merge(round_: int, last: bool, size: int):
    """Place the pieces of open sequences anew, those of each ``group`` by themselves; the last round cuts what stays open.

    A task may hold several groups, one after another; each is a part of its own.
    """

    def run(batches):
        group, number, packer = None, 0, Packer(size)

        def done():
            if last:
                packer.close()
            else:
                packer.carry()
            return packer.rows((round_ << 24) + group, number)

        for batch in batches:
            for x in batch.to_pylist():
                if x["group"] != group:
                    if group is not None:
                        yield done()
                    group, number, packer = x["group"], 0, Packer(size)
                packer.place(((x["doc_id"], x["doc_tokens"]), x["start"], np.frombuffer(x["ids"], "<u4")))
            full = len(packer.out)
            yield packer.rows((round_ << 24) + group, number)
            number += full
        if group is not None:
            yield done()

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END_ID, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """A row per piece; ``sequence_id`` is unique, and within it ``offset`` runs without gaps from 0."""

    def run(batches):
        from pyspark import TaskContext

        part, number, packer = TaskContext.get().partitionId(), 0, Packer(size)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, ids, offsets in tokens.encode_all(tokenizer, batch.column(1)):
                ids, offsets = with_end(ids, offsets, end)
                for name, x, y in zip(names[a:b], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    packer.add((name, y - x), ids[x:y])
                full = len(packer.out)
                yield packer.rows(part, number)
                number += full
        packer.carry()
        yield packer.rows(part, number)

    held = f"{SCHEMA}, ids binary"
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).cast("string").alias("text"))
    now, out, round_ = scratch.table(chosen.mapInArrow(lean(run, encoding=True), held), "packed"), [], 0
    # Who meets whom is told by the parts' own numbers, not by tasks: Spark may deal a round over any number of these.
    part = F.shiftright("sequence_id", 32).bitwiseAND((1 << 24) - 1)
    while True:
        out.append(now.filter("by_rule is not null").select(*COLUMNS))
        left = now.filter("by_rule is null")
        top = left.agg(F.max(part)).first()[0]
        if top is None:
            break
        n, round_ = top // MERGED + 1, round_ + 1
        dealt = left.withColumn("group", F.floor(part / MERGED)).repartition(n, "group").sortWithinPartitions("group", "sequence_id", "offset")
        now = scratch.table(dealt.mapInArrow(lean(_merge(round_, n == 1, size)), held), "packed")
    return reduce(DataFrame.unionByName, out)

"""LM scoring by a probabilistic suffix tree over words.

A state of the tree is a context: the last 1 to DEPTH words. A context is a candidate if it occurs ``MIN_CONTEXT`` times in
the training texts; it is retained if the divergence of its next-word distribution from that of its suffix (the context
without its first word) is ``MIN_DIVERGENCE`` nats or more. A next word is listed at a context from ``MIN_NEXT`` occurrences;
all others share what is left in proportion to the suffix's distribution, down to add-one unigrams:

    P(x | s) = (c(s, x) listed + (c(s) - listed(s) + MU) * P(x | suffix)) / (c(s) + MU)

The longest retained context at each token scores it; its shorter retained suffixes smooth it.

How it runs: texts are coded in blocks of about ``BLOCK_BYTES``, kept as a table bucketed by block, so later passes read
them without a shuffle. A pass counts the n-grams of one length: every block sends each distinct n-gram once, with its
count, to a part; the part adds up and answers every block. A block sends an n-gram only if both its (n-1)-grams are frequent
enough, which the pass before told it. Words are known by 64-bit hashes, whose leading bits are their part. With its count a
frequent one gets its rank among its part's, and from then on goes by part and rank: the blocks are written again without
hashes. A longer n-gram is known by the part and rank of what precedes its last word and by those of that word; the sum of
both parts is its own, so one of them needn't be sent. Counts that no later step asks for are answered as 0. One more
pass adds up divergences by context, known by part and rank, and answers what is listed at the retained ones; what an n-gram
adds is sent by the first block that holds it alone. Answers are shuffled once, into tables bucketed like the blocks. No
vocabulary or model is broadcast or collected: a task holds a block and the answers about its own n-grams, or a part.

Defined results: a null text is empty (the end alone); a null doc_id is trained on; repeated rows count and are scored
each; with an empty training set c and N are 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, scratch, text
from .workers import give_back

DEPTH = 3
MIN_CONTEXT, MIN_NEXT, MIN_DIVERGENCE, MU = 32, 4, 0.05, 1.0
HELD_OUT, FOLDS = 2, 7
BLOCK_BYTES = 3 << 20
#: Row groups end at 16 MB, asked at every row: else a task that writes or reads blocks holds 100 of them before it looks at their size.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}

END = np.uint64(0x5EED0FE2D0C5AB1E)
BLOCK = "block bigint, ids array<bigint>, held binary, first binary, codes binary, words binary"
SENT = "part int, block bigint, keys binary, counts binary, sums binary"
ANSWER = "block bigint, part int, counts binary, ranks binary, first binary, totals binary"
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
#: Of the answer with the totals over all words.
ALL = -1
#: The pass over contexts, after those over n-grams, which go by length.
CONTEXTS = DEPTH + 2


def least_counts(n: int) -> tuple[int, int]:
    """(of a context, of a next word at a context) for n training tokens: the same for any n."""
    return MIN_CONTEXT, MIN_NEXT


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all first bytes first: small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def key_planes(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, all leading bytes first: these hardly differ within a part, so they compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes_of_keys(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def stepped(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps, in as many bytes each as the largest needs: that number, then all last bytes first."""
    steps = np.diff(keys, prepend=np.uint64(0))
    size = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([size]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unstepped(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : b[0]] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def ranked(ranks: np.ndarray) -> bytes:
    """Ascending numbers, as steps."""
    return planes(np.diff(ranks, prepend=ranks.dtype.type(0)))


def unranked(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)


def _encode(batches):
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids, hashes, size, held = [], [], 0, []

    def block():
        words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.array([len(x) for x in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([[y for x in ids for y in x]], pa.list_(pa.int64())), pa.array([np.concatenate([x[1] for x in held]).tobytes()]), pa.array([np.concatenate(([0], np.cumsum(np.concatenate([x[0] for x in held])))).astype(np.int64).tobytes()]), pa.array([planes(codes)]), pa.array([key_planes(words)])], ["block", "ids", "held", "first", "codes", "words"]) if len(n) else None

    for batch in batches:
        for a, b, buf, offsets in text.slices(batch.column(1)):
            starts, ends, first = text.words(buf, offsets)
            h = text.hashes(buf, starts, ends, True)
            n = np.diff(first) + 1
            every = np.full(int(n.sum()), END, np.uint64)
            spot = np.ones(len(every), bool)
            spot[np.cumsum(n) - 1] = False
            every[spot] = h
            names = batch.column(0).slice(a, b - a).to_pylist()
            ids.append(names)
            hashes.append(every)
            held.append((n, np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in names], bool)))
            size += len(buf)
            if size >= BLOCK_BYTES:
                yield block()
                number += 1
                ids, hashes, size, held = [], [], 0, []
    if ids:
        yield block()


def _least_of_ranked(level: int) -> int:
    """How often words or n-grams occur that get a rank: as a next word, or as a context."""
    return least_counts(0)[1 if level == 1 else 0]


def _joined(before: np.ndarray, word: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Keys of n-grams from the numbers (part, rank there) of what precedes the last word and of that word. The leading bits are the
    part, the sum of both; what follows tells rank and part of the former and the rank of the word, so the word's part too."""
    rank, low = np.uint64(0xFFFFFFFF), np.uint64(32)
    if len(before) and int((before & rank).max()).bit_length() + bits + width > 64 - bits:
        raise OverflowError("too many contexts in a part: raise spark.sql.shuffle.partitions")
    part = ((before >> low) + (word >> low)) & np.uint64((1 << bits) - 1)
    rest = ((before & rank) << np.uint64(bits) | before >> low) << np.uint64(width) | word & rank
    return part << np.uint64(64 - bits) | rest


class Block:
    """A block's tokens, and what the passes so far have told about its n-grams (by position of their last word).

    ``bits`` tell a part; ``width`` is how many bits the ranks of words need."""

    def __init__(self, row: dict, n: int, bits: int = 8, width: int = 32) -> None:
        self.min_context, self.min_next = least_counts(n)
        self.bits, self.width = bits, width
        self.first = np.frombuffer(row["first"], np.int64)
        self.codes = unplanes(row["codes"]).view(np.int32)
        self.words = unplanes_of_keys(row["words"]) if "words" in row else None  # until they are counted
        self.held = np.frombuffer(row["held"], bool)
        size = np.diff(self.first)
        self.place = np.arange(len(self.codes)) - np.repeat(self.first[:-1], size)
        self.train = np.repeat(~self.held, size)
        self.ends = np.zeros(len(self.codes), bool)
        self.ends[self.first[1:] - 1] = True
        self.told = defaultdict(lambda: np.zeros(0, np.uint32))  # where a block had nothing to ask
        self.numbers, self.firsts = defaultdict(lambda: np.zeros(0, np.uint64)), defaultdict(lambda: np.zeros(0, bool))
        for name, parts in row.items():
            if name.startswith("told") and parts:
                parts.sort(key=lambda x: x["part"])
                counts, level = [unplanes(x["counts"]) for x in parts], int(name[4:])
                self.told[level] = np.concatenate(counts)
                if level < CONTEXTS:
                    self.numbers[level] = np.concatenate([unranked(x["ranks"]) + np.uint64(x["part"] << 32) for x in parts])
                    self.firsts[level] = np.concatenate([np.unpackbits(np.frombuffer(x["first"], np.uint8), count=np.count_nonzero(c >= self.min_next)).view(bool) for x, c in zip(parts, counts, strict=True)])
                parts.clear()
        self.totals, self.ids, self.own = {}, {}, {}

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(positions, distinct keys, number of each position's key) of the n-grams of length k that are asked about."""
        if k == 1:
            return np.arange(len(self.codes)), self.words, self.codes
        alive = self.place >= k - 1
        alive[1:] &= (self.totals[k - 1][:-1] >= self.min_context) & (self.totals[k - 1][1:] >= self.min_next)
        at = np.flatnonzero(alive)
        keys = _joined(self.ids[k - 1][at - 1], self.ids[1][at], self.bits, self.width)
        return at, *np.unique(keys, return_inverse=True)

    def learn(self, upto: int) -> None:
        """Put in place the totals of all lengths up to ``upto`` and the numbers of what is frequent; with all of them, also a
        place of each n-gram that this block is the first to hold."""
        for k in range(1, upto + 1):
            at, _, code = self.grams(k)
            told = self.told.pop(k) if len(at) else np.zeros(0, np.uint32)
            self.totals[k] = np.zeros(len(self.codes), np.uint32)
            self.totals[k][at] = told[code]
            if k <= DEPTH:
                number = np.zeros(len(told), np.uint64)
                number[told >= _least_of_ranked(k)] = self.numbers.pop(k) if len(at) else 0
                self.ids[k] = np.zeros(len(self.codes), np.uint64)
                self.ids[k][at] = number[code]
            if upto > DEPTH:
                place = np.zeros(len(told), np.int64)
                place[code[::-1]] = at[::-1]
                self.own[k] = place[told >= self.min_next][self.firsts.pop(k)] if len(at) else place

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of the word after it, distinct numbers, which of these) of candidate contexts of length k."""
        alive = self.place >= k
        alive[1:] &= self.totals[k][:-1] >= self.min_context
        at = np.flatnonzero(alive)
        distinct, code = np.unique(self.ids[k][at - 1], return_inverse=True)
        return at, distinct, code

    def divergences(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, listed occurrences, summed log ratios less what all occurrences ask) of contexts of length k, of the
        n-grams that this block is the first to hold. Over all blocks a sum of 0 or more retains the context."""
        at, distinct, code = self.contexts(k)
        which = np.zeros(len(self.codes), np.int64)
        which[at] = code
        i = self.own[k + 1]
        i = i[self.totals[k + 1][i] >= self.min_next]
        times = self.totals[k + 1][i]
        shorter = self.totals[k - 1][i - 1] if k > 1 else n
        ratio = times * (np.log(times / self.totals[k][i - 1]) - np.log(self.totals[k][i] / shorter))
        j = self.own[k]
        j = j[(self.totals[k][j] >= self.min_context) & ~self.ends[j]]  # nothing follows an end
        asked = MIN_DIVERGENCE * np.bincount(which[j + 1], self.totals[k][j], minlength=len(distinct))
        return distinct, np.bincount(which[i], times, minlength=len(distinct)), np.bincount(which[i], ratio, minlength=len(distinct)) - asked

    def probabilities(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Base and model probability of each token."""
        base = (self.totals[1] + 1.0) / (n + v + 1)
        p = base.copy()
        rest = self.told[CONTEXTS]
        for k in range(1, DEPTH + 1):
            at, distinct, code = self.contexts(k)
            listed, rest = rest[: len(distinct)][code], rest[len(distinct) :]
            count = self.totals[k][at - 1]
            retained = listed > 0
            at, listed, count = at[retained], listed[retained], count[retained]
            own = self.totals[k + 1][at]
            own = np.where(own >= self.min_next, own, 0)
            p[at] = (own + ((count - listed) + MU) * p[at]) / (count + MU)
        return base, p


def _rows(batch: pa.RecordBatch):
    """The rows one by one: a row is a block. Large bytes are read where the batch holds them, and memory of the block before
    is given back first, which else stays with the worker in pieces."""
    for i in range(batch.num_rows):
        give_back()
        yield {k: c[i].as_buffer() if c.type == pa.binary() else c[i].as_py() for k, c in zip(batch.schema.names, batch.columns, strict=True)}


def _each(of_row):
    """Apply ``of_row`` to every row; what it holds of a block goes before the next one is read."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                yield from of_row(row)

    return run


def _send(bits: int, number: int, keys: np.ndarray, counts: np.ndarray, sums: np.ndarray | None, k: int = 0, level: int = 1) -> pa.RecordBatch:
    """Rows of SENT; ``keys`` of n-grams of length ``level`` are sorted. Of contexts of length ``k`` (with ``sums``) they are the numbers (part, rank there) that
    their counts came with; parts of contexts come after those of shorter ones."""
    parts = (keys >> np.uint64(32 if k else 64 - bits)).astype(np.int32) + np.int32(k << bits)
    if k:
        coded = lambda x: ranked(x & np.uint64(0xFFFFFFFF))
    else:
        coded = key_planes if level == 1 else lambda x: stepped(x & np.uint64((1 << (64 - bits)) - 1))
    at = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(keys) else np.zeros(0, np.int64)
    cut = list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=False))
    return pa.RecordBatch.from_arrays([pa.array(parts[at], pa.int32()), pa.array(np.full(len(at), number)), pa.array([coded(keys[a:b]) for a, b in cut], pa.binary()), pa.array([planes(counts[a:b]) for a, b in cut], pa.binary()), pa.array([b"" if sums is None else sums[a:b].tobytes() for a, b in cut], pa.binary())], ["part", "block", "keys", "counts", "sums"])


def _ask(bits: int, level: int, n: int = 0, width: int = 32):
    """Sends of all blocks for n-grams of length ``level``, or for contexts of all lengths."""

    def sends(row: dict):
        block = Block(row, n, bits, width)
        if level < CONTEXTS:
            block.learn(level - 1)
            at, keys, code = block.grams(level)
            yield _send(bits, row["block"], keys, np.bincount(code[block.train[at]], minlength=len(keys)), None, level=level)
        else:
            block.learn(DEPTH + 1)
            for k in range(1, DEPTH + 1):
                yield _send(bits, row["block"], *block.divergences(k, n), k)

    return _each(sends)


def _add_up(level: int):
    read = unplanes_of_keys if level == 1 else unstepped if level < CONTEXTS else unranked
    min_next = least_counts(0)[1]

    def part(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda x: x["block"])
        each = [read(x["keys"]) for x in rows]
        keys = np.concatenate(each)
        counts = np.concatenate([unplanes(x["counts"]) for x in rows]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        starts, group = np.flatnonzero(new), np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.add.reduceat(counts[order], starts)
        sums = np.concatenate([np.frombuffer(x["sums"], np.float64) for x in rows])
        if len(sums):
            total[np.add.reduceat(sums[order], starts) < 0] = 0
        elif level > 1:
            total[total < min_next] = 0  # nothing asks for these counts
        first = np.zeros(len(keys), bool)
        first[order[starts]] = True  # of equal keys that of the least block
        often = total >= _least_of_ranked(level)
        rank = np.cumsum(often) - 1
        out, b = [[], [], [], [], [], []], 0
        for x, mine in zip(rows, each, strict=True):
            a, b = b, b + len(mine)
            own = group[a:b]
            ranks = ranked(rank[own][often[own]]) if level <= DEPTH else b""
            for c, y in zip(out, (x["block"], x["part"], planes(total[own]), ranks, np.packbits(first[a:b][total[own] >= min_next]).tobytes() if level < CONTEXTS else b"", b""), strict=True):
                c.append(y)
        if level == 1:
            for c, y in zip(out, (ALL, rows[0]["part"], b"", b"", b"", np.array([total.sum(), (total > 0).sum(), often.sum()], float).tobytes()), strict=True):
                c.append(y)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.binary()) for x in out[2:])], ["block", "part", "counts", "ranks", "first", "totals"])

    def run(batches):
        for rows in minhash.groups(batches, 1):
            yield part([x for batch in rows for x in batch.to_pylist()])

    return run


def _score(n: int, v: int, bits: int, width: int):
    def scores(row: dict):
        block = Block(row, n, bits, width)
        block.learn(DEPTH + 1)
        at = block.first[:-1]
        base, p = (np.add.reduceat(np.log10(x), at) for x in block.probabilities(n, v))
        known = np.add.reduceat((block.totals[1] > 0).astype(np.int64), at)
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(block.held), pa.array(np.diff(block.first)), pa.array(known), pa.array(np.full(len(at), n)), pa.array(base), pa.array(p)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _each(scores)


def score(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """Learn from the documents outside the held-out fold, and score all: a row per document."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).cast("string").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, kind: str) -> DataFrame:
        """Written by block, so that a join by block shuffles nothing."""
        name, path = f"{scratch.prefix(spark)}{kind}_{uuid.uuid4().hex[:12]}", scratch.folder(spark, kind)
        with scratch.tidy(spark):
            df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).option("compression", "zstd").options(**ROW_GROUPS).saveAsTable(name)
        out = spark.table(name)
        out._name, out._scratch = name, path
        return out

    def drop(*tables: DataFrame) -> None:
        for x in tables:
            spark.sql(f"drop table {x._name}")
        scratch.drop(*tables)

    coded = bucketed(chosen.mapInArrow(_encode, BLOCK), "coded")
    bits = minhash.part_bits(spark)

    def told(blocks: DataFrame, answers: dict[int, DataFrame]) -> DataFrame:
        """The blocks, each with all answers so far."""
        for level, x in answers.items():
            blocks = blocks.join(x.select("block", F.col("told").alias(f"told{level}")).hint("merge"), "block", "left")
        return blocks

    def ask(every: DataFrame, level: int, n: int = 0, width: int = 32) -> DataFrame:
        added = every.mapInArrow(_ask(bits, level, n, width), SENT).repartition("part").sortWithinPartitions("part").mapInArrow(_add_up(level), ANSWER)
        lists = added.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "ranks", "first", "totals")).alias("told"))
        return bucketed(lists, f"level{level}")

    words = ask(coded, 1)
    sizes = [np.frombuffer(x["totals"]) for r in words.filter(F.col("block") == ALL).collect() for x in r["told"]]  # one for each part
    n, v = (int(sum(x[k] for x in sizes)) for k in (0, 1))
    width = int(max((x[2] for x in sizes), default=0)).bit_length()
    blocks = bucketed(told(coded.drop("words"), {1: words}), "blocks")
    drop(coded, words)
    answers: dict[int, DataFrame] = {}
    for k in range(2, CONTEXTS + 1):
        answers[k] = ask(told(blocks, answers), k, n, width)
    return told(blocks, answers).mapInArrow(_score(n, v, bits, width), SCHEMA)

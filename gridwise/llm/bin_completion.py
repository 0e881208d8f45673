"""Best-fit packing by bin completion: documents into as few sequences of at most ``SIZE`` tokens as the search finds.

Documents of one length are alike to a packer, so the problem is a histogram with at most ``SIZE`` lengths, whatever the number
of documents. Spark encodes the texts, cuts what is longer than a sequence, and counts the lengths; :func:`solve` packs the
histogram; Spark then gives each piece the place that the packing has for its number among the pieces of its length. Pieces
are numbered where they were written (task by task, then the tasks' counts are added up), so a very common length is no hot key.

:func:`solve` is a branch and bound over fillings. A node takes the largest length left, and its branches are the undominated
fillings around it, those of least waste first, each applied as often as the counts allow, and once. A branch is pruned when the
waste so far exceeds what a better packing may waste, or when its bins and the lower bound of what is left reach the incumbent.
Incumbents are best-fit-decreasing solutions of what is left at a node; the search ends when one meets the lower bound.
Without limits it is exact (the tests let it run); production looks at ``TRIED`` fillings a node and gives up after ``NODES`` nodes with the best incumbent, which is never worse
than best-fit decreasing. The limits bound the search's time and memory and drop nothing.

Defined results: a null text is empty (one piece, the end id); null and repeated doc_ids are packed as they come; a doc_id that
isn't an integer is an error; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from . import scratch, tokens
from .content_store import with_end

SIZE = 4096
END_ID = 1
#: Nodes of the search.
NODES = 10_000
#: Where many lengths are left, so many levels go by between two bounds and incumbents; the bound by waste is taken at each.
EVERY = 64
#: Fillings of one node that are tried.
BRANCHES = 4
#: Multisets of one node that are looked at.
TRIED = 64

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, part int, number bigint, ids binary"
#: Bits of a sequence's number within a length's key.
_RANK_BITS = 48

Filling = tuple[int, ...]  # lengths, descending
Packing = list[tuple[Filling, int]]  # fillings and how often each is used


def bins(packing: Packing) -> int:
    return sum(n for _, n in packing)


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Martello and Toth's L2: for each threshold, what is too large to share a bin, and what must go beside the rest."""
    if not counts:
        return 0
    n, total = np.zeros(size + 1, np.int64), 0
    for length, c in counts.items():
        n[length] = c
        total += length * c
    upto, mass = np.cumsum(n), np.cumsum(n * np.arange(size + 1))
    half = size // 2
    best = -(-total // size)
    for k in (0, *(x for x in sorted(counts) if x <= half)):
        large = int(upto[size] - upto[size - k])  # of more than size - k
        middle = int(upto[size - k] - upto[half])  # of more than half
        room = middle * size - int(mass[size - k] - mass[half])
        small = int(mass[half] - mass[k - 1]) if k else int(mass[half])
        best = max(best, large + middle + max(0, -(-(small - room) // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> Packing:
    """Best-fit decreasing; bins that are filled alike are one group."""
    groups: dict[int, list[tuple[Filling, int]]] = {}
    gaps: list[int] = []  # ascending, of groups
    out: Packing = []

    def put(filling: Filling, n: int, gap: int) -> None:
        if gap == 0:
            out.append((filling, n))
        else:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                break
            gap = gaps[at]
            filling, n = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[at]
            each = gap // length  # the fullest bin takes the next one, too
            used = min(n, left // each)
            if used < n:
                put(filling, n - used - (left < each), gap) if n - used - (left < each) else None
                if left < each:
                    put(filling + (length,) * left, 1, gap - left * length)
                    left = 0
            if used:
                put(filling + (length,) * each, used, gap - each * length)
                left -= used * each
        each = size // length
        if left // each:
            put((length,) * each, left // each, size - each * length)
        if left % each:
            put((length,) * (left % each), 1, size - left % each * length)
    out += [x for level in groups.values() for x in level]
    return out


def fillings(counts: dict[int, int], room: int, tried: int | None = None) -> Iterator[Filling]:
    """Undominated multisets of at most ``room`` in all, those of least waste first; with ``tried`` only those among as many multisets.

    Sums that the lengths from some place on can reach are bit sets, so no path of the enumeration is in vain. A filling is
    dominated if lengths in it can be swapped for one, not in it, that is at least as long as they are together and still fits.
    """
    if counts.get(room):
        yield (room,)  # all others go into it
        return
    lengths = sorted((x for x in counts if x <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for x in reversed(lengths):
        sums, copies, step = reach[-1], min(counts[x], room // x), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << (step * x)) & mask
            copies, step = copies - step, step * 2
        reach.append(sums)
    reach.reverse()  # reach[i]: sums of lengths[i:]

    def exact(i: int, left: int) -> Iterator[Filling]:
        stack = [(i, left, ())]
        while stack:
            i, left, chosen = stack.pop()
            if not left:
                yield chosen
                continue
            while i < len(lengths) and lengths[i] > left:
                i += 1
            if i == len(lengths) or not reach[i] >> left & 1:
                continue
            x = lengths[i]
            for k in range(min(counts[x], left // x) + 1):  # the last pushed, most copies, goes first
                if reach[i + 1] >> (left - k * x) & 1:
                    stack.append((i + 1, left - k * x, chosen + (x,) * k))

    ascending = lengths[::-1]
    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for filling in exact(0, total):
                if tried is not None:
                    if not tried:
                        return
                    tried -= 1
                if not _dominated(filling, counts, ascending, room - total):
                    yield filling


def _dominated(filling: Filling, counts: dict[int, int], ascending: list[int], slack: int) -> bool:
    own: dict[int, int] = {}
    for x in filling:
        own[x] = own.get(x, 0) + 1
    sums = {0: 0}  # of some of the filling: how many lengths at most
    for x, c in own.items():
        for s, n in list(sums.items()):
            for k in range(1, c + 1):
                sums[s + k * x] = max(sums.get(s + k * x, 0), n + k)
    for s, n in sums.items():
        at = bisect_left(ascending, s) if n > 1 else bisect_right(ascending, s)
        while at < len(ascending) and ascending[at] <= s + slack:
            if counts[ascending[at]] > own.get(ascending[at], 0):
                return True
            at += 1
    return False


def solve(counts: dict[int, int], size: int = SIZE, nodes: int | None = NODES, branches: int | None = BRANCHES, tried: int | None = TRIED) -> Packing:
    """Fillings, and how often each is used, that hold exactly ``counts`` (length: number)."""
    if any(x < 1 or x > size for x in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    counts = {x: c for x, c in counts.items() if c}
    total, least = sum(x * c for x, c in counts.items()), lower_bound(counts, size)
    best = best_fit(counts, size)
    most = bins(best)
    if most == least:
        return best

    def opened() -> Iterator[tuple[Filling, int]]:
        """The branches of what is left now; only they are held while the search is below, not what they were found with."""
        top = max(left)
        rest = {x: c - (x == top) for x, c in left.items() if c - (x == top)}
        found = []
        for filling in islice(fillings(rest, size - top, tried), branches):
            whole = (top, *filling)
            n = min(left[x] // whole.count(x) for x in set(whole))
            found += [(whole, n), (whole, 1)][: 1 + (n > 1)]
        return iter(found)

    chosen: Packing = []
    left = dict(counts)
    used = waste = seen = 0
    stack = [opened()]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen and stack:
                filling, n = chosen.pop()
                for x in filling:
                    left[x] = left.get(x, 0) + n
                used, waste = used - n, waste - n * (size - sum(filling))
            continue
        filling, n = step
        more = n * (size - sum(filling))
        if waste + more > (most - 1) * size - total:
            continue
        for x in filling:
            left[x] -= n
            if not left[x]:
                del left[x]
        chosen.append((filling, n))
        used, waste, seen = used + n, waste + more, seen + 1
        open_ = True
        if len(left) < EVERY or len(stack) % EVERY == 1:
            open_ = used + lower_bound(left, size) < most
            found = best_fit(left, size) if open_ else []
            if open_ and used + bins(found) < most:
                best, most = [*chosen, *found], used + bins(found)
                open_ = used + lower_bound(left, size) < most
        if most == least or (nodes is not None and seen >= nodes):
            return best
        stack.append(opened() if left and open_ else iter(()))
    return best


def slots(packing: Packing) -> list[np.ndarray]:
    """length, first number of that length, sequence, uses in a sequence, offset there: where the pieces of each length go.

    A row covers as many numbers as its filling's sequences have places for the length. Sorted by length and number; at most one
    row for each length of each filling, which depends on the histogram's size and not on the documents.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, n in packing:
        offset = 0
        for x in sorted(set(filling), reverse=True):
            uses = filling.count(x)
            rows.append((x, taken.get(x, 0), sequence, uses, offset))
            taken[x] = taken.get(x, 0) + uses * n
            offset += uses * x
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return [np.ascontiguousarray(c) for c in table.T]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END_ID, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """A written table of the documents' pieces with their ids (unsigned 32-bit, little-endian), and each one's number among those of its length in its part."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            names = batch.column(0)
            for a, b, ids, offsets in tokens.encode_all(tokenizer, batch.column(1)):
                ids, offsets = with_end(ids, offsets, end)
                long = np.diff(offsets)
                n = -(-long // size)
                doc = np.repeat(np.arange(b - a), n)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = k * size
                length = np.minimum(long[doc] - start, size)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                fresh = np.ones(len(ordered), bool)
                fresh[1:] = ordered[1:] != ordered[:-1]
                first = np.flatnonzero(fresh)
                number = np.empty(len(order), np.int64)
                number[order] = seen[ordered] + np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                np.add.at(seen, length, 1)
                # Pieces follow one another, so the slice's ids are the pieces' ids.
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(0, np.cumsum(length * 4)).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a).take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(np.full(len(doc), part, np.int32)), pa.array(number), data], [x.split()[0] for x in _PIECES.split(", ")])

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).cast("string").alias("text"))
    return scratch.table(chosen.mapInArrow(run, _PIECES), "pieces")


def placed(cut: DataFrame, packing: Packing) -> DataFrame:
    """The pieces with sequence_id and offset; what ``cut`` has beside part and number is kept."""
    length, first, sequence, uses, offset = slots(packing)
    keys = (length << _RANK_BITS) | first
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "length", before.alias("before"))  # a row a part and length
    numbered = cut.join(starts, ["part", "length"]).withColumn("number", F.col("number") + F.col("before")).drop("part", "before")
    schema = StructType([*numbered.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at_length, at_number = numbered.columns.index("length"), numbered.columns.index("number")

    def run(batches):
        for batch in batches:
            own, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at_length, at_number))
            at = np.searchsorted(keys, (own << _RANK_BITS) | number, "right") - 1
            k = number - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence[at] + k // uses[at]), pa.array(offset[at] + k % uses[at] * own)], [f.name for f in schema])

    return numbered.mapInArrow(run, schema).drop("number")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END_ID, nodes: int | None = NODES, doc_id: str = "doc_id", body: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece; ``with_ids`` adds the piece's ids.

    Without ids only narrow rows are shuffled."""
    cut = pieces(docs, tokenizer, size, end, doc_id, body)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    kept = ["doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else [])]
    return placed(cut.select(*kept, "part", "number"), solve(histogram, size, nodes))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, documents (doc_id, piece, offset): the sequences of what :func:`pack` gives ``with_ids``; each holds at most ``size`` ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), inside.alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return whole.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("documents"))

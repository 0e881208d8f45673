"""MinHash signatures, their bands, and exact links inside what shares a band.

The stages that both near-duplicate operators share. Bands are chosen for a target recall. Band keys travel as packed
arrays, a row for each part of the key space and slice of texts, so a shuffle moves few rows; every key's nodes meet in
one part, which links each to the least (a star, never all pairs). Stars make coarse components. In these, all sets are
compared on their full n-grams: a component of more than ``MOST_ITEMS`` n-grams is cut into chunks, and each pair of
chunks is a group of its own, so no task holds more than two chunks and no row stands for a pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, text
from .components import components, least
from .workers import lean

#: Key space parts for each shuffle partition; a Spark partition takes whole parts.
PARTS = 4
#: n-grams of the texts in a chunk.
MOST_ITEMS = 512_000
PACKED = "part int, keys binary, nodes binary"

_rng = np.random.default_rng(20260102)
_FACTORS = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBES = _rng.integers(0, 1 << 31, (256, 1024))


def bands(threshold: float, recall: float, rows: int) -> tuple[int, int]:
    """(bands, rows) so that a pair at the threshold shares a band with probability ``recall`` or more."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def minima(keys: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """k minima for each set of keys (a row), each under a permutation of its own; sets without keys have zeros."""
    out = np.zeros((len(begin) - 1, k), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        at = begin[full]
        for i in range(k):
            out[full, i] = np.minimum.reduceat(keys * _FACTORS[i], at)
    return out


def minima_of_one(keys: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """As :func:`minima`, from one permutation cut into k bins; an empty bin borrows from bins probed in a fixed order."""
    n, none = len(begin) - 1, np.uint64(1 << 32)
    out = np.full(n * k, none, np.uint64)
    spot = text.owner(begin) * k + ((keys >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, spot, keys & np.uint64(0xFFFFFFFF))
    out = out.reshape(n, k)
    source = np.where(out == none, -1, np.arange(k))
    some = np.diff(begin) > 0
    row, col = np.nonzero((source < 0) & some[:, None])
    for probe in _PROBES[:, :k] % k:
        if not len(row):
            break
        to = probe[col]
        found = out[row, to] != none
        source[row[found], col[found]] = to[found]
        row, col = row[~found], col[~found]
    if len(row):
        source[row, col] = np.argmin(out, axis=1)[row]
    return np.take_along_axis(out, np.maximum(source, 0), 1) * some[:, None].astype(np.uint64)


def band_keys(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit key for each set and band."""
    out = np.empty((len(signature), count), np.uint64)
    for b in range(count):
        h = np.full(len(signature), b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            h = text.mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, j])
        out[:, b] = h
    return out


def part_bits(spark: SparkSession) -> int:
    """Leading bits of a key that tell its part: PARTS parts or more for each of the session's shuffle partitions."""
    return max(8, (PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def pack(keys: np.ndarray, nodes: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of PACKED for parallel keys and nodes."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    parts = (keys >> np.uint64(64 - bits)).astype(np.int32)
    at = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = [*at[1:].tolist(), len(keys)]
    blobs = [[x[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=False)] for x in (keys, nodes.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(parts[at], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "keys", "nodes"])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that are equal in the first columns (integers), as slices of batches; rows come sorted by these."""
    held, last = [], None
    for batch in batches:
        ids = [batch.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for x in ids:
            change[1:] |= x[1:] != x[:-1]
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if a == b:
                continue
            key = tuple(int(x[a]) for x in ids)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _stars(batches):
    """Edges from each key's nodes to the least of them, part by part."""
    for rows in groups(batches, 1):
        k = np.concatenate([np.frombuffer(x, np.uint64) for r in rows for x in r.column(1).to_pylist()])
        v = np.concatenate([np.frombuffer(x, np.int64) for r in rows for x in r.column(2).to_pylist()])
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        lead = v[np.flatnonzero(new)][np.cumsum(new) - 1]
        pairs = np.unique(np.column_stack([v, lead])[v != lead], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def candidates(packed: DataFrame) -> DataFrame:
    """node, label: the coarse component of each node that shares a band with another. A written table."""
    return components(packed.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_stars), "a bigint, b bigint"))


def _codes(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(the rank of each key, how many different ones there are)."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    code = np.empty(len(keys), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, int(new.sum())


#: Sets of a group whose pairs are all counted at once, and pairs that are laid out at once.
FEW, LAID_OUT = 16, 1 << 20
#: Pairs of sets of a larger group that are counted one by one.
PAIRED = 1 << 21


def _pairs(own: np.ndarray, first: np.ndarray, many: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(x * n + y, how many keys they share) of the pairs x < y of sets; key k is held by ``many[k]`` sets from ``own[first[k]]`` on, which ascend."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)]
    for m in np.unique(many).tolist():
        x, y = np.triu_indices(m, 1)
        rows = first[many == m]
        step = max(1, LAID_OUT // len(x))
        for k in range(0, len(rows), step):
            held = own[rows[k : k + step, None] + np.arange(m)]
            found.append((held[:, x] * n + held[:, y]).ravel())
    return np.unique(np.concatenate(found), return_counts=True)


def linked(sets: tuple[np.ndarray, np.ndarray], side: np.ndarray, across: bool, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(set, the sets that it is linked to). ``sets``: keys, distinct within each set, and where each set begins.

    Two sets are linked if their Jaccard similarity is ``threshold`` or more and, with ``across``, their sides differ. Sets that share
    too few keys with all others together are left out first, and sets are compared with those of a possible size only. What pairs
    share is counted pair by pair for keys that few sets have, and by a bit for each set for the others.
    """
    keys, begin = sets
    size, own = np.diff(begin), text.owner(begin)
    code, _ = _codes(keys)
    # By size; equal ones by place. From here on sets are known by their rank.
    by_size = np.argsort(size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[by_size] = np.arange(len(size))
    size, side, own = size[by_size], side[by_size], rank[own]
    while len(code):
        shared = np.bincount(code)[code] > 1
        count = np.bincount(own[shared], minlength=len(size))
        keep = shared & (count >= np.maximum(threshold * size - 1e-6, 1))[own]
        if keep.all():
            break
        code, own = code[keep], own[keep]
    if not len(code):
        return
    order = np.lexsort((own, code))
    code, own = code[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    many = np.diff(np.append(first, len(code)))
    full = np.unique(own)
    n = len(full)
    own, size, side = np.searchsorted(full, own), size[full], side[full]
    rarest = np.argsort(many, kind="stable")
    laid = np.cumsum(many[rarest] * (many[rarest] - 1) // 2)
    few = np.zeros(len(many), bool)
    few[rarest[(laid <= PAIRED) & (many[rarest] <= max(FEW, n // 16))]] = True
    pair, common = _pairs(own, first[few], many[few], n)
    both = np.concatenate((pair, pair % n * n + pair // n))
    order = np.argsort(both)
    (x, y), common = np.divmod(both[order], n), np.concatenate((common, common))[order]
    at = np.searchsorted(x, np.arange(n + 1))
    # The keys that many sets have.
    often = np.repeat(~few, many)
    code, own = np.repeat(np.cumsum(~few) - 1, many)[often], own[often]
    alike = int((~few).sum())
    dense = n * alike < 64 * max(len(code), n)
    if dense:
        bits = np.zeros((-(-alike // 64), n), np.uint64)
        np.bitwise_or.at(bits, (code >> 6, own), np.uint64(1) << (code & 63).astype(np.uint64))
    else:
        order = np.argsort(own, kind="stable")
        code, own = code[order], own[order]
        starts = np.searchsorted(own, np.arange(n + 1))
        mark = np.zeros(alike, bool)
    low, high = np.searchsorted(size, threshold * size - 1e-6), np.searchsorted(size, size / threshold + 1e-6, "right")
    place = by_size[full]
    for k in range(n):
        a, b = int(low[k]), int(high[k])
        if dense:
            got = np.bitwise_count(bits[:, a:b] & bits[:, k, None]).sum(axis=0, dtype=np.int64)
        else:
            mark[code[starts[k] : starts[k + 1]]] = True
            met = np.concatenate(([0], np.cumsum(mark[code[starts[a] : starts[b]]])))
            got = np.diff(met[starts[a : b + 1] - starts[a]])
            mark[code[starts[k] : starts[k + 1]]] = False
        near, c = y[at[k] : at[k + 1]], common[at[k] : at[k + 1]]
        i, j = np.searchsorted(near, (a, b))
        got[near[i:j] - a] += c[i:j]
        hit = got >= threshold * (size[k] + size[a:b] - got) - 1e-9
        hit[k - a] = False
        if across:
            hit &= side[a:b] != side[k]
        if hit.any():
            yield int(place[k]), np.sort(place[a:b][hit])


def distinct_sets(keys: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's keys once, sorted."""
    own = text.owner(begin)
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    return keys[new], np.searchsorted(own[new], np.arange(len(begin)))


#: Rows, and bytes of text, of the groups that are split into n-grams together.
GATHERED_ROWS, GATHERED_BYTES = 4096, 4 << 20


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups (comp, i, j), several at once: their rows, and where each group begins; a large group comes alone."""
    held: list[pa.RecordBatch] = []
    at, size, last = [0], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())))[cuts].tolist()
        goes_on, begin = last is not None and np.array_equal(ids[0], last), 0
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            own = upto[k + 1] - upto[k]
            if a == 0 and goes_on:
                at[-1] += b
            else:
                if at[-1] and (at[-1] >= GATHERED_ROWS or size + own > GATHERED_BYTES):
                    held.append(batch.slice(begin, a - begin))
                    yield pa.Table.from_batches(held).combine_chunks(), np.array(at)
                    held, at, size, begin = [], [0], 0, a
                at.append(at[-1] + b - a)
            size += own
        held.append(batch.slice(begin))
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.array(at)


def few_linked(keys: np.ndarray, begin: np.ndarray, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of sets (places) inside groups of FEW sets at most, which begin at ``at``; larger groups have none here.

    Keys may repeat within a set. A key that several sets of a group have counts once for each pair of them."""
    size = np.diff(at)
    group = np.repeat(np.arange(len(size)), size)
    some = np.repeat(((size > 1) & (size <= FEW))[group], np.diff(begin))
    own = text.owner(begin)[some]
    code, alike = _codes(keys[some])
    # (group, key, place in the group) in one number: sorted once, repeats fall together.
    spot = np.sort((group[own] * alike + code) * FEW + (own - at[group[own]]))
    spot = spot[np.append(True, spot[1:] != spot[:-1])] if len(spot) else spot
    run, own = spot // FEW, at[spot // FEW // max(alike, 1)] + spot % FEW
    full = np.bincount(own, minlength=len(group))
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
    shared = np.diff(np.append(first, len(run)))
    square = np.concatenate(([0], np.cumsum(np.where(size <= FEW, size * size, 0))))
    common = np.zeros(square[-1], np.int64)
    for n in range(2, FEW + 1):
        x, y = np.triu_indices(n, 1)
        rows = first[shared == n]
        for k in range(0, len(rows), LAID_OUT // len(x)):
            sets = own[rows[k : k + LAID_OUT // len(x), None] + np.arange(n)]
            g = group[sets[:, 0]]
            inside = sets - at[g][:, None]
            slot = square[g][:, None] + inside[:, x] * size[g][:, None] + inside[:, y]
            common += np.bincount(slot.ravel(), minlength=len(common))
    slot = np.flatnonzero(common)
    g = np.searchsorted(square, slot, "right") - 1
    x, y = (at[g] + z for z in np.divmod(slot - square[g], np.maximum(size[g], 1)))
    hit = common[slot] >= threshold * (full[x] + full[y] - common[slot]) - 1e-9
    return x[hit], y[hit]


def _compare(shingles: Callable, threshold: float):
    def many(sets: tuple[np.ndarray, np.ndarray], side: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
        """(how many links each set has, the least place that it is joined with) of one group."""
        n = len(sets[1]) - 1
        count, root = np.zeros(n, np.int64), np.arange(n)
        pairs: list[np.ndarray] = []
        for i, others in linked(sets, side, across, threshold):
            count[i] += len(others)
            # Only links to places before it that aren't joined with it yet; of each root one.
            before = others[others < i]
            pairs.append(np.column_stack([np.full(len(before), i), before])[np.unique(root[before], return_index=True)[1]])
            if len(before):
                root[i] = root[before].min()
        every = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
        return count, least(n, every[:, 0], every[:, 1])

    def run(batches):
        for whole, at in _gathered(batches):
            node, side = whole["node"].to_numpy(), whole["chunk"].to_numpy()
            across = whole["i"].to_numpy() != whole["j"].to_numpy()
            keys, begin = shingles(*text.flat(whole["text"]))
            x, y = few_linked(keys, begin, at, threshold)
            apart = ~across[x] | (side[x] != side[y])
            x, y = x[apart], y[apart]
            count, near = np.bincount(np.concatenate((x, y)), minlength=len(node)), least(len(node), x, y)
            for g in np.flatnonzero(np.diff(at) > FEW).tolist():
                a, b = at[g], at[g + 1]
                count[a:b], root = many(distinct_sets(keys[begin[a] : begin[b]], begin[a : b + 1] - begin[a]), side[a:b], bool(across[a]))
                near[a:b] = a + root
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (node[hit], count[hit], node[near[hit]])], ["node", "links", "near"])

    return run


def links(members: DataFrame, shingles: Callable, threshold: float, most: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(node, links: how many it has; node, label: its component over links). ``members``: node, comp, weight, text.

    ``shingles`` gives keys and begins for bytes and offsets; ``weight`` is the number of keys. Nodes without a link are in
    neither table. Both are written tables, which the caller may drop.
    """
    members = scratch.table(members, "sets")  # read twice
    size = members.groupBy("comp").agg(F.sum("weight").alias("w"))
    cut = size.filter(F.col("w") > most).select("comp", F.ceil(F.col("w") / most).cast("int").alias("k"))
    placed = members.join(cut, "comp", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    paired = placed.select("comp", "node", "chunk", "text", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    paired = paired.select("comp", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "node", "chunk", "text")
    dealt = paired.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    found = scratch.table(dealt.mapInArrow(lean(_compare(shingles, threshold)), "node bigint, links bigint, near bigint"), "links")
    scratch.drop(members)
    counts = scratch.table(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    labels = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    scratch.drop(found)
    return counts, labels

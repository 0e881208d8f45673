"""Importance resampling towards a target: hashed word n-grams of a corpus weighed by how much likelier the target has them.

The corpus is read once into a sparse document-by-bucket count matrix, which is persisted as CSR blocks (one row a block: where
each document's entries begin, the buckets, the counts). Column sums of the blocks, and of the target's, give two
distributions over ``buckets``; a bucket's gain is the floor of 1000 times the logarithm of their smoothed ratio, and the product
of the matrix with the gains gives each document's weight. With Gumbel noise of the document's id added, the highest scores are
a draw without replacement in proportion to the weights' exponentials.

Ranks come from a range sort of narrow rows, numbered part by part in a written table; a document's place in the matrix is the last
key, so repeated documents are no hot key.

Defined results: a null text has no words; a null doc_id has the noise of the text ``<seed>:null``; repeated doc_ids are documents of
their own, and equal ones among them take following ranks; with an empty target, or an empty corpus, the formula holds as
it is; other columns are not read. Documents with fewer than ``least`` words are weighed, but never drawn.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text
from .workers import lean

BUCKETS, GRAMS, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
#: Spark decodes a row group's rows at once, up to 4,096 blocks of any size: so row groups are small, whatever a task reads.
ROW_GROUP = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 4}
#: Bytes of a feature that are hashed together with all others'; longer ones are hashed one by one.
SHORT = 64

_BLOCK = "part int, block bigint, doc_ids array<bigint>, first array<int>, buckets array<int>, counts array<int>, n_words array<bigint>"
_ALPHANUMERIC = np.zeros(256, bool)
_ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
# zlib's table from the values of single bytes: crc32(b) = table[b ^ 0xFF] ^ 0xFF000000 as the register begins and ends inverted.
_CRC = _CRC[np.arange(256) ^ 0xFF] ^ np.uint32(0xFF000000)


def crc32s(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span's bytes."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    begin, long = starts[order], length[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(long[0]) if len(long) else 0, SHORT)):
        n = int(np.searchsorted(-long, -k, "left"))  # those longer than k come first
        s = state[:n]
        state[:n] = _CRC[(s ^ buf[begin[:n] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(length > SHORT).tolist():
        out[k] = zlib.crc32(buf[starts[k] : ends[k]].tobytes())
    return out


def _features(buf: np.ndarray, offsets: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and CRC-32 of all runs of 1 to ``grams`` words, joined by one space; and each text's number of words."""
    buf = _LOWER[buf]
    starts, ends, first = text.spans(_ALPHANUMERIC, buf, offsets)
    n_words = np.diff(first)
    owner, crc = [text.owner(first)], [crc32s(buf, starts, ends)]
    if grams > 1:
        # The words once more, with one space after each.
        wide = ends - starts + 1
        at = np.concatenate(([0], np.cumsum(wide)))
        joined = np.full(at[-1], 0x20, np.uint8)
        spot = np.ones(at[-1], bool)
        spot[at[1:] - 1] = False
        joined[spot] = buf[np.repeat(starts - at[:-1], wide)[spot] + np.flatnonzero(spot)]
        for k in range(2, grams + 1):
            begin, own = text.windows(first, k)
            owner.append(text.owner(own))
            crc.append(crc32s(joined, at[begin], at[begin + k] - 1))
    return np.concatenate(owner), np.concatenate(crc), n_words


def matrix(docs: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """A written table of CSR blocks. ``first``: where each document's entries start, one more than documents."""

    def run(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, buf, offsets in text.slices(batch.column(1), BLOCK_BYTES):
                owner, crc, n_words = _features(buf, offsets, grams)
                entries, counts = np.unique(owner * buckets + crc % np.uint32(buckets), return_counts=True)
                first = np.searchsorted(entries, np.arange(b - a + 1) * buckets)
                one = [[part], [block], [batch.column(0).slice(a, b - a).to_pylist()], [first.astype(np.int32)], [(entries % buckets).astype(np.int32)], [counts.astype(np.int32)], [n_words]]
                kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])
                block += 1

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).cast("string").alias("text"))
    return scratch.table(chosen.mapInArrow(lean(run), _BLOCK), "matrix", **ROW_GROUP)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: one row of ``buckets`` numbers a task, added up by bucket."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            own, counts = (batch.column(i).combine_chunks().flatten() if isinstance(batch.column(i), pa.ChunkedArray) else batch.column(i).flatten() for i in (0, 1))
            sums += np.bincount(own.to_numpy(zero_copy_only=False), counts.to_numpy(zero_copy_only=False), buckets).astype(np.int64)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("buckets", "counts").mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) * (S + B)) / ((s + 1) * (T + B)))) for each of B buckets."""
    n = len(corpus)
    top, bottom = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * top / ((s + 1.0) * bottom))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """part, place (in its part), doc_id, n_words, n_features, weight: the matrix times the gains."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, ids, first, own, counts, n_words = (batch.column(i).slice(row, 1) for i in range(7))
                own, counts, first = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, counts, first))
                total, many = (np.concatenate(([0], np.cumsum(x))) for x in (gain[own] * counts, counts))
                n = len(first) - 1
                place = (block[0].as_py() << 32) + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part[0].as_py(), np.int32)), pa.array(place), ids.flatten(), n_words.flatten(), pa.array(many[first[1:]] - many[first[:-1]]), pa.array(total[first[1:]] - total[first[:-1]])], ["part", "place", "doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(lean(run), "part int, place bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: str, seed: int) -> F.Column:
    """floor(-1000 * ln(-ln(u))), u from the first 8 hex digits of the SHA-256 of ``<seed>:<doc_id>``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def _numbered(batches):
    """Number the rows of a sorted part."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n))], [*batch.schema.names, "sorted", "index"])
        at += n


def drawn(weighed: DataFrame, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of what :func:`weights` gives; rank is null where a document isn't drawn."""
    scored = weighed.withColumn("score", F.col("weight") + noise("doc_id", seed))
    order = (F.col("score").desc(), F.col("doc_id"), "n_features", "part", "place")
    able = scored.filter(F.col("n_words") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = able.select("doc_id", "n_features", "weight", "score")
    names = "doc_id bigint, n_features bigint, weight bigint, score bigint"
    ordered = scratch.table(kept.mapInArrow(lean(_numbered), f"{names}, sorted int, index bigint"), "ranked")
    sizes = {r["sorted"]: r["n"] for r in ordered.groupBy("sorted").agg(F.count("*").alias("n")).collect()}  # a row a part
    last = max(sizes, default=-1) + 1
    before = np.concatenate(([0], np.cumsum([sizes.get(k, 0) for k in range(last)]))).tolist()
    most = percent * before[-1] // 100
    starts = ordered.sparkSession.createDataFrame([(k, before[k]) for k in sizes] or [(0, 0)], "sorted int, before bigint")
    rank = F.col("before") + F.col("index") + 1
    top = ordered.join(F.broadcast(starts), "sorted").select("doc_id", "n_features", "weight", "score", F.when(rank <= most, rank).alias("rank"))  # starts: a row a part
    rest = scored.filter(F.col("n_words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return top.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, doc_id: str = "doc_id", body: str = "text", target_body: str = "text") -> DataFrame:
    """A row for each document; the drawn ones have ranks 1, 2, 3 and so on in descending order of their scores."""
    blocks = matrix(docs, buckets, grams, doc_id, body)
    aim = matrix(target.select(F.lit(0).alias("doc_id"), F.col(target_body).alias("text")), buckets, grams)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))
    scratch.drop(aim)
    return drawn(weights(blocks, gain), least, percent, seed)

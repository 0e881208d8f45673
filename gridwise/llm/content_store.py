"""Token-id output: a content-addressed store of chunks.

A rolling hash over the ids cuts each document's stream where its content says so, so equal passages give equal
chunks. Three Parquet tables make up a store at ``path``:

``chunks``    digest (SHA-256 of the ids as little-endian unsigned 32-bit), n, width (bytes an id has here), data;
              each digest once
``recipes``   a row per document in ascending doc_id order over the part files: doc_id, n_tokens, part, index (in the
              part), before (ids in the part before it), chunks (digest, n), root (Merkle root of the digests)
``manifest``  level, part, node, n, root: a Merkle tree of FAN_OUT over the documents' roots in each part (levels 1 to 3), and
              over the parts (part -1, levels 4 and 5) up to one root for the whole store

Defined results: a null text is empty (only the end id); a null doc_id sorts first; repeated doc_ids are documents of
their own, in an order fixed by their ids; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, text, tokens

END_ID = 2
#: Ids that the rolling hash sees, the mean distance of its cuts, and the least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 512, 64, 4096
FAN_OUT = 1024
#: The manifest's levels, and the first one whose nodes gather parts.
LEVELS, PARTS_LEVEL = 5, 4
#: Digests that a task remembers so as to send a chunk's ids once.
SEEN = 200_000

_ENCODED = "doc_id bigint, n_tokens bigint, chunks array<struct<digest: binary, n: int, width: int, data: binary>>"
_POLY = 0xEDB88320


def boundaries(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks start (all ids; the end included) and each document's first chunk. No document is empty."""
    rolling = text.Rolling(text.mix(ids.astype(np.uint64) + np.uint64(0x51ED2701)))
    cut = np.zeros(len(ids) + 1, bool)
    for at in range(0, len(ids) - WINDOW + 1, text.PIECE):
        begin = np.arange(at, min(at + text.PIECE, len(ids) - WINDOW + 1))
        cut[begin + WINDOW] = (rolling(begin, WINDOW) & np.uint64(MEAN - 1)) == 0
    found = np.flatnonzero(cut)
    lo, hi = np.searchsorted(found, offsets[:-1] + LEAST), np.searchsorted(found, offsets[1:])
    out, first = [], [0]
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
        out.append(a)
        last = a
        for c in (*found[i:j].tolist(), b):
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c - last >= LEAST and c < b:
                out.append(c)
                last = c
        first.append(len(out))
    return np.array([*out, offsets[-1]], np.int64), np.array(first)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node goes up unchanged."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with the end id after each document."""
    n = len(offsets) - 1
    stops = offsets + np.arange(n + 1)
    out = np.full(stops[-1], end, np.int32)
    spot = np.ones(len(out), bool)
    spot[stops[1:] - 1] = False
    out[spot] = ids
    return out, stops


def _encode(path: str):
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for a, b, ids, offsets in tokens.encode_all(path, batch.column(1)):
                ids, offsets = with_end(ids, offsets, END_ID)
                at, first = boundaries(ids, offsets)
                wide, narrow = ids.astype("<u4").tobytes(), ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else None
                digests, data = [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    digests.append(d := hashlib.sha256(wide[4 * x : 4 * y]).digest())
                    data.append(None if d in seen else narrow[2 * x : 2 * y] if narrow is not None else wide[4 * x : 4 * y])
                    seen.add(d)
                if len(seen) > SEEN:
                    seen.clear()
                n = pa.array(np.diff(at), pa.int32())
                width = pa.array(np.full(len(n), 2 if narrow is not None else 4, np.int32))
                chunk = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), n, width, pa.array(data, pa.binary())], ["digest", "n", "width", "data"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), chunk)], ["doc_id", "n_tokens", "chunks"])

    return run


def _recipes(batches):
    """Number the rows of a sorted part and add up what stands before each."""
    from pyspark import TaskContext

    part, index, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        counts = batch.column(1).to_numpy()
        ends = before + np.cumsum(counts)
        roots = [merkle([c["digest"] for c in x]) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, part, np.int32)), pa.array(index + np.arange(n), pa.int64()), pa.array(ends - counts, pa.int64()), batch.column(2), pa.array(roots, pa.binary())], ["doc_id", "n_tokens", "part", "index", "before", "chunks", "root"])
        index += n
        before = int(ends[-1]) if n else before


def _above(level: DataFrame, k: int) -> DataFrame:
    """Level k of the manifest from the one below it; each node gathers FAN_OUT roots at most."""
    across = k == PARTS_LEVEL  # this level's nodes gather parts
    below = level.select("part", F.col("part").cast("bigint").alias("node"), "n", "root") if across else level
    part = F.lit(-1) if k >= PARTS_LEVEL else F.col("part")
    group = below.groupBy(part.alias("part"), F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("node", "root"))).alias("below"))
    return group.select(F.lit(k).alias("level"), "part", "node", "n", F.unhex(F.sha2(F.array_join(F.transform("below", lambda x: F.hex(x["root"])), ""), 256)).alias("root"))


def _leaves(recipes: DataFrame, root: Column) -> DataFrame:
    return recipes.select("part", F.col("index").alias("node"), F.lit(1).cast("bigint").alias("n"), root.alias("root"))


def _tree(recipes: DataFrame) -> DataFrame:
    """All manifest rows."""
    level, out = _leaves(recipes, F.col("root")), []
    for k in range(1, LEVELS + 1):
        level = _above(level, k)
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", body: str = "text") -> None:
    """Encode all of ``docs`` and write the store to ``path``. ``tokenizer``: a file of the tokenizers library."""
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).cast("string").alias("text"))
    encoded = scratch.table(chosen.mapInArrow(_encode(tokenizer), _ENCODED), "encoded")
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.*").filter(F.col("data").isNotNull())
    chunks.groupBy("digest").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipe = encoded.select("doc_id", "n_tokens", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))).alias("chunks"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("chunks"), F.col("n_tokens")]
    schema = "doc_id bigint, n_tokens bigint, part int, index bigint, before bigint, chunks array<struct<digest: binary, n: int>>, root binary"
    recipe.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order).mapInArrow(_recipes, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _tree(docs.sparkSession.read.parquet(f"{path}/recipes").select("part", "index", "root")).write.parquet(f"{path}/manifest")
    scratch.drop(encoded)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bits reversed as in zlib."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(len(a), np.uint64)
    for k in range(32):
        out ^= np.where(a >> np.uint64(31 - k) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(_POLY), np.uint64(0))
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a CRC-32 contributes when so many bytes follow; the parts of a whole are joined by XOR."""
    square = np.array([1 << 23], np.uint64)  # x ** 8, one byte
    out, left = crc.astype(np.uint64), zeros.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _multiply(out[odd], np.repeat(square, int(odd.sum())))
        left >>= np.uint64(1)
        square = _multiply(square, square)
    return out


def _check_chunks(batches):
    for batch in batches:
        crcs, good = [], []
        for digest, n, width, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ids = np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
            crcs.append(zlib.crc32(ids))
            good.append(len(ids) == 4 * n and hashlib.sha256(ids).digest() == digest)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], ["digest", "crc", "good"])


def _cut_up(batches):
    """row, digest and the bytes of ids that follow (zeros) of each chunk in recipes (row, chunks)."""
    for batch in batches:
        chunks = batch.column(1)
        if isinstance(chunks, pa.ChunkedArray):
            chunks = chunks.combine_chunks()
        each = chunks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = chunks.flatten()
        upto = np.cumsum(flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.cumsum(each) - 1  # a recipe has a chunk at least
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), each))), flat.field("digest"), pa.array(4 * (np.repeat(upto[ends], each) - upto))], ["row", "digest", "zeros"])


def _shift(batches):
    for batch in batches:
        crc, zeros = batch.column(1).fill_null(0).to_numpy(), batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shift_crc(crc, zeros).astype(np.int64)), batch.column(3)], ["row", "crc", "good"])


def starts(recipes: DataFrame) -> DataFrame:
    """part, ids in all parts before it: a row per part file."""
    from pyspark.sql import Window

    totals = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def root(spark: SparkSession, path: str) -> bytes | None:
    """The one root of the store: equal roots, equal documents in equal order. None for an empty store."""
    top = spark.read.parquet(f"{path}/manifest").filter(F.col("level") == LEVELS).select("root").collect()  # a row
    return bytes(top[0][0]) if top else None


def _differing(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    keys = ["level", "part", "node"]
    both = fresh.select(*keys, "root").join(kept.select(*keys, F.col("root").alias("kept")), keys, "full")
    return both.filter(~F.col("root").eqNullSafe(F.col("kept"))).select(*keys)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """level, part, node of the manifest's nodes that differ from what stands below them (none, if all is well).

    Level 1 is made anew from the digests in the recipes, each further level from the stored one below it, so what differs
    names the documents (or nodes) that were changed.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    out = _differing(_above(_leaves(spark.read.parquet(f"{path}/recipes"), _root_of("chunks")), 1), manifest.filter("level = 1"))
    for k in range(2, LEVELS + 1):
        out = out.unionByName(_differing(_above(manifest.filter(F.col("level") == k - 1).drop("level"), k), manifest.filter(F.col("level") == k)))
    return out


def _root_of(column: str):
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("binary")
    def root(chunks):
        return chunks.map(lambda x: merkle([bytes(c["digest"]) for c in x]))

    return root(F.col(column))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified: of each document, from the files.

    Each stored chunk is hashed again; a document's CRC-32 is joined from those of its chunks, so ids aren't shuffled. A
    document is verified if its chunks are what their digests say, and the manifest, up to its root, what the recipes say.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "n", "width", "data").mapInArrow(_check_chunks, "digest binary, crc bigint, good boolean")
    row = (F.col("part").cast("bigint") * F.lit(1 << 40) + F.col("index")).alias("row")
    parts = recipes.select(row, "chunks").mapInArrow(_cut_up, "row bigint, digest binary, zeros bigint")
    joined = parts.join(chunks, "digest", "left").select("row", "crc", "zeros", F.coalesce("good", F.lit(False)).alias("good"))
    whole = joined.mapInArrow(_shift, "row bigint, crc bigint, good boolean").groupBy("row").agg(F.bit_xor("crc").alias("ids_crc32"), F.count_if(~F.col("good")).alias("bad"), F.count("*").alias("n_chunks"))
    rows = recipes.select(row, "doc_id", "n_tokens", "part", "before").join(F.broadcast(starts(recipes)), "part")  # a row per part file
    out = rows.join(whole, "row").withColumn("good", F.col("bad") == 0)
    wrong = scratch.table(verify(spark, path), "wrong")
    if not wrong.isEmpty():
        # A wrong node of level k covers FAN_OUT ** k documents of its part, or parts.
        under = wrong.select("level", F.col("part").alias("p"), F.col("node").alias("w")).filter(F.col("level") < PARTS_LEVEL).distinct()
        places = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.shiftright("index", 10 * k)).alias("w")) for k in range(1, PARTS_LEVEL)]))
        index = recipes.select(row, "part", "index").select("row", "part", places.alias("x")).select("row", "part", "x.*")
        hit = index.join(under.withColumnRenamed("p", "part"), ["level", "part", "w"]).select("row").distinct()
        above = not wrong.filter(F.col("level") >= PARTS_LEVEL).isEmpty()
        out = out.join(hit.withColumn("hit", F.lit(True)), "row", "left").withColumn("good", F.col("good") & F.col("hit").isNull() & F.lit(not above))
    return out.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", F.col("good").alias("verified"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array of int): every document put together again from its recipe."""
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    parts = recipes.select("part", "index", "doc_id", F.posexplode("chunks").alias("pos", "c")).select("part", "index", "doc_id", "pos", "c.digest")

    def decode(batches):
        for batch in batches:
            ids = [np.frombuffer(d, "<u2" if w == 2 else "<u4").astype(np.int32) for w, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ids, pa.list_(pa.int32()))], ["part", "index", "doc_id", "pos", "ids"])

    pieces = parts.join(chunks, "digest").select("part", "index", "doc_id", "pos", "width", "data").mapInArrow(decode, "part int, index bigint, doc_id bigint, pos int, ids array<int>")
    whole = pieces.groupBy("part", "index", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    return whole.select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))

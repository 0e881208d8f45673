"""N-gram Jaccard join of documents: MinHash bands find candidates, full n-gram sets decide.

Texts are sets of hashed n-grams of five words. Equal texts are copies and are compared once. Texts whose Jaccard
similarity is ``THRESHOLD`` or more are linked; the components of links and copies are classes. BANDS x ROWS is chosen so
that a pair at the threshold is found with probability ``RECALL``.

Defined results: a null text is an empty one; a text of fewer than five words is one n-gram of all its words; texts
without a word have no n-grams and link to none, but equal ones are copies. A class is named by its least doc_id (null
if it has none). Repeated and null doc_ids are rows of their own. An empty table gives no rows; other columns are not
read by :func:`join`, and pass through :func:`keep_one`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, scratch, text
from .components import with_least
from .workers import lean

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
BANDS, ROWS = minhash.bands(THRESHOLD, RECALL, 5)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams (repeats included), and where each text's begin."""
    starts, ends, first = text.words(buf, offsets)
    rolling = text.Rolling(text.hashes(buf, starts, ends))
    at, begin = text.windows(first, WORDS)
    keys = rolling(at, WORDS)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if not len(short):
        return keys, begin
    size = np.diff(begin)
    size[short] = 1
    to = np.concatenate(([0], np.cumsum(size)))
    every = np.empty(to[-1], np.uint64)
    spot = np.zeros(to[-1], bool)
    spot[to[:-1][short]] = True
    every[spot], every[~spot] = rolling(first[:-1][short], count[short]), keys
    return every, to


def _sign(batches):
    """doc_id, digest, weight and bands of each text; a text met before in this task has no bands."""
    seen: set[bytes] = set()
    for batch in batches:
        for a, b, buf, offsets in text.slices(batch.column(1)):
            data = buf.tobytes()
            digests = [hashlib.md5(data[x:y]).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            keys, begin = shingles(buf, offsets)
            got = minhash.band_keys(minhash.minima(keys, begin, BANDS * ROWS), BANDS, ROWS)
            weight = np.diff(begin)
            packed = []
            for d, w, row in zip(digests, weight.tolist(), got, strict=True):
                packed.append(row.tobytes() if w and d not in seen else None)
                seen.add(d)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(weight, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "digest", "weight", "bands"])


def _pack(bits: int):
    def run(batches):
        for batch in batches:
            keys = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if keys:
                yield minhash.pack(np.concatenate(keys), np.repeat(batch.column(0).to_numpy(), BANDS), bits)

    return run


def _classes(docs: DataFrame, with_rows: bool) -> tuple[DataFrame | None, DataFrame]:
    """(doc_id, digest) of all rows, if asked for; (digest, class_id, links, copies, class) of all texts. Written tables."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = scratch.table(plain.mapInArrow(lean(_sign), "doc_id bigint, digest binary, weight bigint, bands binary"), "signed")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("weight").alias("weight"), F.max("bands").alias("bands"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    packed = nodes.filter("bands is not null").select("node", "bands").mapInArrow(lean(_pack(minhash.part_bits(docs.sparkSession))), minhash.PACKED)
    rows = scratch.table(signed.select("doc_id", "digest"), "rows") if with_rows else None
    scratch.drop(signed)
    coarse = minhash.candidates(packed)
    wanted = scratch.table(nodes.join(coarse, "node").select("node", F.col("label").alias("comp"), "weight", "digest", "doc_id"), "wanted")
    scratch.drop(coarse)
    bodies = plain.select(F.col("doc_id").alias("_d"), F.unhex(F.md5("text")).alias("_h"), "text")
    # Both lists that texts are joined with grow with the input: never broadcast.
    found = bodies.join(wanted.hint("merge"), (F.col("_h") == F.col("digest")) & F.col("_d").eqNullSafe(F.col("doc_id")))
    members = found.groupBy("node").agg(F.first("comp").alias("comp"), F.first("weight").alias("weight"), F.first("text").alias("text"))
    counts, labels = minhash.links(members, shingles, THRESHOLD)
    named = nodes.select("node", "digest", "doc_id", "copies").join(counts, "node", "left").join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    first = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    texts = named.join(first, "class").select("digest", "class", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "copies")
    texts = scratch.table(texts, "classes")
    scratch.drop(nodes, wanted, counts, labels)
    return rows, texts


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (different texts that it is linked to), n_copies (other rows with its text): a row per document."""
    rows, texts = _classes(docs, True)
    return rows.join(texts, "digest").select("doc_id", "class_id", F.col("links").alias("n_links"), (F.col("copies") - 1).alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without the others of each class: that of least doc_id stays (of rows equal in doc_id, the least digest)."""
    _, texts = _classes(docs, False)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest"), F.col("doc_id").cast("bigint").alias("key"))
    rows = marked.groupBy("digest", "key").agg(F.count("*").alias("n")).join(texts.select("digest", "class"), "digest")
    rows = scratch.table(rows, "members")
    rank = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("digest").alias("digest"))
    best = with_least(rows.select("class", "digest", "key", rank.alias("rank")), "class", "rank", "best", ("digest", "key"))
    gone = best.filter("rank <> best").select(F.col("digest").alias("gone_digest"), F.col("key").alias("gone_key"))
    kept = marked.join(gone.hint("merge"), (F.col("digest") == F.col("gone_digest")) & F.col("key").eqNullSafe(F.col("gone_key")), "left_anti")
    if not rows.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["digest", "key"])
    return kept.select("doc.*")

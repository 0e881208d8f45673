"""Benchmark decontamination by spaced seeds.

Each mask ignores fixed positions of a window of words, so windows that differ there only have equal hashes. The hashes of
all benchmark windows are joined with those of all windows of all documents. A hit lays an item over a document; around it
the best stretch, matches scoring 1 and substitutions -4, is verified on whole words. A document is contaminated by an item
if that stretch has ``LEAST_MATCHES`` equal words, or four fifths of the item where that is less. It is also contaminated if
the item, laid over it whole, has four fifths equal words wherever the others stand; such an item has one to four equal words
in a row (``seed``), by which all these places are found. So items of any length take part: those of up to four words must
occur as they are.

One pass over the documents sends the hashes that the benchmark may have (a sieve of fixed size tells) to the join; equal
windows in a row are one row, on either side. A hash that very many documents have is dealt over SALTS tasks. The documents
with hits, and no others, are then sent to their items' words and verified. Neither the benchmark nor an index of it is
collected or broadcast.

Words are ``[^\\x20\\x09-\\x0D]+`` without regard to case, by Unicode's full case folding (so that STRASSE is straße).

Defined results: null or empty texts and items contaminate nothing and aren't contaminated; of items with equal texts the
least item_id is named (null only if all are null); of equally good stretches the longest counts, then the first; repeated rows and null
doc_ids each get rows; ids that aren't integers are an error; an empty table on either side gives no rows; other columns
aren't read by :func:`overlaps` and pass through :func:`clean`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, sieve, text
from .components import SALTS
from .workers import lean

# Positions that count (1) in each window.
MASKS = ("111011001101", "110101110011", "101110011011", "110011101101", "11111111")
LEAST_MATCHES, MISMATCH = 13, -4
#: Masks by which items are laid whole over documents; see seed().
SEEDS = ("1", "11", "111", "1111")
#: Words that are compared at once.
COMPARED = 1 << 19
#: Groups that a document's items are dealt over, so that no row gathers very many.
ITEM_GROUPS = 64
SCHEMA = "doc_id bigint, item_id bigint, n_matched bigint, item_words bigint, doc_start bigint, doc_end bigint"
WINDOW = "h bigint, key bigint, at int, run int"

_FACTORS = np.random.default_rng(20260103).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(h: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """The hash of each window of word hashes, at its first word."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), seed + 1, np.uint64)
    for j, c in enumerate(mask if n > 0 else ""):
        if c == "1":
            out += h[j : j + n] * _FACTORS[j]
    return text.mix(out)


def least_equal(n):
    """Four fifths of n words, rounded up."""
    return -(-4 * n // 5)


def seed(n: np.ndarray) -> np.ndarray:
    """Equal words in a row that an item of n words has at least where four fifths are equal, up to the longest of SEEDS."""
    equal = least_equal(n)
    return np.minimum(-(-equal // (n - equal + 1)), len(SEEDS))


def _folded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice, case-folded where they hold more than ASCII; A-Z are folded by their hash."""
    if not (buf & 0x80).any():
        return buf, offsets
    data = buf.tobytes()
    texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    texts = [x if x.isascii() else x.decode(errors="surrogateescape").casefold().encode(errors="surrogateescape") for x in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words, and each text's first."""
    buf, offsets = _folded(buf, offsets)
    starts, ends, first = text.words(buf, offsets)
    return text.hashes(buf, starts, ends, True), first


def _runs(h: np.ndarray, first: np.ndarray, mask: str, number: int, wanted: np.ndarray | None, bits: bytes | None) -> tuple[np.ndarray, ...]:
    """(hash, text, place in the text, length) of the runs of equal windows; ``wanted``: texts that this mask is for."""
    got = windows(h, mask, number)
    if not len(got):
        return got, *(np.zeros(0, np.int64),) * 3
    at = np.arange(len(got)) if bits is None else np.flatnonzero(sieve.passes(bits, got))
    own = np.searchsorted(first, at, "right") - 1
    inside = at + len(mask) <= first[own + 1]
    if wanted is not None:
        inside &= wanted[own]
    at, own = at[inside], own[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (got[at[1:]] != got[at[:-1]])
    begin = np.flatnonzero(new)
    return got[at[begin]], own[begin], at[begin] - first[own[begin]], np.diff(np.append(begin, len(at)))


def _window_rows(keys: np.ndarray, h: np.ndarray, first: np.ndarray, seeds: np.ndarray | None = None, bits: bytes | None = None):
    """Rows of WINDOW for all masks; ``seeds``: the seed of each text (items have one, documents all)."""
    for k, mask in enumerate((*MASKS, *SEEDS)):
        wanted = seeds == len(mask) if seeds is not None and k >= len(MASKS) else None
        got, own, at, run = _runs(h, first, mask, k, wanted, bits)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(keys[own]), pa.array(at, pa.int32()), pa.array(run, pa.int32())], ["h", "key", "at", "run"])


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, words (hashes): each distinct text with a word."""
    known = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    known = known.groupBy("text").agg(F.min("item_id").alias("item_id"))

    def hashed(batches):
        for batch in batches:
            for a, b, buf, offsets in text.slices(batch.column(1)):
                h, first = word_hashes(buf, offsets)
                words = [h[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.binary())], ["item_id", "words"])

    found = known.select("item_id", "text").mapInArrow(lean(hashed), "item_id bigint, words binary").filter("length(words) > 0")
    return scratch.table(found.withColumn("item", F.monotonically_increasing_id()), "items")


def _item_windows(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            words = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
            size = np.array([len(x) for x in words])
            yield from _window_rows(part.column(0).to_numpy(), np.concatenate(words), np.concatenate(([0], np.cumsum(size))), seed(size))


def _probe(bits):
    """Windows of the documents (key, text) that the benchmark may have."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b, buf, offsets in text.slices(batch.column(1)):
                yield from _window_rows(keys[a:b], *word_hashes(buf, offsets), bits=bits.value)

    return run


def laid(h: np.ndarray, item: np.ndarray, lays: np.ndarray) -> tuple[int, int, int] | None:
    """(equal words, first and past the last word of the document) of an item that contaminates a document; None if it doesn't.

    ``lays``: words of the document (rising; they may lie outside) that the item's first word is laid on.
    """
    n, best, whole = len(item), None, None
    place = np.arange(n)
    for a in range(0, len(lays), step := max(1, COMPARED // n)):
        lay = lays[a : a + step]
        at = lay[:, None] + place
        same = (at >= 0) & (at < len(h))
        same &= h[np.where(same, at, 0)] == item
        zero = np.zeros((len(lay), 1), np.int64)
        score = np.concatenate((zero, np.cumsum(np.where(same, 1, MISMATCH), axis=1)), axis=1)
        low = np.minimum.accumulate(score, axis=1)
        end = np.argmax(score - low, axis=1)
        begin = np.argmax(score == np.take_along_axis(low, end[:, None], 1), axis=1)
        equal = np.concatenate((zero, np.cumsum(same, axis=1)), axis=1)
        count = np.take_along_axis(equal, end[:, None], 1)[:, 0] - np.take_along_axis(equal, begin[:, None], 1)[:, 0]
        k = int(np.argmax(count))
        if count[k] >= min(LEAST_MATCHES, least_equal(n)) and (best is None or count[k] > best[0]):
            best = int(count[k]), int(lay[k] + begin[k]), int(lay[k] + end[k])
        k = int(np.argmax(equal[:, -1]))
        if equal[k, -1] >= least_equal(n) and (whole is None or equal[k, -1] > whole[0]):
            whole = int(equal[k, -1]), max(int(lay[k]), 0), min(int(lay[k]) + n, len(h))
        if best is not None and best[0] == n:
            break
    return best or whole


def _verify(batches):
    """(key, id, item_id, ...) of the hits that hold, document by document."""
    for batch in batches:
        for i in range(batch.num_rows):
            out = []
            h, _ = word_hashes(*text.flat(batch.column(2).slice(i, 1)))
            for x in batch.column(3)[i].as_py():
                item = np.frombuffer(x["words"], np.uint64)
                # Ranges of places, each place once.
                lows, ends = np.array([y["lo"] for y in x["lays"]]), np.array([y["hi"] for y in x["lays"]]) + 1
                order = np.argsort(lows, kind="stable")
                lows, ends = lows[order], np.maximum.accumulate(ends[order])
                lows[1:] = np.maximum(lows[1:], ends[:-1])
                size = np.maximum(ends - lows, 0)
                lays = np.repeat(lows - (np.cumsum(size) - size), size) + np.arange(size.sum())
                if (got := laid(h, item, lays)) is not None:
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), x["item_id"], got[0], len(item), *got[1:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "doc_id", "item_id", "n_matched", "item_words", "doc_start", "doc_end"])


def _found(plain: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key and the columns of SCHEMA, tables that it reads). ``plain``: key (a hash of doc_id and text), id, text."""
    items = _items(benchmark)
    asked = scratch.table(items.select("item", "words").mapInArrow(lean(_item_windows), WINDOW).withColumnsRenamed({"key": "item", "at": "item_at", "run": "item_run"}), "item-windows")
    bits = sieve.make(asked, "h")
    probes = plain.select("key", "text").filter("text is not null").mapInArrow(lean(_probe(bits)), WINDOW)
    probes = scratch.table(probes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")), "probes")
    salts = probes.groupBy("h").agg(F.collect_set("salt").alias("salts"))  # SALTS at most
    dealt = asked.join(salts, "h").select("h", F.explode("salts").alias("salt"), "item", "item_at", "item_run")
    lo, hi = F.col("at") - F.col("item_at") - F.col("item_run") + 1, F.col("at") + F.col("run") - 1 - F.col("item_at")
    pairs = probes.join(dealt, ["h", "salt"]).groupBy("key", "item").agg(F.collect_set(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("lays"))
    named = pairs.join(items, "item").groupBy("key", F.pmod("item", F.lit(ITEM_GROUPS)).alias("g")).agg(F.collect_list(F.struct("item_id", "words", "lays")).alias("items"))
    hits = scratch.table(named.drop("g"), "hits")
    scratch.drop(asked, probes, items)
    near = plain.filter(sieve.may_have(sieve.make(hits, "key"), F.col("key")))
    rows = near.join(hits.hint("merge"), "key").select("key", "id", "text", "items")
    return rows.mapInArrow(lean(_verify), f"key bigint, {SCHEMA}"), [hits]


def _plain(docs: DataFrame) -> list:
    return [F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document and item, with the stretch of the document's words (from 0)."""
    return _found(docs.select(*_plain(docs)), benchmark)[0].drop("key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Only those that share a sieve's bit are shuffled."""
    found, read = _found(docs.select(*_plain(docs)), benchmark)
    bad = scratch.table(found.select(F.col("key").alias("bad"), F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    scratch.drop(*read)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_plain(docs)[:2])
    marked = marked.withColumn("near", sieve.may_have(sieve.make(bad, "bad"), F.col("key")))
    left = marked.filter("near").join(bad.hint("merge"), (F.col("key") == F.col("bad")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti")
    return marked.filter("not near").unionByName(left).select("doc.*")

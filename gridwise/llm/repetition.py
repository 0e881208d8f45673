"""Quality rules: how much of a text stands in repeated n-grams and lines.

One running sum over the words' hashes gives the hash of every n-gram of every length, in numpy, many texts at once. For each length in DUPLICATED the rule
measures the share of word characters inside n-grams that occur twice or more in their text (an overlap counts once);
for each length in TOP, the share that the most frequent n-gram's occurrences hold; and the share of characters, and
of lines, that repeat an earlier line. A text is kept if it passes the base rules and no share is over its limit.

Defined results: a null text has no words (base_failed); a null doc_id stays null; repeated rows each get a row; an
empty table gives no rows; other columns are not read. Whole texts are measured, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

# Limits published for web text (shares of characters in duplicate n-grams, in the most frequent n-gram).
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
LINE_CHARS, LINES = 0.20, 0.30
LEAST_WORDS = 10
REPEAT_PERCENT = 20
#: A most frequent n-gram counts from so many occurrences.
TOP_LEAST = 3
SYMBOLS = b"[#*$%&|<>]"

_SHARES = [f"dup_{n}" for n in DUPLICATED] + [f"top_{n}" for n in TOP] + ["dup_line_chars", "dup_lines"]
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, " + ", ".join(f"{x} double" for x in _SHARES)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point.
_POINT = (np.arange(256) & 0xC0) != 0x80


def repeats(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items with keys: how often each occurs in its text, and whether an equal one stands before it; sorted order."""
    own = text.mix(keys ^ (owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    count = np.empty(len(own), np.int64)
    count[order] = np.bincount(group)[group] if len(own) else 0
    earlier = np.empty(len(own), bool)
    earlier[order] = ~new
    return count, earlier, own


def covered(at: np.ndarray, hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items stand in a window (of k items from ``at``) that is hit."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at[hit], 1)
    np.add.at(step, at[hit] + k, -1)
    return np.cumsum(step[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts and shares of the texts of a slice."""
    starts, ends, first = text.words(buf, offsets)
    size = text.before(_POINT, buf, ends) - text.before(_POINT, buf, starts)
    rolling, doc = text.Rolling(text.hashes(buf, starts, ends)), text.owner(first)
    out = {"n_words": np.diff(first), "word_chars": text.per_text(size, first)}
    out["n_symbols"] = np.diff(text.before(_IS_SYMBOL, buf, offsets))
    chars = np.maximum(out["word_chars"], 1)

    a, b, line = text.filled_lines(buf, offsets)
    real = text.lettered(buf, a, b)  # lines with a word
    a, b = a[real], b[real]
    line = np.concatenate(([0], np.cumsum(real)))[line]
    _, earlier, _ = repeats(text.hashes(buf, a, b), text.owner(line))
    out["n_dup_lines"] = text.per_text(earlier, line)
    out["dup_lines"] = out["n_dup_lines"] / np.maximum(np.diff(line), 1)
    width = text.before(_POINT, buf, b) - text.before(_POINT, buf, a)
    out["dup_line_chars"] = text.per_text(earlier * width, line) / np.maximum(text.per_text(width, line), 1)

    lengths = list(DUPLICATED)
    live = np.ones(len(offsets) - 1, bool)  # a repeated n-gram holds a repeated (n-1)-gram
    for n in lengths:
        at, begin = text.windows(first, n)
        at = at[live[text.owner(begin)]]
        hits = np.zeros(len(doc), bool)
        if len(at):
            count, _, _ = repeats(rolling(at, n), doc[at])
            hits = covered(at, count > 1, n, len(doc))
        if n == lengths[0]:
            out["n_repeat_words"] = text.per_text(hits, first)
        out[f"dup_{n}"] = text.per_text(hits * size, first) / chars
        live = out[f"dup_{n}"] > 0
    for n in TOP:
        at, _ = text.windows(first, n)
        share = np.zeros(len(offsets) - 1)
        if len(at):
            count, _, own = repeats(rolling(at, n), doc[at])
            most = np.zeros(len(share), np.int64)
            np.maximum.at(most, doc[at], count)
            top = (count == most[doc[at]]) & (count >= TOP_LEAST)
            least = np.full(len(share), np.iinfo(np.uint64).max, np.uint64)  # of several equally frequent ones, one
            np.minimum.at(least, doc[at[top]], own[top])
            top &= own == least[doc[at]]
            share = text.per_text(covered(at, top, n, len(doc)) * size, first) / chars
        out[f"top_{n}"] = share
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    bad = out["base_failed"] | (out["dup_line_chars"] > LINE_CHARS) | (out["dup_lines"] > LINES)
    for n, most in DUPLICATED.items():
        bad = bad | (out[f"dup_{n}"] > most)
    for n, most in TOP.items():
        bad = bad | (out[f"top_{n}"] > most)
    out["kept"] = ~bad
    return out


def _run(batches):
    schema = [x.split() for x in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    for batch in batches:
        for a, b, buf, offsets in text.slices(batch.column(1)):
            got = measure(buf, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[x], kinds[k]) for x, k in schema[1:])], [x for x, _ in schema])


def rules(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """A row per document: counts, shares and the verdict ``kept``."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).cast("string").alias("text")).mapInArrow(_run, SCHEMA)

"""Ids of whole texts by a public tokenizer, with each distinct piece encoded once.

Both public models split a text before they merge: at white space and where letters, digits and other signs meet. For
texts of ASCII and Latin-1 letters these cuts are found in bytes with numpy; a piece (with the space before it, where
the model keeps that) is encoded by the library when a worker first sees it, and its ids are kept by a 64-bit hash of
its bytes. Merges never cross the cuts, so the ids are those of the whole text. Any text outside this alphabet, or with
white space that the rule doesn't cover, is encoded whole. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from . import text

#: Pieces held by a worker before it starts anew.
KEPT_PIECES = 1_000_000
#: Text bytes encoded at once.
SLICE_BYTES = 2 << 20
_SPACE, _LETTER, _DIGIT, _SIGN, _LINE, _BAD = range(6)
_open: dict[str, Encoder] = {}


def _classes(prefixed: bool) -> np.ndarray:
    """The class of each byte; bytes from 0x80 hold only as the two bytes of a Latin-1 letter."""
    out = np.full(256, _SIGN, np.uint8)
    out[: 0x20] = _BAD
    out[0x7F] = _BAD
    out[0x20] = _SPACE
    out[0x0A] = _LINE
    if not prefixed:
        out[0x09:0x0E] = _SPACE
    out[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
    out[48:58] = _DIGIT
    out[[0xC0, 0xC1, 0xC2, *range(0xC4, 256)]] = _BAD
    return out


def encoder(path: str) -> Encoder:
    """This process's encoder for the file at ``path``."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def close() -> None:
    """Forget this process's encoders and what they have encoded."""
    _open.clear()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            parts = {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer")}
        pre = parts.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not parts.get("normalizer"):
            self.mode = "prefixed"  # a piece takes the space before it
        elif steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
            self.mode = "dropped"  # white space goes
        else:
            self.mode = "whole"
        self.classes = _classes(self.mode == "prefixed")
        self.clear()

    def clear(self) -> None:
        self.known, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text by the library, and where they start."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=ends[1:])
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends

    def _uneven(self, buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which texts the cuts below don't hold for."""
        bad = kind == _BAD
        lead, tail = buf == 0xC3, (buf >= 0x80) & (buf < 0xC0)
        bad |= tail & ((buf == 0x97) | (buf == 0xB7))  # the signs for times and divided by
        bad[1:] |= tail[1:] != lead[:-1]
        if len(bad):
            bad[0] |= tail[0]
            bad[-1] |= lead[-1]
        mark = buf == 0x27  # an apostrophe stays in its word, and stands between letters only
        white = (kind == _SPACE) | (kind == _LINE)
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before, after = np.empty(len(buf), np.uint8), np.empty(len(buf), np.uint8)
        before[:1], before[1:] = _BAD, kind[:-1]
        after[-1:], after[:-1] = _BAD, kind[1:]
        before[edge[:-1]], after[edge[1:]] = _BAD, _BAD
        bad |= mark & ((before != _LETTER) | (after != _LETTER))
        if self.mode == "prefixed":  # a space or line end stands alone between other signs
            bad |= white & ((before == _SPACE) | (before == _LINE) | (before == _BAD) | (after == _SPACE) | (after == _LINE) | (after == _BAD))
        return text.per_text(bad, offsets) > 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all texts of a slice, and where each text's start. A null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.mode == "whole" or not len(texts):
            return self.whole(texts.to_pylist())
        buf, offsets = text.flat(texts)
        kind = self.classes[buf]
        uneven = self._uneven(buf, offsets, kind)
        if uneven.any():
            kind[np.repeat(uneven, np.diff(offsets))] = _SPACE
        kind[buf == 0x27] = np.where(kind[buf == 0x27] == _SPACE, _SPACE, _LETTER)
        change = np.ones(len(buf) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[offsets] = True
        at = np.flatnonzero(change)
        starts, ends = at[:-1], at[1:]
        keep = kind[starts] != _SPACE
        starts, ends = starts[keep], ends[keep]
        first = np.searchsorted(starts, offsets)
        if self.mode == "prefixed":
            has = np.zeros(len(starts), bool)
            has[starts > 0] = kind[starts[starts > 0] - 1] == _SPACE
            has[first[:-1][first[:-1] < first[1:]]] = False
            starts = starts - has
        codes, distinct = pd.factorize(text.hashes(buf, starts, ends))
        codes = self._codes(distinct, codes, starts, ends, buf)[codes]
        ids2, ends2 = self.whole([x for x, whole in zip(texts.to_pylist(), uneven, strict=True) if whole] if uneven.any() else [])
        n = len(self.ends) - 1
        ids, stops = np.concatenate((self.ids, ids2)), np.concatenate((self.ends, ends2[1:] + self.ends[-1]))
        counts = np.where(uneven, 1, np.diff(first))
        at = np.concatenate(([0], np.cumsum(counts)))
        if uneven.any():
            spot = np.repeat(uneven, counts)
            every = np.empty(at[-1], np.int64)
            every[~spot], every[spot] = codes, n + np.arange(len(ends2) - 1)
            codes = every
        lengths = stops[codes + 1] - stops[codes]
        begin = np.concatenate(([0], np.cumsum(lengths)))
        return ids[np.repeat(stops[codes] - begin[:-1], lengths) + np.arange(begin[-1])], begin[at]

    def _codes(self, distinct: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> np.ndarray:
        """The kept number of each distinct piece; new ones are encoded now."""
        if len(self.known) > KEPT_PIECES:
            self.clear()
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != distinct[inside]
        if new.any():
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            where = where[new]
            data = buf.tobytes()
            ids, stops = self.whole([data[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            number = len(self.ends) - 1 + np.arange(len(where))
            self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, stops[1:] + self.ends[-1]))
            order = np.argsort(distinct[new])
            put = np.searchsorted(self.known, distinct[new][order])
            self.known, self.code = np.insert(self.known, put, distinct[new][order]), np.insert(self.code, put, number[order])
            spot = np.searchsorted(self.known, distinct)
        return self.code[spot]


def encode_all(path: str, texts: pa.Array | pa.ChunkedArray):
    """(first row, past the last row, ids, where each text's ids start) of runs of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    it = encoder(path)
    for a, b, _, _ in text.slices(texts, SLICE_BYTES):
        yield a, b, *it.encode(texts.slice(a, b - a))

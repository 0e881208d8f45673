"""Small documents for the operators: nulls, empty and long texts, ties, repeated rows, extra columns with odd names."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an on er ti es ou th in ha re sh nd ble st ea ly ing".split()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(r: random.Random, n: int) -> str:
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return "".join(w + ("\n" if r.random() < 0.06 else ". " if r.random() < 0.1 else " ") for w in words).strip()


def changed(r: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = "swapped"
    return " ".join(words)


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, tag, value): near copies, copies and corner cases among prose."""
    r = random.Random(seed)
    texts: list[str | None] = [prose(r, r.randint(30, 200)) for _ in range(n)]
    texts += [changed(r, texts[k], 1) for k in range(12)] + [texts[k] for k in range(6)] + [texts[0]] * 5
    texts += [None, "", "   \n\t", "one", "one two", "one two", prose(r, 6000), "\n".join([texts[1].split("\n")[0]] * 4), "éà ü x\x0by " * 9, "don't stop’s 12.5% ½ | # #"]
    ids: list[int | None] = list(range(len(texts)))
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}", len(t or ""), "tag", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[2], rows[2], (None, texts[3], None, None, None, None, None), (5, texts[4] + " more", "en", "src1", 9, "tag", 1)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, k bigint"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)

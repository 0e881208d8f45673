"""Ops 11, 12 and 13 against brute force: small instances solved exactly, whole tables, and the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from gridwise.llm import bin_completion, importance, queries, tokens, turn_repair

from .fixtures import documents, frame

WORDS = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, end=1):
    return [*tokens.encoder(WORDS).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Bin completion


def fewest(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(items):
            best[0] = len(gaps)
            return
        for k, gap in enumerate(gaps):
            if gap >= items[i] and gap not in gaps[:k]:
                go(i + 1, (*gaps[:k], gap - items[i], *gaps[k + 1 :]))
        go(i + 1, (*gaps, size - items[i]))

    go(0, ())
    return best[0]


def held(packing, size):
    out = Counter()
    for filling, n in packing:
        assert n > 0 and 0 < sum(filling) <= size
        for x in filling:
            out[x] += n
    return out


def test_search_is_exact_on_small_instances():
    r, better = random.Random(1), 0
    for _ in range(400):
        size = r.choice([10, 20, 30, 60])
        counts = Counter(r.randint(1, size) if r.random() < 0.3 else r.randint(max(1, size // 6), size // 2 + 1) for _ in range(r.randint(0, 13)))
        packing, first = (f(dict(counts), size, *more) for f, more in ((bin_completion.solve, (None, None, None)), (bin_completion.best_fit, ())))
        assert held(packing, size) == counts == held(first, size)
        least = fewest(list(counts.elements()), size)
        assert bin_completion.lower_bound(counts, size) <= bin_completion.bins(packing) == least
        better += bin_completion.bins(first) > least
    assert better  # the search matters


def test_fillings_are_the_undominated_ones():
    r = random.Random(4)
    for _ in range(60):
        room, counts = r.randint(5, 25), Counter(r.randint(1, 12) for _ in range(r.randint(1, 7)))
        every = {()}
        for x, c in counts.items():
            every = {(*f, *[x] * k) for f in every for k in range(c + 1) if sum(f) + k * x <= room}
        every = {tuple(sorted(f, reverse=True)) for f in every}

        def dominates(a, b):
            """Whether b's lengths fit into a's as into bins."""
            def go(rest, gaps):
                return not rest or any(g >= rest[0] and go(rest[1:], (*gaps[:k], g - rest[0], *gaps[k + 1 :])) for k, g in enumerate(gaps))
            return a != b and go(b, a)

        free = {b for b in every if not any(dominates(a, b) for a in every)}
        got = list(bin_completion.fillings(counts, room))
        assert set(got) == free and len(got) == len(set(got))
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_large_histograms_use_the_counts_and_never_get_worse():
    values, counts = np.unique(np.random.default_rng(1).integers(500, 2100, 20_000), return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    first = bin_completion.best_fit(histogram, 4096)
    packing = bin_completion.solve(histogram, nodes=2000)
    assert held(packing, 4096) == Counter(histogram) == held(first, 4096)
    assert bin_completion.lower_bound(histogram, 4096) <= bin_completion.bins(packing) <= bin_completion.bins(first)
    thousandfold = {k: c * 1000 for k, c in histogram.items()}
    assert len(bin_completion.best_fit(thousandfold, 4096)) < 8 * len(histogram)


def packed_well(rows, docs, size, end=1):
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence_id"], []).append(r)
    for pieces in inside.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    expected = Counter()
    for doc_id, text in docs:
        ids = ids_of(text, end)
        for k, a in enumerate(range(0, len(ids), size)):
            expected[doc_id, k, a, len(ids[a : a + size]), crc(ids[a : a + size])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    return len(inside)


@pytest.mark.parametrize("size", [64, 4096])
def test_pieces_and_sequences(spark, size):
    rows = documents()
    packed = bin_completion.pack(frame(spark, rows), WORDS, size, with_ids=True).cache()
    n = packed_well(packed.collect(), [(r[0], r[1]) for r in rows], size)
    histogram = Counter(r["length"] for r in packed.collect())
    assert n == bin_completion.bins(bin_completion.solve(histogram, size))
    made = bin_completion.sequences(packed).collect()
    assert len(made) == n
    by_place = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed.collect()}
    for r in made:
        assert bytes(r["ids"]) == b"".join(by_place[r["sequence_id"], d["offset"]] for d in r["documents"]) and len(r["ids"]) == 4 * r["n_tokens"]


def test_packing_an_empty_table(spark):
    assert bin_completion.pack(frame(spark, []), WORDS).collect() == []


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_bin_completion(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = got.collect()
    n = packed_well(rows, docs, 4096)
    assert n == bin_completion.lower_bound(Counter(r["length"] for r in rows), 4096)  # no packing has fewer


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_draw(docs, target, buckets=10_000, grams=1, least=20, percent=10, seed=2024):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(words) - n + 1)]

    own = [(i, *features(x)) for i, x in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    ranked = [(*x[:4], k + 1 if k < percent * len(able) // 100 else None) for k, x in enumerate(able)]
    return Counter(ranked + [(*x[:4], None) for x in out if not x[4]])


@pytest.mark.parametrize(("grams", "percent", "least"), [(1, 10, 20), (3, 55, 0)])
def test_draw_equals_brute_force(spark, grams, percent, least):
    rows = [*documents(), (900, "a" * 70 + " " + "é" * 50 + " x1 Y2 " * 20, None, None, None, None, None)]
    target = spark.createDataFrame([("The an on er ES thing",), (None,), ("",), (documents()[0][1],)], "text string")
    got = importance.resample(frame(spark, rows), target, grams=grams, percent=percent, least=least)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == expected_draw([(r[0], r[1]) for r in rows], [r[0] for r in target.collect()], grams=grams, percent=percent, least=least)


def test_crc_of_spans_of_any_length():
    r = random.Random(2)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 300, 7, 7)]
    buf, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    assert importance.crc32s(buf, ends - [len(p) for p in parts], ends).tolist() == [zlib.crc32(p) for p in parts]


def test_draw_from_nothing(spark):
    nothing, some = frame(spark, []), spark.createDataFrame([("word",)], "text string")
    assert importance.resample(nothing, some).collect() == []
    got = importance.resample(frame(spark), some.filter("false"))
    assert Counter(tuple(r) for r in got.collect()) == expected_draw([(r[0], r[1]) for r in documents()], [])


def test_draw_query(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op12_importance_resampling(spark, sf_dir)
    assert set(dict(got.dtypes).values()) == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == expected_draw([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])


# Conversation repair

STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLE = {"u": "user", "a": "assistant"}


def spaced(v):
    return " " if v is None else str(v)


def expected_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected_repair(turns):
    """All of the contract's columns for one conversation, by going through all edits from the end, with audits as texts."""
    turns = sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3][:64], hashlib.sha256(x[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in turns:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}
    for i in range(len(turns), -1, -1):
        now = {q: (0, "") if i == len(turns) and q in ("", "a") else (math.inf, "") for q in STEPS}
        for q in STEPS if i < len(turns) else ():
            ways = [(best[q][0] + 2, "D" + best[q][1])]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                for letter, cost, roles in (("K", 0, turns[i][2][:1]), ("R", 1, "ua")):
                    ways += [(best[STEPS[q][z]][0] + cost + more, letter + best[STEPS[q][z]][1]) for z in roles if z in STEPS[q]]
            now[q] = min(ways)
        for _ in range(4):
            for q in STEPS:
                now[q] = min([now[q], *((now[STEPS[q][z]][0] + 5, "I" + now[STEPS[q][z]][1]) for z in "ua" if z in STEPS[q])])
        best = now
    cost, audit = best[""]
    q, i, kept = "", 0, []
    for letter in audit:
        role = turns[i][2] if letter in "KD" else ROLE[next(z for z in "ua" if z in STEPS[q])]
        if letter != "D":
            kept.append((letter, role, "" if letter == "I" else turns[i][3]))
            q = STEPS[q][role[:1]]
        i += letter != "I"
    assert i == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in kept))
    numbers = [t[1] for t in turns if t[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in kept).encode()).hexdigest()), kept


def grouped(rows, every):
    out = {c: [] for c in every}
    for r in rows:
        out[r[0]].append(r)
    return out


def random_turns(seed):
    r = random.Random(seed)
    return [(c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"]), r.choice(["Hi.", "Yes", "no!", "ok?", "", " \t", None, "x y.", "é.", f"{t}."])) for c in (None, *range(30)) for t in range(r.randint(0, 30))]


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize(("seed", "block_rows"), [(0, 4096), (1, 1), (2, 3), (3, 7)])
def test_repair_equals_brute_force(spark, seed, block_rows):
    rows = random_turns(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    expected = {c: expected_repair(x)[0] for c, x in grouped(expected_damage(rows), {r[0] for r in rows}).items()}
    got = turn_repair.digests(turn_repair.damaged(df), df, block_rows).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_repaired_turns(spark, block_rows):
    rows = [(c, t, spaced(role), spaced(x)) for c, t, role, x in random_turns(9)]
    expected = {c: expected_repair(x)[1] for c, x in grouped(rows, {r[0] for r in rows}).items()}
    got = turn_repair.repaired(spark.createDataFrame(random_turns(9), TURNS).repartition(3), block_rows).collect()
    assert {c: x for c, x in expected.items() if x} == {c: [tuple(r)[2:] for r in sorted(x, key=lambda r: r["place"])] for c, x in grouped(got, {r[0] for r in got}).items()}


def test_one_long_conversation_over_many_parts(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", f"{t}.", f"{t}!"])) for t in range(3000)]
    df = spark.createDataFrame(rows, TURNS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert turn_repair.placed(df, 50).select("part").distinct().count() > 1
        assert [tuple(x)[1:] for x in turn_repair.digests(df, block_rows=50).collect()] == [expected_repair(rows)[0]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_nothing_and_of_lost_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.digests(none).collect() == []
    lost = spark.createDataFrame([(1,), (None,)], "conv_id bigint")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r)[1:] for r in turn_repair.digests(none, lost).collect()) == [(0, 0, 0, 0, 0, 0, "", empty)] * 2


def test_distances_equal_relaxation():
    r = random.Random(6)
    for _ in range(200):
        codes = bytes(r.choice([0, 1, 2, 3, 4, 5, 8, 9, 10, 11]) for _ in range(r.randint(0, 8)))
        goal = r.choice([turn_repair.AT_END, (3, 0, 9, turn_repair.NEVER), (turn_repair.NEVER, turn_repair.NEVER, 4, turn_repair.NEVER)])
        dist = [turn_repair.NEVER] * (4 * (len(codes) + 1))
        dist[4 * len(codes) :] = goal
        for _ in range(len(dist) + 1):
            for node in range(len(dist)):
                at, q = divmod(node, 4)
                ways = [dist[node], 5 + dist[4 * at + turn_repair.NEXT[q]]]
                if at < len(codes):
                    ways += [cost + dist[4 * (at + 1) + to] for to in range(4) for p, cost in turn_repair._ARCS[codes[at]][to] if p == q]
                dist[node] = min(ways)
        assert turn_repair.distances(codes, goal) == [d if d < turn_repair.NEVER else turn_repair.NEVER for d in dist]


def test_repair_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = {c: expected_repair(x)[0] for c, x in grouped(expected_damage(rows), {r[0] for r in rows}).items()}
    got = queries.op13_conversation_repair(spark, sf_dir)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected


def test_row_groups_of_the_matrix_are_small(spark):
    """Spark decodes up to 4,096 rows of a row group at once, here blocks of a quarter of a megabyte of text."""
    words = "concat_ws(' ', transform(sequence(1, 700), k -> substring(sha2(concat(id, ' ', k), 256), 1, 7)))"
    blocks = importance.matrix(spark.range(6000).coalesce(1).selectExpr("id as doc_id", f"{words} as text"))
    files = Path(blocks._scratch.removeprefix("file://")).glob("*.parquet")
    groups = [m.row_group(k) for m in (pq.ParquetFile(f).metadata for f in files) for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == blocks.count() > 100
    assert max(g.total_byte_size for g in groups) < 6 << 20
    assert blocks.selectExpr("sum(size(doc_ids))").first()[0] == 6000

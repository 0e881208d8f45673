"""Op 1 and op 8, and what they share, against brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridwise.llm import jaccard, lines, minhash, queries, text
from gridwise.llm.components import components

from .fixtures import changed, documents, frame, prose, words_of


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def similar(sets, threshold=0.8):
    return [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]


def word_sets(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def expected_join(rows):
    texts = sorted({r[1] or "" for r in rows})
    pairs = similar(word_sets(texts))
    cls = classes(len(texts), pairs)
    at = {t: k for k, t in enumerate(texts)}
    least = defaultdict(list)
    for r in rows:
        least[cls[at[r[1] or ""]]].append(r[0])
    names = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    degree = defaultdict(int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    copies = defaultdict(int)
    for r in rows:
        copies[r[1] or ""] += 1
    return sorted((str(r[0]), str(names[cls[at[r[1] or ""]]]), degree[at[r[1] or ""]], copies[r[1] or ""] - 1) for r in rows)


def test_join_equals_brute_force(spark):
    rows = documents()
    got = jaccard.join(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_copies"]) for r in got) == expected_join(rows)


def test_join_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_ngram_jaccard_join(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"], r["n_copies"]) for r in got) == expected_join(rows)


def test_keep_one_leaves_one_of_each_class(spark):
    rows = documents()
    df = frame(spark, rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    every = {x[1] for x in expected_join(rows)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(every)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert jaccard.join(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0
    assert lines.dedup(empty, "gone").count() == 0


def test_chunks_find_the_same_links(spark):
    r = random.Random(5)
    base = prose(r, 120)
    texts = [changed(r, base, k % 6) for k in range(40)]
    df = spark.createDataFrame([(k, 1, 116, t) for k, t in enumerate(texts)], "node bigint, comp bigint, weight bigint, text string")
    pairs = similar(word_sets(texts))
    degree = [0] * len(texts)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    for most in (10**6, 600):
        counts, labels = minhash.links(df, jaccard.shingles, 0.8, most)
        got = {x["node"]: x["links"] for x in counts.collect()}
        assert [got.get(k, 0) for k in range(len(texts))] == degree
        cls = classes(len(texts), pairs)
        assert {x["node"]: x["label"] for x in labels.collect()} == {k: cls[k] for k in range(len(texts)) if degree[k]}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    cls = classes(500, pairs)
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: cls[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("module", "make"), [(jaccard, minhash.minima), (lines, minhash.minima_of_one)])
def test_bands_reach_their_recall(module, make):
    """Pairs just at the threshold: with the bands chosen, nearly all share one."""
    r = random.Random(9)
    texts = []
    while len(texts) < 800:
        a = prose(r, 60).replace("\n", " ")
        b = changed(r, a, r.randint(1, 3))
        keys, begin = module.shingles(*text.flat(pa.array([a, b])))
        x, y = set(keys[begin[0] : begin[1]].tolist()), set(keys[begin[1] : begin[2]].tolist())
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            texts += [a, b]
    keys, begin = module.shingles(*text.flat(pa.array(texts)))
    got = minhash.band_keys(make(keys, begin, module.BANDS * module.ROWS), module.BANDS, module.ROWS)
    assert np.mean((got[::2] == got[1::2]).any(axis=1)) >= 0.99


def expected_lines(rows):
    where = defaultdict(list)
    for row, (i, t) in enumerate((r[0], r[1]) for r in rows):
        for k, line in enumerate((t or "").split("\n")):
            if words_of(line):
                where[line].append((i is None, i or 0, row, k))
    keys = sorted(where)
    sets = [{x[j : j + 7] for j in range(len(x) - 6)} or {x} for x in keys]
    cls = classes(len(keys), similar(sets))
    groups = defaultdict(list)
    for k, line in enumerate(keys):
        groups[cls[k]] += where[line]
    gone = defaultdict(set)
    for places in groups.values():
        for _, _, row, k in sorted(places)[1:]:
            gone[row].add(k)
    return gone


def test_lines_equal_brute_force(spark):
    rows = [x for x in documents(n=25) if x[0] != 5]  # of two documents with one id, which comes first is by hash
    gone = expected_lines(rows)
    df = frame(spark, rows)
    got = lines.dedup(df, "gone")
    assert got.columns == [*df.columns, "gone"]
    found = got.collect()
    assert len(found) == len(rows)
    texts = sorted("null" if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[n]) for n, r in enumerate(rows))
    assert sorted("null" if r["text"] is None else r["text"] for r in found) == texts
    assert sum(len(r["gone"]) for r in found) == sum(map(len, gone.values())) > 20


def test_short_lines_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b\na b"), (2, None), (3, ""), (4, "a b"), (6, "見る\n\n \n読むものはここにあります。"), (7, "x\n読むものはここにあります。\n "), (8, "own\nx"), (8, "own\nx")], "doc_id bigint, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["text"]) for r in lines.dedup(df).collect()), key=str)
    assert got == [(1, "a b"), (2, None), (3, ""), (4, ""), (6, "見る\n\n \n読むものはここにあります。"), (7, "x\n "), (8, ""), (8, "own")]
    short = spark.createDataFrame([(1, "a b\na b"), (2, None), (3, ""), (4, "a b")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in jaccard.join(short).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_columns_named_like_the_operators_own(spark):
    names = ["_digest", "_key", "_k", "_d", "_id", "_gone", "_removed", "class", "best", "doc", "row", "id", "lines", "node", "label", "salt"]
    rows = [(k, "one two three four five six\nseven eight" if k < 2 else f"text {k}", *range(len(names))) for k in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for out, n in ((lines.dedup(df), 4), (jaccard.keep_one(df), 3)):
        assert out.columns == df.columns
        assert [tuple(r)[2:] for r in out.collect()] == [tuple(range(len(names)))] * n


def test_one_group_of_very_many_copies(spark):
    """A hub of a union-find and a common line are dealt over many tasks."""
    pairs = [(k, 0) for k in range(1, 3000)] + [(k, k - 1) for k in range(3001, 3010)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(3000)} | {k: 3000 for k in range(3000, 3010)}
    df = spark.range(2000).selectExpr("id as doc_id", "concat('the same line of all\nown ', id * 7919, ' and ', sha2(string(id), 256)) as text")
    got = {r["doc_id"]: r["gone"] for r in lines.dedup(df, "gone").collect()}
    assert got == {k: [0] if k else [] for k in range(2000)}


def test_union_find_takes_few_stages(spark):
    """The work of a round is one shuffle, and rows that are left meet: not ten shuffles a round, whatever is left."""
    pairs = [(k, k + 1) for k in range(60)]
    random.Random(3).shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(8)
    spark.sparkContext.setJobGroup("union-find", "stages of the union-find")
    try:
        assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(61)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    assert sum(len(told.getJobInfo(j).stageIds) for j in told.getJobIdsForGroup("union-find")) < 50


def test_few_and_many_sets_are_compared_alike(spark):
    """Small groups are counted at once, larger ones set by set, by bits or by keys: the same pairs as one by one."""
    r = random.Random(8)
    texts, at = [], [0]
    for n in (2, 1, 5, 16, 17, 40, 3):
        base = prose(r, 30).replace("\n", " ")
        texts += [changed(r, base, k % 4) for k in range(n)]
        at.append(len(texts))
    keys, begin = lines.shingles(*text.flat(pa.array(texts)))
    sets = [set(keys[a:b].tolist()) for a, b in itertools.pairwise(begin.tolist())]
    x, y = minhash.few_linked(keys, begin, np.array(at), 0.8)
    small = [(a + i, a + j) for a, b in itertools.pairwise(at) if b - a <= minhash.FEW for i, j in similar(sets[a:b])]
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(small) and small
    once = minhash.distinct_sets(keys, begin)
    wide = minhash.distinct_sets(np.concatenate((keys, np.repeat(np.arange(9000, dtype=np.uint64), 2))), np.append(begin, [begin[-1] + 9000, begin[-1] + 18000]))
    for got in (once, wide):
        pairs = {(i, j) for i, others in minhash.linked(got, np.zeros(len(got[1]) - 1, np.int64), False, 0.8) for j in others.tolist() if i < j and j < len(texts)}
        assert pairs == set(similar(sets))


def test_a_large_group_takes_no_bit_for_each_key(monkeypatch):
    """What a group's sets share with few others is counted pair by pair; a bit for each such key and pair of sets made large groups slow."""
    r = random.Random(12)
    bases = [[f"w{k}{j}" for j in range(60)] for k in range(2)]
    swaps = [[f"own{k}" for k in range(400)] for _ in range(60)]
    texts = []
    for k in range(300):
        words = list(bases[k % 2][: 60 - k % 7])
        for _ in range(k % 14):
            j = r.randrange(len(words))
            words[j] = r.choice(swaps[j])
        texts.append(" ".join(words))
    keys, begin = minhash.distinct_sets(*lines.shingles(*text.flat(pa.array(texts))))
    pairs = similar([set(keys[a:b].tolist()) for a, b in itertools.pairwise(begin.tolist())])
    words, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: words.append(x.size) or count(x))
    side = np.arange(300) % 3
    for across in (False, True):
        found = sorted((i, j) for i, others in minhash.linked((keys, begin), side, across, 0.8) for j in others.tolist())
        wanted = [(a, b) for a, b in pairs if not (across and side[a] == side[b])]
        assert found == sorted(wanted + [(b, a) for a, b in wanted]) and wanted
    assert sum(words) < 2 * 300 * 300 * 20


def test_lines_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    gone, texts = expected_lines(rows), dict(rows)
    row = {r[0]: k for k, r in enumerate(rows)}
    for r in queries.op8_fuzzy_line_dedup(spark, sf_dir).collect():
        parts = texts[r["doc_id"]].split("\n")
        expected = sorted(gone[row[r["doc_id"]]])
        assert (r["n_lines"], r["n_removed"], r["removed"]) == (len(parts), len(expected), expected)
        assert r["kept_crc32"] == zlib.crc32("\n".join(x for k, x in enumerate(parts) if k not in expected).encode())

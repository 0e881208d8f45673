"""Ops 7 and 10 and the tokenizer kernel: exact round trips; and the pipeline, stage by stage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from gridwise.llm import content_store, cotraining, decontamination, packing, queries, scratch, tokens

from .fixtures import documents, frame, prose

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  two  spaces ", "tab\tand\nline\n\nend ", "don't can't 'quote'", "naïve Élan ß × ÷ ½", "日本語 text", "<|endoftext|> x", "a|b||c", "1234 5.6", "MiXeD Case", "\x00\x7f", "x" * 3000, "emoji 😀 é"]


def plain(path, texts):
    t = tokens.encoder(path).tokenizer
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_kernel_equals_the_library(path, spark, sf_dir):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(120).collect()]
    got = []
    for _, _, ids, at in tokens.encode_all(path, pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == plain(path, texts)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark):
    rows = documents()
    path = scratch.folder(spark, "test")
    content_store.write(frame(spark, rows), path, BYTES)
    expected = sorted(((-1 if r[0] is None else r[0], crc([*ids, 2])) for r, ids in zip(rows, plain(BYTES, [r[1] for r in rows]), strict=True)))
    got = sorted(content_store.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(x[0] for x in expected)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == expected
    assert all(r["verified"] for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert sorted(crc(r["ids"]) for r in content_store.read(spark, path).collect()) == sorted(x[1] for x in expected)
    assert content_store.verify(spark, path).count() == 0
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for r, d, ids in zip(queries.op7_content_store(spark, sf_dir).orderBy("doc_id").collect(), docs, plain(BYTES, [d["text"] for d in docs]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids) + 1, crc([*ids, 2]))
        start += len(ids) + 1


def test_a_changed_recipe_is_found(spark):
    rows = [(k, f"text number {k} " * (k + 1)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    path, other = scratch.folder(spark, "test"), scratch.folder(spark, "test")
    content_store.write(df, path, BYTES)
    content_store.write(df, other, BYTES)
    assert content_store.root(spark, path) == content_store.root(spark, other) != None  # noqa: E711
    assert all(r["verified"] for r in content_store.digests(spark, path).collect())
    recipes = spark.read.parquet(f"{path}/recipes")
    first = recipes.filter("doc_id = 0").first()["chunks"][0]["digest"]
    changed = recipes.withColumn("chunks", F.when(F.col("doc_id") == 7, F.transform("chunks", lambda c: F.struct(F.lit(first).alias("digest"), c["n"].alias("n")))).otherwise(F.col("chunks")))
    moved = scratch.table(changed, "test").collect()
    spark.createDataFrame(moved, recipes.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    bad = content_store.verify(spark, path).collect()
    assert [r["level"] for r in bad] == [1]
    part = next(r["part"] for r in moved if r["doc_id"] == 7)
    assert {r["doc_id"] for r in content_store.digests(spark, path).collect() if not r["verified"]} == {r["doc_id"] for r in moved if r["part"] == part}


def test_store_of_nothing(spark):
    path = scratch.folder(spark, "test")
    content_store.write(frame(spark, []), path, BYTES)
    assert content_store.digests(spark, path).count() == 0


def check_packing(pieces, expected):
    """expected: (doc_id, ids with the end) of all documents; doc_ids are distinct."""
    ids = dict(expected)
    for name, all_ids in ids.items():
        own = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces if p["doc_id"] == name)
        at = 0
        for start, length, c, n in own:
            assert (start, c, n) == (at, crc(all_ids[at : at + length]), len(all_ids))
            at += length
        assert at == len(all_ids)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    waste = sum(0 if n & (n - 1) == 0 else packing.SIZE - n for n in filled.values())
    assert max(filled.values()) <= packing.SIZE
    return waste / sum(filled.values())


def test_packing(spark, sf_dir):
    rows = [r for r in documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    pieces = packing.pack(frame(spark, rows), WORDS).collect()
    assert check_packing(pieces, [(r[0], [*ids, 2]) for r, ids in zip(rows, plain(WORDS, [r[1] for r in rows]), strict=True)]) < 0.01
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    pieces = queries.op10_sum_of_squares_packing(spark, sf_dir).collect()
    assert check_packing(pieces, [(d["doc_id"], [*ids, 2]) for d, ids in zip(docs, plain(WORDS, [d["text"] for d in docs]), strict=True)]) < 0.01
    assert packing.pack(frame(spark, []), WORDS).count() == 0


def test_what_tasks_leave_open_is_placed_by_the_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(8)
    pieces = packing.pack(docs, WORDS)
    tokens_ = {r["by_rule"]: r["n"] for r in pieces.groupBy("by_rule").agg(F.sum("length").alias("n")).collect()}
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).filter("n <> m").count() == 0
    assert tokens_[True] > 5 * tokens_[False]  # of each task alone, less than half


def test_rounds_end_over_any_number_of_tasks(spark, monkeypatch):
    rows = [(k, prose(random.Random(k), 30 + k % 50)) for k in range(300)]
    docs, deal, rounds = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20), type(spark.range(1)).repartition, []

    def wider(df, n, *by):
        """A cluster that deals by a key over 32 tasks at least."""
        rounds.append(n)
        assert len(rounds) < 5
        return deal(df, max(n, 32), *by)

    monkeypatch.setattr(type(docs), "repartition", wider)
    pieces = packing.pack(docs, WORDS).collect()
    assert rounds == [3, 1]
    assert check_packing(pieces, [(k, [*ids, 2]) for (k, _), ids in zip(rows, plain(WORDS, [t for _, t in rows]), strict=True)]) < 0.01


def test_sum_of_squares_level_is_the_best():
    r = np.random.default_rng(3)
    p = packing.Packer(32)
    for k in range(3000):
        n = int(r.integers(1, 31))
        count = p.count.copy()

        def cost(h, count=count, n=n):
            c = count.copy()
            c[h] -= h > 0
            if h + n < 32:
                c[h + n] += 1
            return int((c[1:] ** 2).sum())

        levels = [h for h in range(0, 33 - n) if h == 0 or count[h]]
        assert cost(p.level(n)) == min(map(cost, levels))
        p.add((k, n), np.zeros(n, np.int32))


def test_pipeline_stages(spark):
    from .test_near_duplicates import expected_join, expected_lines

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = scratch.table(stage(spark, docs, sf_dir), "test")
        after = docs.collect()
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name == "quality_classifier":
            got = cotraining.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in got.filter("kept").collect()}
        elif name == "line_dedup":
            gone = expected_lines(rows)
            assert {r["doc_id"]: r["text"] for r in after} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n]) for n, (i, t) in enumerate(rows)}
            assert all(r["n_chars"] == len(r["text"]) for r in after if gone[[i for i, _ in rows].index(r["doc_id"])])
        elif name == "ngram_jaccard":
            assert sorted(str(r["doc_id"]) for r in after) == sorted({x[1] for x in expected_join(rows)})
        elif name == "decontamination":
            hit = {r["doc_id"] for r in decontamination.overlaps(spark.createDataFrame(before), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in after} == {i for i, _ in rows} - hit
        else:
            assert check_packing(after, [(i, [*ids, 2]) for (i, _), ids in zip(rows, plain(WORDS, [t for _, t in rows]), strict=True)]) < 0.01
        if name != "packing":
            assert docs.columns == columns
        seen.append(len(after))
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_long_text(spark):
    import random

    text = prose(random.Random(1), 40000)
    pieces = packing.pack(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), WORDS).collect()
    check_packing(pieces, [(1, [*plain(WORDS, [text])[0], 2])])

"""Distributed union-find: connected components of an edge table by contraction.

In each round every task joins the edges that it holds and tells each node its root there, the node of best priority (a hash that is
another in each round). A node's roots meet in one task: a node that is a root nowhere is settled below one of them, and its roots are
joined with each other; edges between roots go on to the next round. So a round is one shuffle, a node has a row for each task at
most however many edges it has, and only roots stay open: pairs and groups that meet in one task end in the first round, and of a
path a third of the nodes or more goes in each. The open node of worst priority is never a root, so the rounds end. Then labels go
down from the last round's nodes to the first's. What a round leaves is written, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, text
from .workers import lean

#: Tasks that one key's rows may be dealt over.
SALTS = 64
#: Edges that a task joins at once.
EDGES = 1 << 20
#: Rows that are left after a round, for each task of the next one.
LEFT = 1 << 14
ROWS = "a bigint, b bigint, open boolean"


def with_least(rows: DataFrame, key: str, value: str | Column, name: str, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with the least ``value`` of all rows of the same ``key``; ``by``: columns that tell a key's rows apart."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias(name))
    whole = parts.groupBy(key).agg(F.min(name).alias(name), F.collect_list("_salt").alias("_salts"))  # SALTS at most
    return salted.join(whole.select(key, name, F.explode("_salts").alias("_salt")), [key, "_salt"]).drop("_salt")


def least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place of the component of each of ``n`` places, joined by edges (u, v)."""
    root = np.arange(n)
    while len(u):
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        left = root[u] != root[v]
        u, v = u[left], v[left]
    return root


def _forest(a: np.ndarray, b: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their roots): the node of best priority in this round of each component of these edges."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.argsort(text.mix(nodes.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    return nodes[order], nodes[order][least(len(nodes), place[code[: len(a)]], place[code[len(a) :]])]


def _rows(a: np.ndarray, b: np.ndarray, open_: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), open_))], ["a", "b", "open"])


def _chunks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """a and b of about EDGES rows; with ``whole``, rows come sorted by a and those of one a stay together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= EDGES:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.searchsorted(a, a[-1]) if whole else len(a)
            if cut:
                yield a[:cut], b[:cut]
            held, size = [(a[cut:], b[cut:])], len(a) - cut
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _begin(batches):
    """Each task's nodes with their roots there."""
    for a, b in _chunks(batches, False):
        apart = a != b
        yield _rows(*_forest(a[apart], b[apart], 0), True)


def _meet(turn: int):
    """A node's roots of all tasks meet: (node, a root, not open) of the settled, and what the next round begins with."""

    def run(batches):
        for a, b in _chunks(batches, True):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[new], b[new]
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            size = np.diff(np.append(first, len(a)))
            rooted = np.logical_or.reduceat(a == b, first)
            yield _rows(a[first][~rooted], b[first][~rooted], False)
            # A root is joined with its other roots, a settled node's roots with the first of them.
            to = np.repeat(np.where(rooted, a[first], b[first]), size)
            apart = b != to
            yield _rows(*_forest(b[apart], to[apart], turn + 1), True)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of ``edges`` (a, b: bigint); loops count for nothing.

    A written table, which the caller may drop."""
    dealt, rounds = edges.select("a", "b").mapInArrow(lean(_begin), ROWS).repartition("a"), []
    while True:
        rounds.append(scratch.table(dealt.sortWithinPartitions("a").mapInArrow(lean(_meet(len(rounds))), ROWS), "edges"))
        now = rounds[-1].filter("open")
        if not (rows := now.count()):
            break
        # The fewer rows are left, the fewer tasks share them, so more of them meet.
        dealt = now.repartition("a").coalesce(math.ceil(rows / LEFT))
    known: list[DataFrame] = []
    for r in reversed(rounds):
        own = r.filter("not open").select(F.col("a").alias("node"), F.col("b").alias("up"))
        if known:
            above = reduce(DataFrame.unionByName, known).select(F.col("node").alias("up"), "label")
            own = own.join(above, "up", "left").select("node", F.coalesce("label", "up").alias("label"))
        known.append(scratch.table(own.select("node", F.col("label" if known else "up").alias("label")), "labels"))
    scratch.drop(*rounds)
    # Every node but the last roots has a row; names are the least nodes.
    every = reduce(DataFrame.unionByName, known)
    names = scratch.table(every.groupBy("label").agg(F.least(F.min("node"), F.col("label")).alias("name")), "names")
    named = every.join(names, "label").select("node", F.col("name").alias("label"))
    out = scratch.table(named.unionByName(names.select(F.col("label").alias("node"), F.col("name").alias("label"))), "labels")
    scratch.drop(names, *known)
    return out

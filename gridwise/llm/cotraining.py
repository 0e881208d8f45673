"""Quality classifier by co-training: one classifier reads the text, another the page's metadata.

Two logistic regressions are fitted on at most ``LABELLED`` labelled documents, chosen by a hash of doc_id (whole texts).
In each of ``ROUNDS`` rounds either view scores all unlabelled documents, and its ``PER_ROUND`` most confident of both
classes join the other view's training rows with those pseudo-labels. Features are scaled by the means of all documents;
of each metadata column the ``VALUES`` most frequent values of all documents have an indicator, others share ``SHARED``. Labelled rows kept aside then
calibrate each view (Platt scaling) and weigh the two log-odds into one score, with which every document is scored; there the
classes weigh what they do among all labelled documents, so the bound on fitted rows doesn't move the threshold.

The same is done for each of two targets: ``quality``, and, if the labels have such a column, ``toxic``. A document is
kept if its quality score reaches the threshold and its toxic score doesn't. Beside shares of characters and words, the
text view sees which of the ``TELLING`` words of each target a text holds: those whose presence in the labelled
documents is tied closest (chi-square) to the label.

Features are extracted once, into a table, which every round reads; a task sends on its own most confident documents only.
The regressions are fitted on the driver, over at most ``LABELLED`` + ``ROUNDS`` * ``PER_ROUND`` rows and a few for rounding.

Defined results: a null or empty text has text features of zero; null metadata is a category of its own; labels that are
null, or whose document is missing, aren't used; a doc_id labelled twice counts with its lowest label; without labels of
both classes every document is kept with the score 1.0, and toxic with the score 0.0; an empty table gives no rows; other columns pass through ``keep``.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text
from .workers import lean

LABELLED = 4000
ROUNDS, PER_ROUND = 5, 200
VALUES, SHARED = 256, 32
THRESHOLD = 0.5
BUCKETS = 64
#: Rows of the table of features that a task scores at once.
PIECE = 2048
#: Words of a target that the text view looks for, and labelled documents that hold such a word at least.
TELLING, LEAST_DOCS = 128, 5
#: Least chi-square of such a word; about 1 of 10,000 words without any tie exceeds it.
LEAST_TIE = 15.0
SCHEMA = "doc_id bigint, text_score double, page_score double, score double, toxic_score double, kept boolean"

_CLASS = np.zeros((256, 8), bool)
_CLASS[range(97, 123), 0] = True
_CLASS[range(65, 91), 1] = True
_CLASS[range(48, 58), 2] = True
_CLASS[list(b".!?"), 3] = True
_CLASS[list(b",;:"), 4] = True
_CLASS[list(b"#*$%&|<>"), 5] = True
_CLASS[0x0A, 6] = True
_CLASS[range(0x80, 256), 7] = True


def text_features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: shares of character classes, word lengths, repetition, and hashed word shares."""
    n = len(offsets) - 1
    starts, ends, first = text.words(buf, offsets)
    words, doc = np.diff(first), text.owner(first)
    size = np.maximum(np.diff(offsets), 1)
    cols = [np.diff(np.concatenate(([0], np.cumsum(_CLASS[buf, k])))[offsets]) / size for k in range(8)]
    many = np.maximum(words, 1)
    length = ends - starts
    cols += [np.log1p(words) / 10, text.per_text(length, first) / many / 10, text.per_text(np.minimum(length, 50) ** 2, first) / many / 100]
    h = text.hashes(buf, starts, ends, True)
    # Words that differ, of all of a text: sorting by text first keeps each text's words together.
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    cols.append(text.per_text(fresh, first) / many)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    cols.append(text.per_text(same, first) / many)
    lone = np.zeros(len(h), bool)  # words without a letter
    lone[:] = (length == 1) & _CLASS[buf[starts], 5] if len(h) else False
    cols.append(text.per_text(lone, first) / many)
    bag = np.bincount(doc * BUCKETS + (h >> np.uint64(58)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) / many[:, None]
    return np.column_stack([*cols, bag])


def present(buf: np.ndarray, offsets: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """A row per text: which of the words, by ascending hash, it holds."""
    out = np.zeros((len(offsets) - 1, len(telling)), bool)
    starts, ends, first = text.words(buf, offsets)
    if len(telling) and len(starts):
        h = text.hashes(buf, starts, ends, True)
        at = np.minimum(np.searchsorted(telling, h), len(telling) - 1)
        hit = telling[at] == h
        out[text.owner(first)[hit], at[hit]] = True
    return out


class Scaler:
    def __init__(self, mean: np.ndarray, sd: np.ndarray) -> None:
        self.mean, self.sd = mean, sd + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -6, 6)


class Logistic:
    """Ridge-penalised logistic regression by Newton steps; ``share``: what the rows of class 1 weigh of all."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 5.0, steps: int = 25, share: float = 0.5) -> None:
        x = np.column_stack([x, np.ones(len(x))])
        weight = len(y) * np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(x @ w)
            slope = x.T @ (weight * (p - y)) + penalty * w
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Pages:
    """Metadata as numbers: indicators of the values, by column, shared ones of all other values, and the length in five steps."""

    def __init__(self, values: dict[str, list[str]], length: str | None) -> None:
        self.names, self.length, self.values = list(values), length, values

    def __call__(self, rows: pd.DataFrame) -> np.ndarray:
        cols = [np.ones(len(rows))]
        for c in self.names:
            # Each distinct value of a batch is looked up once.
            codes, distinct = pd.factorize(rows[c].astype("object"))
            own = {v: k for k, v in enumerate(self.values[c])}
            most, size = len(own), len(own) + 1 + (SHARED if len(own) == VALUES else 0)
            to = [own.get(str(v), most + 1 + zlib.crc32(str(v).encode()) % SHARED if len(own) == VALUES else size) for v in distinct]
            cols.append(np.eye(size + 1)[np.array([*to, most])[codes]][:, :size])
        if self.length:
            n = np.log1p(pd.to_numeric(rows[self.length], errors="coerce").fillna(0).clip(lower=0).to_numpy(float))
            cols += [n / 10] + [(n > k).astype(float) for k in (4, 5, 6, 7, 8)]
        return np.column_stack(cols)


class Model:
    """Both views, their calibration and their weights. ``good``: the share of class 1 among all labelled documents."""

    def __init__(self, rows: pd.DataFrame, every: DataFrame, pages: Pages, scale: list[Scaler], telling: np.ndarray, good: float, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> None:
        self.pages, self.scale, self.telling = pages, scale, telling
        rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
        y = rows["label"].to_numpy(float)
        self.ready = 0 < y.sum() < len(y)
        if not self.ready:
            return
        aside = np.arange(len(rows)) % 4 == 3
        if min(y[aside].sum(), (1 - y[aside]).sum()) == 0 or not 0 < y[~aside].sum() < (~aside).sum():
            aside[:] = False
        views = self.scaled(_numbers(rows, telling), rows)
        train = [v[~aside] for v in views]
        known = [y[~aside], y[~aside]]
        taken: list[set[int]] = [set(), set()]  # pseudo-labelled, by view
        share = y[~aside].mean()
        most = max(1, round(per_round * (1 - share))), max(1, round(per_round * share))  # of each class, a round
        for step in range(rounds + 1):
            self.views = [Logistic(v, labels) for v, labels in zip(train, known, strict=True)]
            if step == rounds:
                break
            more = _confident(every, self, taken, most)
            for k in (0, 1):
                part = more[more["view"] == k]
                if len(part):
                    train[1 - k] = np.vstack([train[1 - k], self.scaled(_numbers(part, telling), part)[1 - k]])
                    known[1 - k] = np.concatenate([known[1 - k], part["good"].to_numpy(float)])
                    taken[1 - k] |= set(part["doc_id"].tolist())
        held = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
        z = np.column_stack([m(v[held]) for m, v in zip(self.views, views, strict=True)])
        self.platt = [Logistic(z[:, [k]], y[held], 1e-2, share=good) for k in (0, 1)]
        z = np.column_stack([p(z[:, [k]]) for k, p in enumerate(self.platt)])
        self.joint = Logistic(z, y[held], 1e-2, share=good)

    def scaled(self, x: np.ndarray, rows: pd.DataFrame) -> list[np.ndarray]:
        """Both views' numbers."""
        return [s(v) for s, v in zip(self.scale, (x, self.pages(rows)), strict=True)]

    def __call__(self, x: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, page and joint scores."""
        if not self.ready:
            one = np.ones(len(rows))
            return one, one, one
        z = [p(m(s(v))[:, None]) for p, m, s, v in zip(self.platt, self.views, self.scale, (x, self.pages(rows)), strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.joint(np.column_stack(z)))


def _bits(packed: list[bytes], telling: np.ndarray) -> np.ndarray:
    wide = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), (len(telling) + 7) // 8)
    return np.unpackbits(wide, axis=1)[:, : len(telling)]


def _numbers(rows: pd.DataFrame, telling: np.ndarray) -> np.ndarray:
    """Text features of rows of the table of features."""
    return np.column_stack([np.array(rows["x"].tolist(), float), _bits(list(rows["w"]), telling)])


def _read(batches, telling: np.ndarray):
    """Text features and the other columns of the table of features, ``PIECE`` rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            batch = whole.slice(at, PIECE)
            x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            bits = _bits(batch.column(batch.schema.get_field_index("w")).to_pylist(), telling)
            yield np.column_stack([x.reshape(batch.num_rows, -1), bits]), batch.select([c for c in batch.schema.names if c not in ("x", "w")]).to_pandas()


def _moments(every: DataFrame, pages: Pages, telling: np.ndarray) -> list[Scaler]:
    """Scalers of both views by all documents."""

    def add(batches):
        for x, rows in _read(batches, telling):
            for k, v in enumerate((x, pages(rows))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(v.shape[1], k), pa.int32()), pa.array(np.arange(v.shape[1]), pa.int32()), pa.array(np.full(v.shape[1], float(len(v)))), pa.array(v.sum(0)), pa.array((v**2).sum(0))], ["view", "at", "n", "s", "q"])

    got = every.mapInArrow(lean(add), "view int, at int, n double, s double, q double").groupBy("view", "at").agg(*(F.sum(c).alias(c) for c in "nsq")).toPandas().sort_values("at")  # a row for each feature
    out = []
    for k in (0, 1):
        n, s, q = (got.loc[got["view"] == k, c].to_numpy() for c in "nsq")
        out.append(Scaler(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))))
    return out


def _confident(every: DataFrame, model: Model, taken: list[set[int]], most: tuple[int, int]) -> pd.DataFrame:
    """view, good, doc_id and features of the documents, among all unlabelled ones, that each view is surest of."""
    free = every.filter("label = -1 and doc_id is not null")
    gone = [np.array(sorted(x), np.int64) for x in taken]

    def best(batches):
        found = {(k, good): pd.DataFrame({"doc_id": np.zeros(0, np.int64), "rank": np.zeros(0)}) for k in (0, 1) for good in (0, 1)}
        for x, rows in _read(batches, model.telling):
            ids = rows["doc_id"].to_numpy(np.int64)
            for k, v in enumerate(model.scaled(x, rows)):
                z = model.views[k](v)
                new = ~np.isin(ids, gone[1 - k])
                for good, rank in ((0, z), (1, -z)):
                    sure = new & (sigmoid(rank) < 0.1)
                    both = pd.concat([found[k, good], pd.DataFrame({"doc_id": ids[sure], "rank": rank[sure]})])
                    found[k, good] = both.sort_values(["rank", "doc_id"]).drop_duplicates("doc_id").head(most[good])
        for (k, good), x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int32()), pa.array(np.full(len(x), good), pa.int32()), pa.array(x["doc_id"].to_numpy()), pa.array(x["rank"].to_numpy())], ["view", "good", "doc_id", "rank"])

    sure = scratch.table(free.mapInArrow(lean(best), "view int, good int, doc_id bigint, rank double"), "confident")
    tops = [sure.filter((F.col("view") == k) & (F.col("good") == good)).groupBy("view", "good", "doc_id").agg(F.min("rank").alias("rank")).orderBy("rank", "doc_id").limit(most[good]) for k in (0, 1) for good in (0, 1)]
    top = [(r["view"], r["good"], r["doc_id"]) for r in reduce(DataFrame.unionByName, tops).collect()]  # about 2 * PER_ROUND rows
    scratch.drop(sure)
    ids = every.sparkSession.createDataFrame(top, "view int, good int, doc_id bigint")
    return free.join(F.broadcast(ids), "doc_id").dropDuplicates(["view", "doc_id"]).toPandas().sort_values(["view", "good", "doc_id"])


def _some(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n ids, the lowest by hash."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def _known(labels: DataFrame, targets: tuple[str, ...], labelled: int) -> tuple[DataFrame, list[float]]:
    """doc_id and a label for each target (``label0`` and on): 0 or 1 of the documents to fit on, -2 of other labelled ones, else null.

    Also the share of class 1 among all labels of each target.
    """
    out, shares = None, []
    for k, target in enumerate(targets):
        known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
        by_class = [_some(known.filter(F.col("label") == c), labelled // 2, 1) for c in (0, 1)]
        chosen = by_class[0].unionByName(by_class[1]).select("doc_id", F.lit(True).alias("chosen"))  # labelled ids at most
        one = known.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", F.when(F.col("chosen"), F.col("label")).otherwise(-2).alias(f"label{k}"))
        out = one if out is None else out.join(one, "doc_id", "full")
        shares.append(known.agg(F.avg("label")).first()[0] or 0.0)
    return scratch.table(out, "labelled"), shares


def _telling(plain: DataFrame, known: DataFrame, n: int) -> np.ndarray:
    """Ascending hashes of the words that tell most about the n targets' labels."""
    names = [f"label{k}" for k in range(n)]
    chosen = known.filter(" or ".join(f"{c} >= 0" for c in names))  # labelled ids of each target at most
    read = plain.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def split(batches):
        for batch in batches:
            for a, b, buf, offsets in text.slices(batch.column(1)):
                starts, ends, first = text.words(buf, offsets)
                h, doc = text.hashes(buf, starts, ends, True).view(np.int64), text.owner(first)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                once = np.ones(len(h), bool)  # a text holds a word or doesn't
                once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[once], doc[once]
                for k in range(n):
                    own = batch.column(2 + k).slice(a, b - a).fill_null(-1).to_numpy(zero_copy_only=False)[doc]
                    words = pd.DataFrame({"h": h, "y": own})[own >= 0].groupby(["h", "y"]).size().reset_index(name="n")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), k), pa.int32()), pa.array(words["h"].to_numpy(np.int64)), pa.array(words["y"].to_numpy(np.int32)), pa.array(words["n"].to_numpy(np.int64))], ["target", "h", "y", "n"])

    counts = read.select("doc_id", "text", *names).mapInArrow(lean(split), "target int, h bigint, y int, n bigint")
    per = counts.groupBy("target", "h").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).cast("double").alias("b")).filter(F.col("a") + F.col("b") >= LEAST_DOCS)
    words = scratch.table(per, "words")
    total = read.agg(*[F.count_if(F.col(c) == y).alias(f"{c}_{y}") for c in names for y in (0, 1)]).first()
    out: set[int] = set()
    for k, c in enumerate(names):
        yes, no = float(total[f"{c}_1"]), float(total[f"{c}_0"])
        if yes and no:
            a, b = F.col("a"), F.col("b")
            tie = (yes + no) / (yes * no) * (a * no - b * yes) ** 2 / ((a + b) * (yes + no - a - b + 0.5))
            out |= {r[0] for r in words.filter((F.col("target") == k) & (tie >= LEAST_TIE)).orderBy(tie.desc(), "h").limit(TELLING).select("h").collect()}
    scratch.drop(words)
    return np.sort(np.array(sorted(out), np.int64).view(np.uint64))


def fit_all(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], names: tuple[str, ...] = ("source", "lang"), length: str | None = "n_chars", labelled: int = LABELLED) -> list[Model]:
    """A model for each target, fitted on at most ``labelled`` labelled documents and on all others (of ``doc_id``, ``text`` and metadata)."""
    known, shares = _known(labels, targets, labelled)
    meta = list(dict.fromkeys([*names, *([length] if length else [])]))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta)
    telling = _telling(plain, known, len(targets))

    def extract(batches):
        for batch in batches:
            for a, b, buf, offsets in text.slices(batch.column(1)):
                x = text_features(buf, offsets)
                cut = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                bits = pa.array([r.tobytes() for r in np.packbits(present(buf, offsets, telling), axis=1)], pa.binary())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.ListArray.from_arrays(cut, pa.array(x.ravel())), bits], ["doc_id", *meta, "x", "w"])

    kinds = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in meta)
    features = plain.mapInArrow(lean(extract), f"doc_id bigint, {kinds + ', ' if meta else ''}x array<double>, w binary")
    labelled_as = [F.coalesce(f"label{k}", F.lit(-1)).alias(f"label{k}") for k in range(len(targets))]
    every = scratch.table(features.join(known, "doc_id", "left").select("doc_id", *meta, "x", "w", *labelled_as), "features")
    values = {c: sorted(str(r[0]) for r in every.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(VALUES).collect()) for c in names}
    pages = Pages(values, length)
    scale = _moments(every, pages, telling)
    out = []
    for k in range(len(targets)):
        own = every.select("doc_id", *meta, "x", "w", F.col(f"label{k}").alias("label"))
        rows = own.filter("label >= 0").dropDuplicates(["doc_id"]).toPandas()  # labelled at most
        out.append(Model(rows, own, pages, scale, telling, shares[k]))
    scratch.drop(every, known)
    return out


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", **fitting) -> Model:
    """The model of one target."""
    return fit_all(docs, labels, (target,), **fitting)[0]


class Verdict:
    """Quality and, where the labels have it, toxicity."""

    def __init__(self, docs: DataFrame, labels: DataFrame, threshold: float, target: str = "quality", reject: str | None = "toxic", **fitting) -> None:
        targets = (target, reject) if reject in labels.columns else (target,)
        self.good, *self.bad = fit_all(docs, labels, targets, **fitting)
        self.threshold, pages = threshold, self.good.pages
        self.meta = list(dict.fromkeys([*pages.names, *([pages.length] if pages.length else [])]))

    def __call__(self, buf: np.ndarray, offsets: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Text, page, joint and toxic scores, and which are kept."""
        x = np.column_stack([text_features(buf, offsets), present(buf, offsets, self.good.telling)])
        one, two, both = self.good(x, rows)
        toxic = self.bad[0](x, rows)[2] if self.bad and self.bad[0].ready else np.zeros(len(x))
        return one, two, both, toxic, (both >= self.threshold) & (toxic < self.threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """A row per document: both views' calibrated scores, the joint score, the toxic score and the verdict ``kept``."""
    verdict = Verdict(docs, labels, threshold, **fitting)
    meta = verdict.meta

    def score(batches):
        for batch in batches:
            pages = batch.select(meta).to_pandas() if meta else pd.DataFrame(index=range(batch.num_rows))
            for a, b, buf, offsets in text.slices(batch.column(1)):
                got = verdict(buf, offsets, pages.iloc[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, got)], ["doc_id", "text_score", "page_score", "score", "toxic_score", "kept"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *meta).mapInArrow(lean(score), SCHEMA)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """The documents that the classifiers keep, with all their columns."""
    verdict = Verdict(docs, labels, threshold, **fitting)
    meta, at = verdict.meta, docs.columns.index("text")

    def chosen(batches):
        for batch in batches:
            pages = batch.select(meta).to_pandas() if meta else pd.DataFrame(index=range(batch.num_rows))
            for a, b, buf, offsets in text.slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(verdict(buf, offsets, pages.iloc[a:b])[-1]))

    return docs.mapInArrow(lean(chosen), docs.schema)

"""Rows by key: first or last of equal keys, how many share a key, and the mode of a column for each sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def one_per_key(rows: DataFrame, key: str, order: str | list[str], keep: str = "first", within: list[str] | None = None) -> DataFrame:
    """The first (or last) row of each non-blank key, by ``order``; an aggregate, so that equal keys meet after a partial min."""
    names = [order] if isinstance(order, str) else order
    cleaned = rows.withColumn("_key", V.identity(F.col(key))).filter("_key <> ''")
    rank = F.struct(*names, *[c for c in rows.columns if c not in names])
    best = (F.min if keep == "first" else F.max)(rank)
    got = cleaned.groupBy(*(within or []), "_key").agg(best.alias("_row"))
    return got.select("_row.*").select(*rows.columns)


def multiplicity(rows: DataFrame, key: str, order: str, within: list[str] | None = None) -> DataFrame:
    """The first row of each key with ``_n``, how many rows share it."""
    rank = F.struct(order, *[c for c in rows.columns if c != order])
    cleaned = rows.withColumn("_key", V.identity(F.col(key))).filter("_key <> ''")
    got = cleaned.groupBy(*(within or []), "_key").agg(F.min(rank).alias("_row"), F.count("*").alias("_n"))
    return got.select("_row.*", "_n").select(*rows.columns, "_n")


def mode_rank(value: Column, n: Column, first: Column) -> Column:
    """struct(n, t, w, first, v) whose least is the mode: whole numbers first, the least of them; then what comes first."""
    whole = F.when(value.rlike(r"^(0|[1-9]\d{0,9})$"), value.cast("long"))
    return F.struct((-n).alias("n"), whole.isNull().alias("t"), F.coalesce(whole, F.lit(0)).alias("w"), first.alias("first"), value.alias("v"))


def mode(rows: DataFrame, value: str, order: str, by: str = "sheet") -> DataFrame:
    """by, value, n: the most frequent non-blank value of each sheet; of equally frequent ones as :func:`mode_rank` has it."""
    t = V.text(F.col(value))
    counted = rows.withColumn("_v", t).filter("_v <> ''").groupBy(by, "_v").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = mode_rank(F.col("_v"), F.col("n"), F.col("first"))
    return counted.groupBy(by).agg(F.min(rank).alias("r")).select(by, F.col("r.v").alias(value), (-F.col("r.n")).alias("n"))

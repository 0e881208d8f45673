"""Columns of many sheets: add, delete (with what would be lost) and rename, each with a log row for a sheet and column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import headers as H

LOG = "sheet string, column string, status string, position int"


def add_columns(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """The DataFrame with empty columns at the right, and (column, added or exists, position from 1)."""
    out, new = H.add_columns(df.columns, wanted)
    log = [(w, "added" if w in new else "exists", out.index(w) + 1) for w in dict.fromkeys(H.trimmed(wanted)) if w]
    return df.withColumns({c: F.lit("") for c in new}), log


def delete_impact(sheets: DataFrame, columns: list[str]) -> DataFrame:
    """sheet, column, non_blank: cells that would be lost."""
    counts = sheets.groupBy("sheet").agg(*[F.count_if(~V.source_blank(F.col(c), V.kind_of(sheets.schema[c].dataType))).alias(c) for c in columns])
    return counts.select("sheet", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_blank")) for c in columns])))


def delete_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    left = [c for c in df.columns if c not in columns]
    if not left:
        raise ValueError("a sheet can't lose all its columns")
    return df.select(*left)


def rename_status(headers: list[str], old: str, new: str) -> str:
    """What renaming a header would do: renamed, missing, exists or identical. Blank names are an error."""
    old, new = old.strip(), new.strip()
    if not old or not new:
        raise ValueError("both names are needed")
    return "identical" if old == new else "missing" if old not in headers else "exists" if new in headers else "renamed"


def rename(df: DataFrame, old: str, new: str) -> tuple[DataFrame, str]:
    status = rename_status(df.columns, old, new)
    return (df.withColumnRenamed(old.strip(), new.strip()) if status == "renamed" else df), status


def rename_all(spark: SparkSession, sheet_headers: Mapping[str, list[str]], old: str, new: str) -> DataFrame:
    """A log row for each sheet of a folder."""
    rows = [(s, old.strip(), rename_status(h, old, new), h.index(old.strip()) + 1 if old.strip() in h else None) for s, h in sorted(sheet_headers.items())]
    return spark.createDataFrame(rows, LOG)

"""What plans would do, in numbers of one row and in a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_fill(changes: DataFrame, to_add: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """filled, overwritten, conflicts, skipped, sheets_affected, columns_to_add, errors. ``to_add``: sheet, column; ``errors``: a row each.

    Counted by sheet first, so a sheet's cells meet after partial sums.
    """
    kinds = {"fill": "filled", "overwrite": "overwritten", "conflict": "conflicts", "skip": "skipped"}
    by_sheet = changes.groupBy("sheet").agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in kinds.items()])
    totals = by_sheet.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in kinds.values()], F.count_if(F.col("filled") + F.col("overwritten") > 0).alias("sheets_affected"))
    more = [totals]
    more.append((to_add if to_add is not None else changes.limit(0)).agg(F.countDistinct("column").alias("columns_to_add")))
    more.append((errors if errors is not None else changes.limit(0)).agg(F.count("*").alias("errors")))
    return _one_row(more)


def push_missing(planned: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """appended, flagged, sheets_affected, errors."""
    new = planned.filter("action = 'append'")
    totals = new.agg(F.count("*").alias("appended"), F.count_if(F.col("flags") != "").alias("flagged"), F.countDistinct("sheet").alias("sheets_affected"))
    return _one_row([totals, (errors if errors is not None else planned.limit(0)).agg(F.count("*").alias("errors"))])


def new_residents(screened: DataFrame, *by: str) -> DataFrame:
    """by, candidates, clean, likely, possible."""
    return screened.groupBy(*by).agg(F.count("*").alias("candidates"), *[F.count_if(F.col("risk") == r).alias(n) for r, n in (("none", "clean"), ("likely", "likely"), ("possible", "possible"))])


def folder(summaries: DataFrame, statuses: DataFrame) -> DataFrame:
    """sheets_processed, columns_added, filled, overwritten, conflicts, skipped, errors of a folder.

    ``summaries``: a row for each sheet (columns_added and the counts of ``fill.summary``); ``statuses``: sheet, error.
    """
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("columns_added", "filled", "overwritten", "conflicts", "skipped")]
    return _one_row([statuses.agg(F.count("*").alias("sheets_processed"), F.count_if(F.col("error") != "").alias("errors")), summaries.agg(*sums)])


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Rows of totals side by side: each part has one row and columns of its own."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def counted(n: int, one: str, many: str | None = None) -> str:
    """1 cell, 1,200 cells."""
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def listed(parts: list[str]) -> str:
    """a, b and c."""
    return "nothing" if not parts else parts[0] if len(parts) == 1 else f"{', '.join(parts[:-1])} and {parts[-1]}"


def sentence(row: dict, names: dict[str, str]) -> str:
    """The counts of an impact that aren't zero, with their nouns (in the singular) by column."""
    return listed([counted(int(row[c]), noun) for c, noun in names.items() if row.get(c)])

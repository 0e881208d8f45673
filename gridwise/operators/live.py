"""Guarded plans against a target's present state: writes, appends, deletes, moves, and their undoing.

All address rows by identity, never by position. Every proposal comes back with an action and a reason, so nothing is
skipped silently. Snapshots carry cells and rows as texts of :func:`values.encoded`, by column name, so that a table of any
types gets its values back, nulls included.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import guard, pull


def _state(target: DataFrame, key: str, order: str, asked: DataFrame) -> DataFrame:
    """identity, n, row: how many rows have an identity that is asked for, and the first of them as a map of texts."""
    rows = target.withColumn("_identity", V.identity(F.col(key))).join(asked.select(F.col("identity").alias("_identity")).filter("_identity <> ''").distinct(), "_identity", "left_semi")
    # Rows are grouped as they are; as maps of texts they are several times as long.
    first = rows.select(F.col("_identity").alias("identity"), F.col(order).alias("o"), F.struct(*[F.col(c) for c in target.columns]).alias("cells")).groupBy("identity").agg(F.count("*").alias("n"), F.min_by("cells", "o").alias("cells"))
    texts = F.create_map(*[x for f in target.schema for x in (F.lit(f.name), V.encoded(F.col("cells").getField(f.name), f.dataType))])
    return first.select("identity", "n", F.when(F.col("cells").isNotNull(), texts).alias("row"))


def _with_again(named: DataFrame, order: str, *by: str) -> DataFrame:
    """``again``: whether an earlier proposal has the same keys; blank identities have none and aren't grouped."""
    first = named.filter("identity <> ''").groupBy(*by).agg(F.min(order).alias("_first"))
    return named.join(first, list(by), "left").withColumn("again", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def _out(df: DataFrame, reasons: list[tuple[Column, str, str]], otherwise: tuple[str, str], columns: list[str]) -> DataFrame:
    """The first reason that holds, as action and reason."""
    action, reason = F.lit(otherwise[0]), F.lit(otherwise[1])
    for when, a, text in reversed(reasons):
        action, reason = F.when(when, a).otherwise(action), F.when(when, text).otherwise(reason)
    return df.select(*columns, action.alias("action"), reason.alias("reason"))


def writes(target: DataFrame, proposals: DataFrame, key: str = "resident_id", order: str = "src_row", protected: Iterable[str] = guard.PROTECTED) -> DataFrame:
    """proposal_id, identity, column, existing, incoming, action, reason for proposals (proposal_id, identity, column, incoming, policy)."""
    named = proposals.withColumn("identity", V.identity(F.col("identity")))
    named = _with_again(named, "proposal_id", "identity", "column")
    joined = named.join(_state(target, key, order, named), "identity", "left").withColumn("existing", F.try_element_at("row", F.col("column")))
    v = guard.decide(F.col("existing"), F.col("incoming"), F.col("policy"), F.col("column").isin(*protected))
    joined = joined.withColumn("v", v)
    reasons = [
        (F.col("identity") == "", "skip", f"no {key}"),
        (F.col("n").isNull(), "skip", f"{key} not in the target"),
        (F.col("n") > 1, "skip", f"{key} on several rows of the target"),
        (~F.array_contains(F.array(*[F.lit(c) for c in target.columns]), F.col("column")), "skip", "no such column in the target"),
        (F.col("again"), "skip", "cell proposed before"),
    ]
    free = _out(joined, reasons, ("guard", ""), ["proposal_id", "identity", "column", "existing", "incoming", "v"])
    guarded = F.col("action") == "guard"
    return free.select("proposal_id", "identity", "column", "existing", "incoming", F.when(guarded, F.col("v.action")).otherwise(F.col("action")).alias("action"), F.when(guarded, F.col("v.reason")).otherwise(F.col("reason")).alias("reason"))


def appends(target: DataFrame, rows: DataFrame, key: str = "resident_id", order: str = "src_row", by: str = "proposal_id") -> DataFrame:
    """by, identity, action (append or skip), reason, cells: new rows, their non-blank cells for the target's columns only."""
    here = target.select(V.identity(F.col(key)).alias("identity"), F.lit(True).alias("here")).filter("identity <> ''").distinct()
    named = rows.withColumn("identity", V.identity(F.col(key)))
    named = _with_again(named, by, "identity")
    joined = named.join(here, "identity", "left")
    kept = [c for c in target.columns if c in rows.columns]
    cells = F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), F.when(guard.decide_append(F.col(c), V.kind_of(rows.schema[c].dataType))["will_write"], V.encoded(F.col(c), rows.schema[c].dataType)))]), lambda _, v: v.isNotNull())
    reasons = [(F.col("identity") == "", "skip", f"no {key}"), (F.col("here").isNotNull() | F.col("again"), "skip", f"{key} in the target already")]
    return _out(joined.withColumn("cells", cells), reasons, ("append", ""), [by, "identity", "cells"])


def deletes(target: DataFrame, ids: DataFrame, key: str = "resident_id", order: str = "src_row", by: str = "proposal_id") -> DataFrame:
    """by, identity, action (delete or skip), reason for proposals (by, identity)."""
    named = ids.withColumn("identity", V.identity(F.col("identity")))
    named = _with_again(named, by, "identity")
    joined = named.join(_state(target, key, order, named), "identity", "left")
    reasons = [
        (F.col("identity") == "", "skip", f"no {key}"),
        (F.col("again"), "skip", "delete proposed before"),
        (F.col("n").isNull(), "skip", f"{key} not in the target"),
        (F.col("n") > 1, "skip", f"{key} on several rows of the target"),
    ]
    return _out(joined, reasons, ("delete", ""), [by, "identity", "row"])


def moves(source: DataFrame, destination: DataFrame, ids: DataFrame, fields: Mapping[str, str], key: str = "resident_id", order: str = "sheet_row", by: str = "proposal_id") -> DataFrame:
    """by, identity, action (move or skip), reason, cells: rows for the destination's columns, with non-blank ``fields`` set."""
    if not (fields.get("zone") or "").strip():
        raise ValueError("a move needs the destination's zone")
    named = ids.withColumn("identity", V.identity(F.col("identity")))
    named = _with_again(named, by, "identity")
    there = destination.select(V.identity(F.col(key)).alias("identity"), F.lit(True).alias("there")).filter("identity <> ''").distinct()
    joined = named.join(_state(source, key, order, named), "identity", "left").join(there, "identity", "left")
    cells = F.create_map(*[x for c in destination.columns for x in (F.lit(c), F.lit(fields[c]) if fields.get(c) else F.coalesce(F.try_element_at("row", F.lit(c)), F.lit("")))])
    reasons = [
        (F.col("identity") == "", "skip", f"no {key}"),
        (F.col("again"), "skip", "move proposed before"),
        (F.col("n").isNull(), "skip", f"{key} not on the source sheet"),
        (F.col("n") > 1, "skip", f"{key} on several rows of the source sheet"),
        (F.col("there").isNotNull(), "skip", f"{key} on the destination sheet already"),
    ]
    return _out(joined.withColumn("cells", cells), reasons, ("move", ""), [by, "identity", "cells"])


def revert_cells(target: DataFrame, snapshots: DataFrame, key: str = "resident_id", order: str = "src_row") -> DataFrame:
    """snapshot_id, identity, column, action (restore, conflict or skip), reason for snapshots (snapshot_id, identity, column, before, after)."""
    named = snapshots.withColumn("identity", V.identity(F.col("identity")))
    joined = named.join(_state(target, key, order, named), "identity", "left").withColumn("now", F.try_element_at("row", F.col("column")))
    reasons = [
        (F.col("n").isNull(), "skip", "row is gone"),
        (F.col("n") > 1, "conflict", f"{key} on several rows; which cell is unknown"),
        (~F.array_contains(F.array(*[F.lit(c) for c in target.columns]), F.col("column")), "conflict", "column is gone"),
        (V.same(F.col("now"), F.col("before")), "skip", "cell is as before the run"),
        (~V.same(F.col("now"), F.col("after")), "conflict", "cell was edited after the run"),
    ]
    return _out(joined, reasons, ("restore", ""), ["snapshot_id", "identity", "column", "before"])


def _unchanged(target: DataFrame, row: Column, cells: Column) -> Column:
    """Whether all of the target's columns hold what the snapshot has for them."""
    same = [V.same(F.try_element_at(row, F.lit(c)), F.try_element_at(cells, F.lit(c))) for c in target.columns if c not in ("sheet_row", "src_row")]
    out = F.lit(True)
    for s in same:
        out = out & s
    return out


def revert_appends(target: DataFrame, snapshots: DataFrame, key: str = "resident_id", order: str = "src_row") -> DataFrame:
    """snapshot_id, identity, action (delete, conflict or skip), reason for snapshots (snapshot_id, identity, cells: map)."""
    named = snapshots.withColumn("identity", V.identity(F.col("identity")))
    joined = named.join(_state(target, key, order, named), "identity", "left")
    reasons = [
        (F.col("n").isNull(), "skip", "appended row is gone"),
        (F.col("n") > 1, "conflict", f"{key} on several rows"),
        (~_unchanged(target, F.col("row"), F.col("cells")), "conflict", "row was edited after the run"),
    ]
    return _out(joined, reasons, ("delete", ""), ["snapshot_id", "identity"])


def restore_rows(target: DataFrame, snapshots: DataFrame, key: str = "resident_id", order: str = "src_row") -> DataFrame:
    """snapshot_id, identity, action (append, conflict or skip), reason for deleted rows (snapshot_id, identity, cells: map)."""
    named = snapshots.withColumn("identity", V.identity(F.col("identity")))
    named = _with_again(named, "snapshot_id", "identity")
    joined = named.join(_state(target, key, order, named), "identity", "left")
    reasons = [
        (F.col("identity") == "", "skip", f"no {key}"),
        (F.col("n") > 1, "conflict", f"{key} on several rows; not restored"),
        ((F.col("n") == 1) & ~_unchanged(target, F.col("row"), F.col("cells")), "conflict", "row is back with other values"),
        (F.col("n") == 1, "skip", "row is back as it was"),
        (F.col("again"), "skip", "restore proposed before"),
    ]
    return _out(joined, reasons, ("append", ""), ["snapshot_id", "identity"])


def conflicts(target: DataFrame, logged: DataFrame, key: str = "resident_id", order: str = "src_row", protected: Iterable[str] = guard.PROTECTED) -> DataFrame:
    """sheet, identity, column, existing (now), incoming, action, reason, will_write: logged conflicts that were decided for.

    A conflict is written over what the target holds, but only where that is still what was shown when it was logged.
    """
    named = logged.withColumn("identity", V.identity(F.col("identity")))
    joined = named.join(_state(target, key, order, named), "identity", "left").withColumn("now", F.try_element_at("row", F.col("column")))
    joined = joined.withColumn("v", guard.decide(F.col("now"), F.col("incoming"), F.lit("overwrite"), F.col("column").isin(*protected)))
    there = F.array_contains(F.array(*[F.lit(c) for c in target.columns]), F.col("column"))
    reasons = [
        (F.col("n").isNull() | ~there, "skip", "row or column is gone"),
        (F.col("n") > 1, "skip", f"{key} on several rows of the target"),
        (~V.same(F.col("now"), F.col("existing")), "conflict", "cell was edited after it was logged"),
    ]
    out = _out(joined, reasons, ("guard", ""), ["sheet", "identity", "column", F.col("now").alias("existing"), "incoming", "v"])
    free = F.col("action") == "guard"
    action = F.when(free, F.col("v.action")).otherwise(F.col("action"))
    return out.select("sheet", "identity", "column", "existing", "incoming", action.alias("action"), F.when(free, F.col("v.reason")).otherwise(F.col("reason")).alias("reason"), (free & F.col("v.will_write")).alias("will_write"))


def _as_rows(cells: Column, target: DataFrame) -> list[Column]:
    """A map of texts as the target's columns; what it lacks is an empty text, or null where the column isn't one."""
    def cell(c: str) -> Column:
        kind, value = target.schema[c].dataType, F.try_element_at(cells, F.lit(c))
        return F.when(F.map_contains_key(cells, F.lit(c)), value).otherwise(F.lit("")) if kind.simpleString() == "string" else V.decoded(value, kind)

    return [cell(c).alias(c) for c in target.columns]


def appended(target: DataFrame, plan: DataFrame, order: str = "src_row", by: str = "proposal_id") -> DataFrame:
    """The target with the rows that a plan appends (action append or move), numbered after its last in the order of ``by``."""
    new = plan.filter(F.col("action").isin("append", "move")).select(*_as_rows(F.col("cells"), target), F.col(by).alias("_by"))
    return target.unionByName(pull.numbered(new.drop(order), target, order, ("_by",)).select(*[F.col(c).cast(target.schema[c].dataType) for c in target.columns]))


def deleted(target: DataFrame, plan: DataFrame, key: str = "resident_id") -> DataFrame:
    """The target without the rows that a plan deletes or moves away."""
    gone = plan.filter(F.col("action").isin("delete", "move")).select(F.col("identity").alias("_gone")).distinct()
    return target.join(gone, V.identity(F.col(key)) == F.col("_gone"), "left_anti")

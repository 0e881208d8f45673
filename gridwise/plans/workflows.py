"""Workflows by name: each makes a plan (a DataFrame) from a master, copies of it and options. Nothing is written."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import address_ids, audit, export, fill, ledger, live, pull, schema_ops, zones
from ..operators.ledger import Ledger
from ..sources import sinks


@dataclass(frozen=True)
class Workflow:
    """What a workflow needs, and the planner that it calls."""

    name: str
    plan: Callable[..., DataFrame | dict[str, DataFrame]]
    needs: tuple[str, ...] = ()
    says: str = ""


@dataclass
class Check:
    state: str  # ok, warning or error
    message: str


WORKFLOWS = {
    w.name: w
    for w in (
        Workflow("push_master", fill.plan, ("target", "source", "columns"), "fill the copies from the master"),
        Workflow("import_feed", fill.plan, ("target", "source", "columns"), "fill the master from an outside feed"),
        Workflow("unmatched_source", fill.unmatched, ("source", "target"), "feed rows that no target row matches"),
        Workflow("push_missing", pull.push_missing, ("master", "sheets"), "residents that copies lack"),
        Workflow("pull_to_master", pull.pull_changes, ("master", "sheets", "columns"), "edits of copies for the master"),
        Workflow("pull_skips", pull.pull_skips, ("master", "sheets"), "rows of copies that can't be pulled, and why"),
        Workflow("pull_folder", lambda **o: pull.pull_folder(**o)[0], ("master", "sheets", "columns"), "edits of a whole folder, the first sheet winning"),
        Workflow("append_missing", lambda **o: pull.pull_folder(**o)[1], ("master", "sheets", "columns"), "rows of a folder that the master lacks"),
        Workflow("unmatched_verdicts", pull.verdicts, ("master", "sheets"), "why ids of copies aren't on the master"),
        Workflow("new_residents", pull.new_residents, ("master", "sheet"), "residents that the master lacks, screened for duplicates"),
        Workflow("audit", audit.report, ("master", "sheets"), "eight tables on drift, completeness and membership"),
        Workflow("zone_check", zones.reconcile, ("master", "zones", "current"), "what polygons say about the master's zones"),
        Workflow("zone_enrichment", lambda **o: zones.enrichment(zones.reconcile(**o)), ("master", "zones", "current"), "blank zone fields to fill"),
        Workflow("zone_moves", zones.moves, ("sheet", "master", "zones", "to_zone"), "residents of a copy who stand in another zone"),
        Workflow("folder_moves", zones.folder_moves, ("sheets", "master", "zones"), "residents of any copy who stand in another copy's zone"),
        Workflow("guarded_writes", live.writes, ("target", "proposals"), "approved cells against the present target"),
        Workflow("guarded_appends", live.appends, ("target", "rows"), "new rows against the present target"),
        Workflow("guarded_deletes", live.deletes, ("target", "ids"), "rows to delete"),
        Workflow("guarded_moves", live.moves, ("source", "destination", "ids", "fields"), "rows to move between copies"),
        Workflow("revert_cells", live.revert_cells, ("target", "snapshots"), "undo of cell writes"),
        Workflow("revert_appends", live.revert_appends, ("target", "snapshots"), "undo of appends"),
        Workflow("restore_rows", live.restore_rows, ("target", "snapshots"), "undo of deletes"),
        Workflow("delete_impact", schema_ops.delete_impact, ("sheets", "columns"), "cells that deleted columns would lose"),
        Workflow("address_ids", address_ids.groups, ("rows", "key", "existing", "order"), "ids for addresses"),
        Workflow("export_manifest", export.manifest, ("rows", "zone", "contact", "order"), "one output for each zone"),
    )
}


#: How a run of each kind is undone; runs of other workflows write nothing, or can't be taken back.
REVERTS = {
    "push_master": "revert_cells", "import_feed": "revert_cells", "pull_to_master": "revert_cells", "pull_folder": "revert_cells", "zone_enrichment": "revert_cells", "guarded_writes": "revert_cells", "apply": "revert_cells", "conflicts": "revert_cells",
    "push_missing": "revert_appends", "append_missing": "revert_appends", "guarded_appends": "revert_appends", "guarded_deletes": "restore_rows", "guarded_moves": "both sides", "rows": "both sides",
}
#: The snapshots that a run of such a kind may have stored.
HOLDS = {"revert_cells": ("cell_update",), "revert_appends": ("row_append",), "restore_rows": ("row_delete",), "both sides": ("row_append", "row_delete")}


def undo(store: Ledger, run_id: str, target: DataFrame, path: str, key: str, order: str, **options: Any) -> DataFrame:
    """Take a run back by what its kind is (``sinks.undo``); refused are unknown runs, kinds without an undo, and runs whose snapshots aren't of their kind."""
    kind = ledger.latest(store.read("runs").filter(F.col("run_id") == run_id), "run_id").select("workflow").first()
    if kind is None:
        raise ValueError(f"no such run: {run_id}")
    if kind[0] not in REVERTS:
        raise ValueError(f"a run of {kind[0]} can't be taken back")
    strange = store.open_snapshots(run_id).filter(~F.col("operation").isin(*HOLDS[REVERTS[kind[0]]]))
    if not strange.isEmpty():
        raise ValueError(f"a run of {kind[0]} holds snapshots of another kind")
    return sinks.undo(store, run_id, target, path, key, order, **options)


#: Columns that a workflow reads under fixed names, by option; ``key``, ``x`` and ``y`` rename ids and coordinates.
READS = {
    "push_missing": {"master": ["resident_id", "zone"], "sheets": ["resident_id", "zone"]},
    "pull_to_master": {"master": ["resident_id"], "sheets": ["resident_id"]},
    "pull_skips": {"master": ["resident_id"], "sheets": ["resident_id"]},
    "pull_folder": {"master": ["resident_id"], "sheets": ["resident_id"]},
    "append_missing": {"master": ["resident_id"], "sheets": ["resident_id"]},
    "unmatched_verdicts": {"master": ["resident_id", "resident_name"], "sheets": ["resident_id", "resident_name"]},
    "new_residents": {"master": ["resident_id", "resident_name", "apn", "email"], "sheet": ["resident_id", "resident_name", "apn", "email"]},
    "audit": {"master": ["resident_id", "zone", "resident_name"], "sheets": ["resident_id", "zone", "apn", "damage"]},
    "zone_check": {"master": ["resident_id", "lon", "lat"], "zones": ["ordinal", "geometry"]},
    "zone_enrichment": {"master": ["resident_id", "lon", "lat"], "zones": ["ordinal", "geometry"]},
    "zone_moves": {"sheet": ["resident_id"], "master": ["resident_id", "lon", "lat"], "zones": ["ordinal", "geometry"]},
    "folder_moves": {"sheets": ["sheet", "sheet_row", "resident_id", "zone"], "master": ["resident_id", "lon", "lat"], "zones": ["ordinal", "geometry"]},
    "guarded_writes": {"proposals": ["proposal_id", "identity", "column", "incoming", "policy"]},
    "guarded_deletes": {"ids": ["proposal_id", "identity"]},
    "guarded_moves": {"ids": ["proposal_id", "identity"]},
    "revert_cells": {"snapshots": ["snapshot_id", "identity", "column", "before", "after"]},
}


def readiness(name: str, options: dict[str, Any]) -> list[Check]:
    """What stands in a workflow's way, from its options and the headers of its tables; no rows are read."""
    if name not in WORKFLOWS:
        return [Check("error", f"no such workflow: {name}")]
    out = [Check("error", f"{n} is missing") for n in WORKFLOWS[name].needs if options.get(n) is None]
    columns = options.get("columns")
    if "columns" in WORKFLOWS[name].needs and columns is not None and not columns:
        out.append(Check("warning", "no columns are mapped"))
    if any(c.state == "error" for c in out):
        return out

    def lacking(option: str, wanted: list[str | None]) -> list[str]:
        table = options.get(option)
        return [w for w in wanted if w and isinstance(table, DataFrame) and w not in table.columns]

    renamed = {"resident_id": options.get("key"), "lon": options.get("x"), "lat": options.get("y")}
    for option, wanted in READS.get(name, {}).items():
        if found := lacking(option, [renamed.get(w) or w for w in wanted]):
            out.append(Check("error", f"{option} lacks {', '.join(found)}"))
    if name in ("push_master", "import_feed"):
        for option, key in (("source", "source_key"), ("target", "target_key")):
            if found := lacking(option, [options.get(key)]):
                out.append(Check("error", f"{option} lacks {', '.join(found)}"))
    if columns:
        source, target = ("source", "target") if "source" in options else ("sheets", "master")
        if found := lacking(source, list(columns)):
            out.append(Check("error", f"{source} lacks mapped columns: {', '.join(found)}"))
        if isinstance(columns, Mapping) and (found := lacking(target, list(columns.values()))):
            out.append(Check("warning", f"{target} gets new columns: {', '.join(found)}"))
    return out or [Check("ok", "ready")]


def plan(name: str, **options: Any) -> DataFrame | dict[str, DataFrame]:
    """The plan of a workflow; an error if something that it needs is missing."""
    if bad := [c.message for c in readiness(name, options) if c.state == "error"]:
        raise ValueError("; ".join(bad))
    return WORKFLOWS[name].plan(**options)


@dataclass
class Approval:
    """Which of a plan's changes were approved; changes that the plan lacks are refused."""

    keys: list[str] = field(default_factory=lambda: ["sheet", "identity", "column"])

    def subset(self, changes: DataFrame, approved: DataFrame) -> DataFrame:
        unknown = approved.select(*self.keys).join(changes, self.keys, "left_anti")
        if not unknown.isEmpty():
            raise ValueError("approved changes that the plan doesn't hold")
        return changes.join(approved.select(*self.keys).distinct(), self.keys, "left_semi")

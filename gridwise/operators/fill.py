"""Cell fill: a lookup's values proposed for the mapped columns of all matching target rows.

A plan is a DataFrame of proposed changes, one row a cell: sheet, sheet_row, identity, column, existing, incoming, policy,
action, reason, will_write. Nothing is written here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import guard, keyed

CHANGES = ["sheet", "sheet_row", "identity", "column", "existing", "incoming", "policy", "action", "reason", "will_write"]


def compare(joined: DataFrame, columns: Mapping[str, str], policies: Mapping[str, str], default: str, protected: Iterable[str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Rows that carry t.<column> and s.<column> turned into changes, in one pass: a struct a column, inlined."""
    kinds, protected = kinds or {}, set(protected)
    cells = []
    for source, target in columns.items():
        t, s = F.col(f"t.{target}"), F.col(f"s.{source}")
        kt, ks = kinds.get(target, V.kind_of(joined.schema["t"].dataType[target].dataType)), kinds.get(source, V.kind_of(joined.schema["s"].dataType[source].dataType))
        rule = policies.get(target, policies.get(source, default))
        known = [V.key(t, kt) if kt != "string" else F.lit(None).cast("string"), V.key(s, ks) if ks != "string" else F.lit(None).cast("string")]
        blank = [V.target_blank(t, kt), V.source_blank(s, ks)]
        names = ["column", "existing", "incoming", "rule", "kept", "tk", "sk", "tb", "sb"]
        cells.append(F.struct(*[c.alias(n) for c, n in zip([F.lit(target), t.cast("string"), s.cast("string"), F.lit(rule), F.lit(target in protected), *known, *blank], names, strict=True)]))
    # Texts are compared after the inline, so that the generated code holds the rules once and not once for each column.
    out = joined.select("sheet", "sheet_row", "identity", F.inline(F.array(*cells)))
    v = guard.decide_keys(F.coalesce("tk", V.key(F.col("existing"))), F.coalesce("sk", V.key(F.col("incoming"))), F.col("tb"), F.col("sb"), F.col("rule"), F.col("kept"))
    return out.withColumn("v", v).select("sheet", "sheet_row", "identity", "column", "existing", V.write_value(F.col("incoming")).alias("incoming"), "v.policy", "v.action", "v.reason", "v.will_write")


def lookup(rows: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """One row for each key."""
    return keyed.one_per_key(rows, key, order, keep)


def matched(target: DataFrame, source: DataFrame, target_key: str, source_key: str) -> DataFrame:
    """sheet, sheet_row, identity, t (the target's row), s (the source's row)."""
    t = target.select("sheet", "sheet_row", V.identity(F.col(target_key)).alias("identity"), F.struct(*target.columns).alias("t")).filter("identity <> ''")
    s = source.select(V.identity(F.col(source_key)).alias("_key"), F.struct(*source.columns).alias("s"))
    return t.join(s, F.col("identity") == F.col("_key")).drop("_key")


def plan(target: DataFrame, source: DataFrame, target_key: str, source_key: str, columns: Mapping[str, str], order: str, policies: Mapping[str, str] | None = None, default: str = "fill_blank", protected: Iterable[str] = guard.PROTECTED, keep: str = "first", all_cells: bool = False, dates: bool = False) -> DataFrame:
    """Changes for the target's cells; equal cells and blank sources are left out unless they are under the policy never.

    Columns that the target lacks are added by :func:`with_columns` first. Equal keys in the target are all filled. With
    ``dates``, source cells of a mapping that has the word date in a name are read as dates where they can be.
    """
    if dates:
        named = [s for s, t in columns.items() if re.search(r"\bdate\b", f"{s} {t}".replace("_", " "), re.IGNORECASE)]
        source = source.withColumns({c: F.coalesce(V.to_date(F.col(c)).cast("string"), F.col(c).cast("string")) for c in named})
    wanted = with_columns(target, columns.values())
    out = compare(matched(wanted, lookup(source, source_key, order, keep), target_key, source_key), columns, policies or {}, default, protected)
    return out if all_cells else out.filter((F.col("action").isin("fill", "overwrite", "conflict")) | ((F.col("action") == "skip") & (F.col("policy") == "never")))


def with_columns(target: DataFrame, names: Iterable[str]) -> DataFrame:
    """The target with empty columns for those that it lacks."""
    return target.withColumns({n: F.lit("") for n in dict.fromkeys(names) if n not in target.columns})


def to_add(target: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in dict.fromkeys(names) if n not in target.columns]


def plan_with_policies_of_old(changes: DataFrame) -> DataFrame:
    """The older rule for a plan of all cells: a blank target is filled even under the policy conflict."""
    blank = (F.col("action") == "conflict") & V.target_blank(F.col("existing"))
    return changes.withColumns({"will_write": F.col("will_write") | blank, "reason": F.when(blank, "blank cell").otherwise(F.col("reason")), "action": F.when(blank, "fill").otherwise(F.col("action"))})


def unmatched(source: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Source rows whose key no target row has."""
    keys = target.select(V.identity(F.col(target_key)).alias("_key")).filter("_key <> ''").distinct()
    return source.withColumn("_key", V.identity(F.col(source_key))).filter("_key <> ''").join(keys, "_key", "left_anti").drop("_key")


def busiest(summaries: DataFrame, by: str = "sheet") -> DataFrame:
    """Sheets with changes, those with the most first."""
    weight = F.col("filled") + F.col("overwritten") + F.col("conflicts")
    return summaries.withColumn("weight", weight).filter("weight > 0").orderBy(F.col("weight").desc(), by)


def summary(changes: DataFrame, by: str = "sheet") -> DataFrame:
    """Fills, overwrites, conflicts, skips and rows touched for each sheet."""
    return changes.groupBy(by).agg(
        F.count_if(F.col("action") == "fill").alias("filled"),
        F.count_if(F.col("action") == "overwrite").alias("overwritten"),
        F.count_if(F.col("action") == "conflict").alias("conflicts"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
        F.countDistinct(F.when(F.col("will_write"), F.col("identity"))).alias("identities"),
    )


def _by_sheet(target: DataFrame, by_sheet: bool | None) -> list[str]:
    return ["sheet"] if by_sheet or (by_sheet is None and "sheet" in target.columns) else []


def _ranked(changes: DataFrame) -> Column:
    return F.struct(*[c for c in ("sheet", "sheet_row", "incoming") if c in changes.columns])


def winners(changes: DataFrame, by: list[str]) -> DataFrame:
    """What will be written, one change for each cell (``by``, identity, column): of several the first by sheet and row."""
    writes = changes.filter("will_write").withColumn("identity", V.identity(F.col("identity"))).filter("identity <> ''")
    return writes.groupBy(*by, "identity", "column").agg(F.min(_ranked(writes)).alias("w")).select(*by, "identity", "column", "w.incoming")


def losers(changes: DataFrame, by: list[str]) -> DataFrame:
    """Changes that will be written, but for one of their cell that comes first."""
    keys = [*by, "identity", "column"]
    writes = changes.filter("will_write").withColumn("identity", V.identity(F.col("identity")))
    first = writes.groupBy(*keys).agg(F.min(_ranked(writes)).alias("w"))
    return writes.join(first, keys).filter(_ranked(writes) != F.col("w")).select(*changes.columns)


def unapplied(target: DataFrame, changes: DataFrame, key: str, by_sheet: bool | None = None) -> DataFrame:
    """Cells that will be written, but whose row or column the target doesn't have."""
    by = _by_sheet(target, by_sheet)
    rows = target.select(*by, V.identity(F.col(key)).alias("identity")).distinct()
    wanted = winners(changes, by)
    return wanted.join(rows, [*by, "identity"], "left_anti").unionByName(wanted.filter(~F.col("column").isin(*target.columns))).distinct()


def apply(target: DataFrame, changes: DataFrame, key: str, by_sheet: bool | None = None) -> DataFrame:
    """The target with all changes that will be written, found by identity, and by sheet if the target has sheets.

    Of several changes of a cell the first counts. A null is written as a null. With ``by_sheet`` False the changes' sheet
    only says where they come from, as in a plan that pulls edits of copies to the master. Compose with a sink to store it.
    """
    by = _by_sheet(target, by_sheet)
    writes = winners(changes, by).groupBy(*by, "identity").agg(F.map_from_entries(F.collect_list(F.struct("column", "incoming"))).alias("_new"))  # a row's cells
    joined = target.withColumn("identity", V.identity(F.col(key))).join(writes, [*by, "identity"], "left")
    names = [c for c in target.columns if c not in ("sheet", "sheet_row", key)]
    has = lambda c: F.coalesce(F.map_contains_key("_new", c), F.lit(False))
    new = lambda c: F.try_element_at("_new", F.lit(c))
    typed = lambda c: V.decoded(new(c), target.schema[c].dataType) if V.encoded_apart(target.schema[c].dataType) else new(c).cast(target.schema[c].dataType)
    cells = {c: F.when(has(c), typed(c)).otherwise(F.col(c)) for c in names}
    return joined.withColumns(cells).select(*target.columns)

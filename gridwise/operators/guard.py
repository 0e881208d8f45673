"""The write guard: what may happen to one cell, decided from its policy and both values.

Every planner takes its decisions here. The first rule that holds decides: a blank source is skipped; the policy never
(which protected columns have) is skipped; equal cells are equal; a blank target is a conflict under the policy conflict
and filled otherwise; overwrite overwrites; all else is a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V

POLICIES = ("fill_blank", "overwrite", "conflict", "never")
PROTECTED = ("resident_id",)
# Labels of policies as people write them.
SYNONYMS = {
    "fill": "fill_blank", "fill_blank": "fill_blank", "fill_blanks": "fill_blank", "fill_blank_only": "fill_blank", "overwrite": "overwrite", "replace": "overwrite",
    "conflict": "conflict", "log_conflict": "conflict", "log_only": "conflict", "never": "never", "skip": "never", "ignore": "never",
}


def policy(label: Column) -> Column:
    """A policy by its label; case, no-break spaces, spaces and dashes don't matter. An unknown label is empty."""
    plain = F.regexp_replace(F.lower(V.trim(F.regexp_replace(F.coalesce(label, F.lit("")), "\u00a0", " "))), r"[\s-]+", "_")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), plain), F.lit(""))


def decide_keys(target_key: Column, source_key: Column, target_blank: Column, source_blank: Column, rule: Column, protected: Column | bool = False) -> Column:
    """The verdict from comparison keys and blanks that are known already."""
    rule = F.when(protected if isinstance(protected, Column) else F.lit(protected), "never").when(rule.isin(*POLICIES), rule).otherwise("conflict")

    def verdict(action: str, reason: str, write: bool = False) -> Column:
        return F.struct(F.lit(action).alias("action"), rule.alias("policy"), F.lit(reason).alias("reason"), F.lit(write).alias("will_write"))

    return (
        F.when(source_blank, verdict("skip", "nothing to write"))
        .when(rule == "never", verdict("skip", "policy never"))
        .when(target_key == source_key, verdict("equal", "cells are equal"))
        .when(target_blank & (rule == "conflict"), verdict("conflict", "policy conflict"))
        .when(target_blank, verdict("fill", "blank cell", True))
        .when(rule == "overwrite", verdict("overwrite", "policy overwrite", True))
        .otherwise(verdict("conflict", "cells differ"))
    )


def decide(target: Column, source: Column, rule: Column, protected: Column | bool = False, target_kind: str = "string", source_kind: str = "string") -> Column:
    """struct(action, policy, reason, will_write); action: skip, equal, conflict, fill or overwrite."""
    return decide_keys(V.key(target, target_kind), V.key(source, source_kind), V.target_blank(target, target_kind), V.source_blank(source, source_kind), rule, protected)


def decide_append(source: Column, source_kind: str = "string") -> Column:
    """The verdict for a cell of a new row: filled unless blank."""
    return decide(F.lit(None).cast("string"), source, F.lit("fill_blank"), False, "string", source_kind)

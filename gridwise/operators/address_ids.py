"""Address ids: rows of one address share an id; ids that are missing are made, those that conflict block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def make_id(key: Column) -> Column:
    """An id in UUID's shape that depends on the key only, so a plan can be made again."""
    h = F.sha2(key, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def groups(rows: DataFrame, key: str, existing: str, order: str) -> DataFrame:
    """key, n_rows, first_row, ids, status, proposed_id: status is new, reuse or conflict (an address with several ids)."""
    t = rows.select(F.col(key).alias("key"), V.text(F.col(existing)).alias("id"), F.col(order).alias("o")).filter("key <> ''")
    out = t.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("o").alias("first_row"), F.array_sort(F.collect_set(F.when(F.col("id") != "", F.col("id")))).alias("ids"))
    n = F.size("ids")
    status = F.when(n == 0, "new").when(n == 1, "reuse").otherwise("conflict")
    proposed = F.when(n == 0, make_id(F.col("key"))).when(n == 1, F.element_at("ids", 1)).otherwise("")
    return out.select("key", "n_rows", "first_row", F.array_join("ids", ", ").alias("ids"), status.alias("status"), proposed.alias("proposed_id"))


def shared_ids(rows: DataFrame, key: str, existing: str) -> DataFrame:
    """id, n_keys: ids that more than one address has."""
    t = rows.select(F.col(key).alias("key"), V.text(F.col(existing)).alias("id")).filter("key <> '' and id <> ''")
    return t.groupBy("id").agg(F.countDistinct("key").alias("n_keys")).filter("n_keys > 1")


def blocks(rows: DataFrame, key: str, existing: str, order: str) -> DataFrame:
    """kind, name, n: what stands in the way of :func:`backfill`: addresses with n ids, and ids of n addresses."""
    several = groups(rows, key, existing, order).filter("status = 'conflict'").select(F.lit("address with several ids").alias("kind"), F.col("key").alias("name"), F.size(F.split("ids", ", ")).cast("long").alias("n"))
    return several.unionByName(shared_ids(rows, key, existing).select(F.lit("id of several addresses").alias("kind"), F.col("id").alias("name"), F.col("n_keys").alias("n")))


def backfill(rows: DataFrame, key: str, existing: str, order: str) -> DataFrame:
    """The rows with blank ids filled; an error if any address or id is in conflict."""
    plan = groups(rows, key, existing, order)
    if not plan.filter("status = 'conflict'").isEmpty() or not shared_ids(rows, key, existing).isEmpty():
        raise ValueError("addresses with several ids, or ids with several addresses, must be settled first")
    new = plan.select(F.col("key").alias("_key"), "proposed_id")
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    filled = F.when(V.text(F.col(existing)) == "", F.coalesce("proposed_id", F.lit(""))).otherwise(F.col(existing))
    return joined.withColumn(existing, filled).select(*rows.columns)


def backfill_residents(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """Blank identities filled with ids made of the given columns."""
    blank = V.identity(F.col(key)) == ""
    return rows.withColumn(key, F.when(blank, make_id(F.concat_ws("\u0001", *[V.text(F.col(c)) for c in by]))).otherwise(F.col(key)))

"""One output for each zone, and the manifest of what is in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V


def contact_names(c: Column) -> Column:
    """Names of a text, split at ; as an array of trimmed, non-blank ones."""
    return F.filter(F.transform(F.split(V.text(c), ";"), V.trim), lambda x: x != "")


def manifest(rows: DataFrame, zone: str, contact: str, order: str, prefix: str = "") -> DataFrame:
    """zone, n_rows, contacts, file_name, status: the distinct contacts (letter case aside) in order of first appearance."""
    t = rows.select(V.text(F.col(zone)).alias("zone"), F.col(order).alias("o"), contact_names(F.col(contact)).alias("names")).filter("zone <> ''")
    size = t.groupBy("zone").agg(F.count("*").alias("n_rows"))
    each = t.select("zone", "o", F.posexplode("names").alias("p", "name")).groupBy("zone", F.lower("name").alias("k")).agg(F.min(F.struct("o", "p", "name")).alias("f"))
    named = each.groupBy("zone").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["name"]), ", ").alias("contacts"))
    name = V.safe_name(F.concat_ws(" - ", *([F.lit(prefix)] if prefix else []), F.col("zone"), F.nullif(F.col("contacts"), F.lit(""))))
    out = size.join(named, "zone", "left").withColumn("contacts", F.coalesce("contacts", F.lit("")))
    return out.select("zone", "n_rows", "contacts", name.alias("file_name"), F.lit("ok").alias("status"))


def with_requested(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The manifest for the wanted zones, those without rows included."""
    out = wanted.select("zone").distinct().join(found, "zone", "left")
    return out.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "contacts": F.coalesce("contacts", F.lit("")), "file_name": F.coalesce("file_name", F.lit("")), "status": F.coalesce("status", F.lit("No rows"))})


def write(rows: DataFrame, zone: str, path: str, fmt: str = "parquet") -> None:
    """A folder for each zone. Rows are dealt by zone, but a zone with many of them is split over several tasks."""
    rows.hint("rebalance", F.col(zone)).write.partitionBy(zone).mode("overwrite").format(fmt).option("maxRecordsPerFile", 1_000_000).save(path)


def written(spark: SparkSession, zone: str, path: str, fmt: str = "parquet") -> DataFrame:
    """zone, n_rows, n_files of what :func:`write` wrote, from the files."""
    found = spark.read.format(fmt).load(path).select(F.col(zone).cast("string").alias("zone"), F.col("_metadata.file_path").alias("file"))
    return found.groupBy("zone", "file").agg(F.count("*").alias("n")).groupBy("zone").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"))

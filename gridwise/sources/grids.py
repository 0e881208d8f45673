"""Sheets as DataFrames: grids of a folder read one by one, in long form, with errors kept apart.

Every cell is read as text (ids and postal codes are never coerced). Header rows may hold blank and repeated names: the
first of equal headers wins, others get their position. A sheet that can't be read has a status row and no data rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as V
from ..operators import headers as H
from . import working

FORMATS = ("csv", "json", "parquet", "orc")
STATUS = "sheet string, path string, ordinal int, error string"


def files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(sheet, path) of a folder's entries by name, letter case aside: the order in which the first sheet wins."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    paths = [(f.getPath().getName(), f.getPath().toString()) for f in found]
    names = [(n.rsplit(".", 1)[0], p) for n, p in paths if not n.startswith(("_", "."))]
    return sorted(names, key=lambda x: (x[0].lower(), x[0]))


def header(spark: SparkSession, path: str, fmt: str = "csv") -> list[str]:
    """The header row as it stands."""
    if fmt == "csv":
        row = spark.read.option("header", False).option("multiLine", True).csv(path).first()
        return H.trimmed(row) if row else []
    return H.trimmed(spark.read.format(fmt).load(path).columns)


def read(spark: SparkSession, path: str, fmt: str = "csv", sheet: str = "") -> DataFrame:
    """sheet, sheet_row (the header is row 1) and a text column for each header of one grid file."""
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    if fmt == "csv":
        names = H.unique(header(spark, path))
        schema = ", ".join(f"`{n}` string" for n in names)
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
        at = {"_file": F.col("_file"), "_block": F.col("_block"), "_at": F.monotonically_increasing_id()}
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in df.columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    cells = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns if fmt == "csv" or c not in ("_file", "_block")}
    if fmt == "csv":
        # One CSV file is one sheet of bounded size; its rows are numbered in file order.
        numbered = df.withColumns(cells).withColumn("_place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    else:
        # A table of any size: in the order of its files and of the rows in them.
        keys = ("_file", "_block", "_at")
        numbered = working.placed(df.withColumns(cells).withColumns(at).repartitionByRange(*keys).sortWithinPartitions(*keys), "_place")
    return numbered.select(F.lit(sheet).alias("sheet"), (F.col("_place") + 2).cast("int").alias("sheet_row"), *[F.col(f"`{c}`") for c in cells])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", sheet: str = "sheet") -> DataFrame:
    """All sheets from one table that has a column for the sheet already: the layout for large data."""
    return spark.read.format(fmt).load(path).withColumnRenamed(sheet, "sheet")


def read_folder(spark: SparkSession, folder: str, fmt: str = "csv") -> tuple[DataFrame | None, DataFrame, dict[str, list[str]]]:
    """(all sheets in long form, a status for each, headers by sheet). A bad file never fails the others."""
    parts, states, found = [], [], {}
    for k, (name, path) in enumerate(files(spark, folder)):
        try:
            names = header(spark, path, fmt)
            if not any(names):
                raise ValueError("the sheet has no header")
            part = read(spark, path, fmt, name)
            part.limit(1).collect()
            parts.append(part)
            found[name] = names
            states.append((name, path, k, ""))
        except Exception as e:
            states.append((name, path, k, str(e).splitlines()[0][:500] or type(e).__name__))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return whole, spark.createDataFrame(states, STATUS), found


def rename_to_fields(df: DataFrame, fields: list[H.Field]) -> DataFrame:
    """Columns under their logical fields' names."""
    own = [c for c in df.columns if c not in ("sheet", "sheet_row")]
    return df.withColumnsRenamed({m.header: m.field for m in H.resolve(own, fields) if m.found})


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, feature (text) of a GeoJSON feature collection, for :func:`gridwise.operators.zones.from_geojson`."""
    whole = spark.read.text(path, wholetext=True)
    feature = "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"
    parsed = whole.select(F.posexplode(F.from_json("value", f"features array<{feature}>")["features"]).alias("ordinal", "f"))
    shaped = F.concat(F.lit('{"geometry":'), F.when(F.col("f.geometry").isNull(), "null").otherwise(F.concat(F.lit('{"type":"'), F.col("f.geometry.type"), F.lit('","coordinates":'), F.coalesce(F.col("f.geometry.coordinates"), F.lit("null")), F.lit("}"))), F.lit(',"properties":'), F.coalesce(F.to_json("f.properties"), F.lit("{}")), F.lit("}"))
    return parsed.select("ordinal", shaped.alias("feature"))


def settings(rows: Mapping[str, str] | list[tuple[str, str]]) -> dict[str, str]:
    """Keys and values of a settings table; placeholder rows, in round brackets, are left out."""
    pairs = rows.items() if isinstance(rows, Mapping) else rows
    return {str(k).strip(): str(v or "").strip() for k, v in pairs if k and not str(k).strip().startswith("(")}


def choose(spark: SparkSession, folder: str, sheet: str = "") -> tuple[str, str]:
    """(sheet, path) of a named entry, or of the first one if no name is given."""
    found = files(spark, folder)
    wanted = [x for x in found if x[0] == sheet.strip()] if sheet.strip() else found[:1]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r} in {folder}")
    return wanted[0]


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """sheet, path, ordinal, bytes of a folder's entries."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [(name, path, k, fs.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(path)).getLength()) for k, (name, path) in enumerate(files(spark, folder))]
    return spark.createDataFrame(rows, "sheet string, path string, ordinal int, bytes bigint")


def report_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A report's rows without those that only hold a message: at most one filled cell, and a first one that is blank, says that
    something was skipped, or that none was found."""
    first = V.text(F.col(columns[0]))
    filled = sum((F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1).otherwise(0) for c in columns), F.lit(0))
    message = (first == "") | first.rlike(r"(?i)^no .*found\.?$") | first.rlike("(?i)skipped")
    return rows.filter(~((filled <= 1) & message))

"""A folder of JSON grids, ``{"tab": name, "values": [[header, ...], [cell, ...], ...]}``, read in one job, with errors kept apart.

The files are read by Spark's own text reader, a file a row and many small files a task, so any store that Spark reads will do; they
are parsed by built-in functions, and written once as a working table that headers, statuses and rows are read from. Cells are text:
numbers and booleans as the file spells them, nulls and missing cells empty. A sheet is called by its tab, or else by its file's name;
sheets are in order of their names, letter case aside, and of equal names the first file by path counts, others have a status only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import working

GRID = "tab string, values array<array<string>>, _broken string"
# Why a file gives no rows.
NOT_JSON, NO_VALUES, NO_HEADER, REPEATED = "the file isn't a JSON grid", "the grid has no values", "the sheet has no header", "a sheet of this name was read already"


def _heads(values: Column) -> Column:
    """The header row's names for columns: blanks and later equal headers get their position."""
    trimmed = F.transform(F.coalesce(F.get(values, F.lit(0)), F.array().cast("array<string>")), lambda h: F.trim(F.coalesce(h, F.lit(""))))
    return F.transform(trimmed, lambda h, k: F.when((h == "") | (F.array_position(trimmed, h) != k + 1), F.concat(F.lit("c"), k.cast("string"))).otherwise(h))


def _empty(spark: SparkSession, folder: str) -> DataFrame:
    """path, file, value of files without a byte, which Spark's readers pass over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    every, found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while every.hasNext():
        f = every.next()
        if not f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getPath().getName(), ""))
    return spark.createDataFrame(found, "path string, file string, value string")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """sheet, path, ordinal, error, heads, cells of each file: a working table. ``heads`` and ``cells`` are null where there is an error."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")
    raw = raw.unionByName(_empty(spark, folder))
    g = F.from_json("value", GRID, {"columnNameOfCorruptRecord": "_broken"})
    read = raw.withColumn("g", g)
    values, name = F.col("g.values"), F.coalesce(F.nullif(F.trim("g.tab"), F.lit("")), F.regexp_replace("file", r"\.[^.]*$", ""))
    blank = ~F.exists(F.coalesce(F.get(values, F.lit(0)), F.array().cast("array<string>")), lambda h: F.trim(F.coalesce(h, F.lit(""))) != "")
    error = F.when(F.col("g").isNull() | F.col("g._broken").isNotNull(), NOT_JSON).when(values.isNull() | (F.size(values) == 0), NO_VALUES).when(blank, NO_HEADER).otherwise("")
    rows = read.select(name.alias("sheet"), "path", error.alias("error"), _heads(values).alias("heads"), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))).alias("cells"))
    whole = working.table(rows, "grids")
    # The order of sheets: a narrow row a file.
    order = whole.select("path", "sheet", "error").withColumn("ordinal", (F.row_number().over(Window.orderBy(F.lower("sheet"), "sheet", "path")) - 1).cast("int"))
    again = F.row_number().over(Window.partitionBy("sheet", F.col("error") == "").orderBy("path")) > 1
    order = order.withColumn("_error", F.when((F.col("error") == "") & again, REPEATED).otherwise(F.col("error"))).select("path", "ordinal", "_error")
    out = whole.join(order, "path")
    good = F.col("_error") == ""
    return out.select("sheet", "path", "ordinal", F.col("_error").alias("error"), F.when(good, F.col("heads")).alias("heads"), F.when(good, F.col("cells")).alias("cells"))


def statuses(grids: DataFrame) -> DataFrame:
    """sheet, path, ordinal, error, data_rows of each file of :func:`parsed`."""
    return grids.select("sheet", "path", "ordinal", "error", F.when(F.col("error") == "", F.size("cells")).cast("bigint").alias("data_rows"))


def headers(grids: DataFrame) -> dict[str, list[str]]:
    """The headers by sheet, in the sheets' order."""
    rows = grids.filter("error = ''").select("ordinal", "sheet", "heads").orderBy("ordinal").collect()  # a header row a sheet
    return {r["sheet"]: r["heads"] for r in rows}


def rows(grids: DataFrame, columns: list[str]) -> DataFrame:
    """sheet, sheet_row (the header is row 1) and ``columns`` as text; a column that a sheet lacks is null there.

    Only the cells of these columns are looked at; rows without any cell stay, as they have a number.
    """
    long = grids.filter("error = ''").select("sheet", "heads", F.posexplode("cells").alias("_at", "_row"))
    cells = [F.when(F.array_position("heads", c) > 0, F.coalesce(F.get("_row", (F.array_position("heads", c) - 1).cast("int")), F.lit(""))).alias(c) for c in columns]
    return long.select("sheet", (F.col("_at") + 2).cast("int").alias("sheet_row"), *cells)


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """(all sheets in long form, a status for each file, headers by sheet)."""
    grids = parsed(spark, folder)
    found = headers(grids)
    return rows(grids, list(dict.fromkeys(c for h in found.values() for c in h))), statuses(grids), found


def write_folder(sheets: DataFrame, folder: str, columns: list[str]) -> None:
    """Sheets (sheet, sheet_row and ``columns``) as a folder of JSON grids, a file a sheet."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("sheet_row", cells.alias("cells")))), lambda r: r["cells"])
    grid = F.to_json(F.struct(F.col("sheet").alias("tab"), F.concat(F.array(F.array(*map(F.lit, columns))), "lines").alias("values")))
    # One grid file is one sheet, which whoever reads it holds as a whole.
    sheets.groupBy("sheet").agg(lines.alias("lines")).select(F.col("sheet").alias("_sheet"), grid.alias("value")).write.partitionBy("_sheet").text(folder)

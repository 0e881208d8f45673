"""Tables between the steps of an operator, in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``. Where that is unset, a local session (tests, a laptop) gets a temporary folder, and
a cluster an error, since its executors share no local folder. A written table cuts lineage and survives lost executors,
and Parquet keeps column pruning, which a checkpoint lacks. Operators drop the tables that no later plan reads; those that
a result still reads stay until :func:`clear`. Shuffle files go as soon as the table that they were for is written.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder, with this library's own subfolder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="gridwise-"))
    return f"{top.rstrip('/')}/gridwise/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions in this block leave no shuffle files; the written table replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df``, with ``options`` of the writer, and read it again."""
    path = folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def extend(df: DataFrame, more: DataFrame) -> None:
    """Append rows to a table that :func:`table` wrote; :func:`again` reads it with them."""
    with tidy(df.sparkSession):
        more.select(*df.columns).write.mode("append").option("compression", "zstd").parquet(df._scratch)


def again(df: DataFrame) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(df._scratch)
    out._scratch = df._scratch
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`table` wrote and no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def prefix(spark: SparkSession) -> str:
    """How the names of this application's bucketed tables in the catalog begin."""
    return "gridwise_scratch_" + re.sub("[^a-z0-9]", "_", spark.sparkContext.applicationId.lower()) + "_"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; results that still read them are lost."""
    for row in spark.catalog.listTables():
        if row.name.startswith(prefix(spark)):
            spark.sql(f"drop table {row.name}")
    _delete(spark, root(spark))

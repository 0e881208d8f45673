"""Working tables: what a plan has to read twice in the same form is written once, in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``; where that is unset, a local session gets a temporary folder, and a cluster an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """This application's folder for working tables."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="gridwise-"))
    return f"{top.rstrip('/')}/gridwise-working/{app}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column of each row's place over all its partitions, from 0, in the order that the partitions have.

    A prefix sum in two phases: rows are written once, each with its part and its place there; a part starts after those before it.
    Places and sizes are read from the same written table, so no new deal of rows can part them.
    """
    # The id holds the part in its upper bits and the place in the part in the lower 33.
    written = table(df.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a part
    out = written.join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def clear(spark: SparkSession) -> None:
    """Delete this application's working tables; results that still read them are lost."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

"""What the session has to provide: folders for tables and files that a query writes and reads back, and sound unions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder where spark.checkpoint.dir says, which driver and executors share; a temporary one only where that isn't
    set and all run in one process. It goes when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenloft-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in a new folder, read back: what several branches read is computed once and not in each of them."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sound_unions(spark: SparkSession) -> SparkSession:
    """Spark 4.1 takes a union of two tables dealt by one key for dealt by it and leaves out the exchange above; where a join
    in one branch then becomes a broadcast at run time, or the branches' partitions are merged apart, rows of one key no
    longer meet. Without that step the exchange stays."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark

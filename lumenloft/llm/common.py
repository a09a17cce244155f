"""Helpers that the operators of this folder share."""

from __future__ import annotations

import hashlib
import inspect
import io
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither blanks nor the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_context.isDefined():
        return set_by_context.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="lumenloft-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str, instead_of: Sequence[DataFrame] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives the loss of executors.

    The files go when the JVM ends, or once a table that was made from them is written `instead_of` them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    for old in instead_of:
        forget(old)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote; nothing may read it any more."""
    if path := getattr(df, "_written_at", None):
        system, where = _file_system(df.sparkSession, path)
        system.delete(where, True)
        df._written_at = None


def fitted(spark: SparkSession, name: str, of: object, fit: Callable[[], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays of a fitted model, kept in the shared folder under a digest of the code and the parameters (`of`) that
    made them, so that each is fitted once for a cluster."""
    digest = hashlib.blake2b(inspect.getsource(inspect.getmodule(fit)).encode() + repr(of).encode(), digest_size=12).hexdigest()
    path = f"{shared_dir(spark)}/models/{name}-{digest}"
    system, where = _file_system(spark, path)
    if not system.exists(where):
        data = io.BytesIO()
        np.savez(data, **fit())
        new = f"{path}-{uuid.uuid4().hex}"
        spark.createDataFrame([(data.getvalue(),)], "data binary").coalesce(1).write.parquet(new)
        if not system.rename(_file_system(spark, new)[1], where):  # another session was first
            system.delete(_file_system(spark, new)[1], True)
    with np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["data"]))) as found:
        return {k: found[k] for k in found.files}


def replayable(df: DataFrame) -> bool:
    """Whether two passes over df see the same rows in the same order: columns and filters of files, no more."""
    plan = df._jdf.queryExecution().optimizedPlan()
    steps = [line for line in plan.toString().splitlines() if line.strip()]
    return plan.deterministic() and all(re.match(r"[\s:+-]*(?:Project|Filter|Relation|RelationV2)\b", line) for line in steps)


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of `column` reach `most` bytes; a longer text stands alone."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{c}`") for c in columns])

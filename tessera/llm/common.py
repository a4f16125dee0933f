"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a maximal run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"
SPACE_JAVA = r"[\x20\x09-\x0D]+"

#: Text bytes handled at once inside a Python worker.
SLICE_BYTES = 2 << 20


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text) if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def durable(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and reread it.

    Lineage ends here: a lost executor costs its running tasks, not the work before.
    Files go under the application's id, so a finished application's folder can be removed.
    Shuffle files of earlier steps, which nothing refers to any more, are let go first.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a ``durable`` frame that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterable[pa.RecordBatch], column: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about SLICE_BYTES, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.nbytes)
        step = max(1, int(batch.num_rows * SLICE_BYTES / size)) if size > SLICE_BYTES else batch.num_rows
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted

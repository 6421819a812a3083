"""What the corpus operators share: table access, lineage cuts and row helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A driver table, read by Spark alone (the path may name any store), pruned to ``cols``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only on a local master (tests, a laptop) is a temporary folder made and set where that is unset; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Steps of a loop as tables in the shared folder.

    A checkpointed frame keeps the size that the optimiser guessed for it, and a join's guess is the product of its
    sides': in a loop of joins that number doubles its digits with every step, and planning ends up multiplying numbers
    of millions of digits. A table that was written and is read again has the size of its files. ``drop`` deletes the tables; what is still needed is
    ``cut`` before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        self.count = 0

    def step(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.base)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot from this many rows on, or from this share of all rows: there are at most 1 / HOT_SHARE hot keys, whatever the data.
HOT_ROWS, HOT_SHARE = 1000, 1 / 4000


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys of ``counted`` (one row a key) that hold many rows: 4,000 at most, as each holds a 4,000th of all."""
    return counted.filter(F.col(key).isNotNull() & (F.col(n) >= max(HOT_ROWS, total * HOT_SHARE))).select(key)


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join with ``right`` (one row a key), whose rows for the ``hot`` keys are broadcast: neither they nor null keys meet in one task.

    A hot key that ``right`` does not hold keeps its rows too, with nulls: what is hot decides on the way of a row, never on the result.
    """
    few = F.broadcast(hot.join(right.join(F.broadcast(hot), key, "left_semi"), key, "left"))
    many = left.join(F.broadcast(hot), key, "left_anti").filter(F.col(key).isNotNull()).join(right.hint("merge"), key, "left")
    none = left.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key))
    return left.join(few, key).unionByName(many).unionByName(none)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(col, n: int):
    """crc32 of the decimal text of ``col``, modulo ``n``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows: what a worker holds as Python objects stays small, whatever Arrow's batch size."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's ``spark.checkpoint.dir``.

    Only a local master, whose executors run in the driver, may do without and gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="veldra-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Makes a folder that goes when the driver ends."""
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def drop_unreferenced(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the files of shuffles and checkpoints that no frame refers to any more.

    It learns of them when the driver collects garbage, which long runs of small jobs give no cause for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of a batch that goes to a Python worker. A batch holds one row at least, however long its text.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session's Python workers by their bytes, unless the session says how.

    Batches are held several times over, by the executor and by the worker; 10,000 rows of texts are any number of bytes.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(taken: Iterable[str], base: str) -> str:
    """A column name that clashes with none of ``taken``, case ignored."""
    used = {x.lower() for x in taken}
    name = base
    while name.lower() in used:
        name += "_"
    return name


_settled = False


def settle() -> None:
    """Once a worker: keeps the collector off what it shares with its parent, so that those pages stay shared."""
    global _settled
    if not _settled:
        gc.freeze()
        _settled = True


def release() -> None:
    """Gives memory back to the system. Python workers live on and are used by other operators."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function of a task's batches that releases its memory at the end."""

    def go(batches: Iterable) -> Iterator:
        settle()
        try:
            yield from run(batches)
        finally:
            release()

    return go

"""What the operators of this subpackage share: tables, materialised steps, limits on Arrow batches."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.steps import bound_batches  # noqa: F401  the operators take it from here

#: White space of the contracts, as a Java or RE2 character class.
SPACE = r"[\x20\x09-\x0D]"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark (any store)."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at least; inputs of more partitions, as large ones are, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of our own that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own where that is unset and Spark runs on one machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        spark.sparkContext.setCheckpointDir("/tmp/textloom-checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: later steps start from files that outlive executors, so the shuffle files of this
    one are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop(df: DataFrame) -> None:
    """Delete the files of a materialised step that nothing reads any more."""
    path = getattr(df, "_textloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps before the next large one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the session may be half closed; the folder is the cluster's to clear
                return


def raw(column: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")

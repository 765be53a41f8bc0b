"""How rows are laid out between operators: spread over the cores, read by Python in small batches, and materialised in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows in one Arrow batch; with whole texts in a row, Spark's default of 10,000 would not bound a worker's memory.
ARROW_ROWS = 500
#: Rows that a file's function gives before they leave the worker.
FRAME_ROWS = 2_000


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the folder that driver and executors share."""
    _share(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def step(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: later rounds start from files that outlive executors."""
    _share(df.sparkSession)
    return df.checkpoint()


def _share(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or "/tmp/textloom-checkpoints")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at least, since one file of one row group is read by one task.

    Inputs that have more partitions, as large ones do, stay as they are and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over four partitions a core at least, and as many as it has: small rows can be much work, so Spark is not to merge them by their bytes."""
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n, key)


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the rows of an Arrow batch to ``rows`` and its bytes to 16 MB where they are more."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key).upper().removesuffix("B")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def by_file(files: DataFrame, columns: list[str], rows_of: Callable[..., Iterable[tuple]], schema: StructType | str, types: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``schema`` that ``rows_of`` gives for the ``columns`` of each row of ``files``, in Python; ``types`` are pandas' for columns with nulls.

    Batches in both directions are bounded, so a worker holds some texts and some rows, however large a partition is.
    """
    bound_batches(files.sparkSession)
    names = schema.names if isinstance(schema, StructType) else [x.split()[0] for x in schema.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(types or {})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(batch[c] for c in columns), strict=True):
                for row in rows_of(*values):
                    rows.append(row)
                    if len(rows) == FRAME_ROWS:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    return files.select(*columns).mapInPandas(mapped, schema)

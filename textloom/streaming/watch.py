"""Rules over files as they arrive.

Line rules, suppression on the same line and file-local checks need one file at a time, so they run on an
unbounded stream without state; each file's latest findings replace its earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTENSIONS, ScanConfig
from ..functions.text import explode_lines
from ..operators.lines import mark_suppressed, occurrences
from ..operators.prune import prune
from ..plans.catalogue import rules


def arriving_files(spark: SparkSession, directory: str, per_trigger: int = 1000) -> DataFrame:
    """FILES-like rows of a directory's text files as they arrive, with modified, their event time."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(directory)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def arriving_lines(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, line)`` of a stream of text files."""
    return spark.readStream.option("recursiveFileLookup", "true").text(directory).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def stream_counts(files: DataFrame, config: ScanConfig | None = None, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of unsuppressed occurrences by rule and window of arrival; files later than ``late`` are dropped by the watermark."""
    config = config or ScanConfig()
    chosen = [r for r in rules(config) if r.kind == "line"]
    kept = prune(files, config)
    lines = explode_lines(kept.select("path", "lang", "modified", "text").withWatermark("modified", late))
    text = F.lower("line")
    hidden = F.lit(False)
    for m in config.markers:
        hidden |= text.contains(m.lower())
    found = _with_time(lines.where(~hidden), chosen)
    return found.groupBy(F.window("modified", window), "lang", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def _with_time(lines: DataFrame, chosen: list) -> DataFrame:
    packed = lines.withColumn("line_no", F.struct("line_no", "modified"))
    return occurrences(packed, chosen).select("lang", "rule_id", "path", F.col("line_no.line_no").alias("line_no"), F.col("line_no.modified").alias("modified"), "code")


def watch(files: DataFrame, target: str, checkpoint: str, config: ScanConfig | None = None):
    """Start a query that writes the occurrences of each batch's files below ``target``, a folder a batch.

    A batch that is run again writes the same folder again, so results are there once.
    """
    config = config or ScanConfig()
    chosen = [r for r in rules(config) if r.kind == "line"]

    def write(batch: DataFrame, number: int) -> None:
        lines = mark_suppressed(explode_lines(prune(batch, config).select("path", "lang", "text")), config.markers, config.suppress_previous_line)
        occurrences(lines, chosen).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """Occurrences of each path's latest batch."""
    every = spark.read.parquet(target)
    last = every.groupBy("path").agg(F.max("batch").alias("batch"))
    return every.join(last, ["path", "batch"], "left_semi")


def known_extensions() -> tuple[str, ...]:
    """Extensions that a watched directory is read for."""
    return tuple(e for exts in EXTENSIONS.values() for e in exts)

"""Source trees as DataFrames: a data source that prunes while it walks, and the lists that narrow it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import EXTENSIONS, MARKERS, ScanConfig
from ..functions.text import glob_regex
from ..schemas import FILES
from .steps import step

#: Manifests and settings that are read whatever their extension; fixed values.
MANIFESTS = ("requirements.txt", "Cargo.toml", "go.mod", "mix.lock", "CMakeLists.txt", "package.json", "pyproject.toml", "Gemfile")
#: Ignore rules of version control, which sources.versions reads.
_IGNORES = (".gitignore",)
_SETTINGS = ("plist", "entitlements", "xcprivacy")


@dataclass
class FileGroup(InputPartition):
    paths: tuple[str, ...]


class SourceTree(DataSource):
    """``spark.read.format("sourcetree")``: FILES below ``path``, hidden ones and those with a leading underscore too.

    Options: path; ignores (globs, by commas); extensions (by commas; empty for all); maxFileBytes; groupBytes
    (bytes of a partition); manifests (true to read dependency manifests, settings and ignore rules too);
    maxProjectBytes (more than that below the path is refused; 0 for no limit). Ignored directories
    are not entered, and files are dropped by name and size before they are read. The path must be a file
    system that driver and executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        globs = [g for g in options.get("ignores", "").split(",") if g]
        self.ignored = re.compile(f"(?s)(?:{'|'.join(map(glob_regex, globs))})\\Z") if globs else None
        self.extensions = {e for e in options.get("extensions", "").split(",") if e}
        self.most = int(options.get("maxFileBytes", ScanConfig.max_file_bytes))
        self.group = int(options.get("groupBytes", 4 << 20))
        self.limit = int(options.get("maxProjectBytes", 0))
        self.manifests = options.get("manifests", "true") == "true"
        self.languages = {e: lang for lang, exts in EXTENSIONS.items() for e in exts}

    def _out(self, relative: str) -> bool:
        return self.ignored is not None and (self.ignored.match(relative) is not None or self.ignored.match(os.path.basename(relative)) is not None)

    def _wanted(self, name: str) -> bool:
        ext = name.rpartition(".")[2].lower()
        return not self.extensions or ext in self.extensions or self.manifests and (name in MANIFESTS or name in _MARKED or name in _IGNORES or ext in _SETTINGS)

    def partitions(self) -> list[FileGroup]:
        groups, now, size, total = [], [], 0, 0
        if os.path.isfile(self.root):
            return [FileGroup((os.path.basename(self.root),))]
        for base, dirs, names in os.walk(self.root):
            below = os.path.relpath(base, self.root)
            at = lambda n: n if below == "." else f"{below}/{n}"  # noqa: B023, E731
            dirs[:] = sorted(d for d in dirs if not self._out(at(d)))
            for name in sorted(names):
                if self._wanted(name) and not self._out(at(name)):
                    n = os.path.getsize(os.path.join(base, name)) if os.path.exists(os.path.join(base, name)) else self.most + 1
                    if n <= self.most:
                        if now and size + n > self.group:
                            groups.append(FileGroup(tuple(now)))
                            now, size = [], 0
                        now.append(at(name))
                        size += n
                        total += n
        if self.limit and total >= self.limit + (1 << 20):
            raise ValueError(f"{total >> 20} MB are to be scanned; the limit is {self.limit >> 20}")
        return [*groups, FileGroup(tuple(now))] if now or not groups else groups

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        root = os.path.dirname(self.root) if os.path.isfile(self.root) else self.root
        for path in partition.paths:
            data = Path(root, path).read_bytes()
            ext = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else None
            # Malformed bytes become replacement characters, as a text file must not stop a scan.
            yield path, self.languages.get(ext), ext, len(data), data.decode("utf-8", "replace")


def listed_tree(spark: SparkSession, root: str, config: ScanConfig | None = None, most_levels: int = 10_000) -> DataFrame:
    """``(path, n_bytes)`` of a tree's files, listed by tasks: a level of directories after another, each dealt over the cluster.

    Rules are those of ``sourcetree``, whose listing is the driver's alone; links to directories are not followed.
    """
    config = config or ScanConfig()
    guard_root(root)
    options = {"path": root, "ignores": ",".join(config.ignores), "extensions": ",".join(e for exts in config.extensions.values() for e in exts), "maxFileBytes": str(config.max_file_bytes)}

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(options)
        for batch in batches:
            rows = []
            for below in batch["path"]:
                for entry in os.scandir(os.path.join(reader.root, below)):
                    at = f"{below}/{entry.name}" if below else entry.name
                    if reader._out(at):
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        rows.append((at, 0, True))
                    elif reader._wanted(entry.name) and entry.is_file() and entry.stat().st_size <= reader.most:
                        rows.append((at, entry.stat().st_size, False))
            yield pd.DataFrame(rows, columns=["path", "n_bytes", "folder"])

    level = spark.createDataFrame([("",)], "path string")
    files = spark.createDataFrame([], "path string, n_bytes long")
    for _ in range(most_levels):
        found = step(level.mapInPandas(listed, "path string, n_bytes long, folder boolean"))
        files = files.unionByName(found.where("NOT folder").drop("folder"))
        folders = found.where("folder").select("path")
        n = folders.count()
        if not n:
            return files
        level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    raise ValueError(f"{root} is deeper than {most_levels} levels")


def read_listed(files: DataFrame, root: str) -> DataFrame:
    """FILES of ``files(path, n_bytes)`` below ``root``, read by tasks; large files are spread by their size."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader({"path": root})
        for batch in batches:
            for path in batch["path"]:  # one file at a time
                yield pd.DataFrame(reader.read(FileGroup((path,))), columns=FILES.names)

    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // (32 << 20)))
    return files.repartition(parts, F.xxhash64("path")).select("path").mapInPandas(read, FILES)


_MARKED = frozenset(m for names in MARKERS.values() for m in names)


def read_tree(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """FILES of a tree under a scan's ignores, extensions and size limit; a home directory and the whole machine are refused."""
    config = config or ScanConfig()
    guard_root(root)
    spark.dataSource.register(SourceTree)
    extensions = ",".join(e for exts in config.extensions.values() for e in exts)
    return spark.read.format("sourcetree").option("ignores", ",".join(config.ignores)).option("extensions", extensions).option("maxFileBytes", str(config.max_file_bytes)).option("maxProjectBytes", str(config.max_project_mb << 20)).load(root)


def read_targets(spark: SparkSession, roots: list[str], config: ScanConfig | None = None) -> DataFrame:
    """FILES of several targets, paths with their root in front: ignores hold in directories, not for files that are named; each path once."""
    from ..operators.prune import targets

    config = config or ScanConfig()
    none = spark.createDataFrame([], FILES)
    trees, named = none, none
    for root in roots:
        files = read_tree(spark, root, config)
        if os.path.isfile(root):
            named = named.unionByName(files.withColumn("path", F.lit(root)))
        else:
            trees = trees.unionByName(files.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path")))
    return targets(trees, named, config)


def guard_root(root: str) -> None:
    """Refuse to scan a home directory or the whole machine."""
    where = os.path.realpath(root)
    if where in ("/", os.path.realpath(os.path.expanduser("~"))):
        raise ValueError(f"{root} is not a project; name a directory below it")


def read_ignores(spark: SparkSession, path: str) -> list[str]:
    """Globs of an ignore file in order, each once: no comments, no leading ``./``, no trailing slash."""
    # A driver step through Hadoop's file systems: Spark's readers pass over names that begin with a dot.
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        lines = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    globs = [x.strip().removeprefix("./").rstrip("/") for x in lines]
    return list(dict.fromkeys(g for g in globs if g and not g.startswith("#")))


def table_as_files(table: DataFrame, path: str, text: str, lang: str | None = None) -> DataFrame:
    """Any table of texts as FILES: ``path`` is the key's column, ``lang`` a column or nothing."""
    return table.select(F.col(path).cast("string").alias("path"), (F.col(lang).cast("string") if lang else F.lit("text")).alias("lang"), F.lit(None).cast("string").alias("ext"), F.octet_length(text).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))


def listed_paths(spark: SparkSession, listing: str) -> DataFrame:
    """``(path)`` of a comma list, without empty names."""
    names = [(p.strip(),) for p in listing.split(",") if p.strip()]
    return spark.createDataFrame(names, "path string").distinct()


def paths_from(spark: SparkSession, file: str) -> DataFrame:
    """``(path)`` of a file with one path a line."""
    return spark.read.text(file).select(F.trim("value").alias("path")).where("path <> ''").distinct()


def changed_paths(status: DataFrame, value: str = "value", kinds: str = "ACMR") -> DataFrame:
    """``(path)`` of changed files from ``git diff --name-status`` lines: added, copied, modified and renamed ones, under their new name."""
    parts = F.split(value, "\t")
    return status.where(F.substring(value, 1, 1).isin(list(kinds))).select(F.element_at(parts, -1).alias("path")).distinct()


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """One row of totals from a combined report; without a readable one all are 0."""
    from pyspark.errors import AnalysisException

    from ..functions.text import count_or_zero
    from ..schemas import REPORT

    try:
        report = spark.read.schema(REPORT).json(path, multiLine=True)
    except AnalysisException:
        report = spark.createDataFrame([], REPORT)
    return report.select([count_or_zero(F.col("totals")[m]).alias(m) for m in ("files", "critical", "warning", "info")]).agg(*[F.coalesce(F.max(m), F.lit(0)).alias(m) for m in ("files", "critical", "warning", "info")])


def read_text_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The same from a text report: the last count after each severity's name."""
    text = F.col("value")
    last = lambda word: F.coalesce(F.element_at(F.regexp_extract_all(text, F.lit(rf"(?i){word}[^\d\n]*(\d+)"), 1), -1).cast("bigint"), F.lit(0))
    return spark.read.text(path, wholetext=True).select(F.when(F.size(F.regexp_extract_all(text, F.lit(r"(?i)files[^\d\n]*(\d+)"), 1)) > 0, last("files")).otherwise(0).alias("files"), *[F.when(F.size(F.regexp_extract_all(text, F.lit(rf"(?i){w}[^\d\n]*(\d+)"), 1)) > 0, last(w)).otherwise(0).alias(w) for w in ("critical", "warning", "info")])


def manifest_lines(files: DataFrame) -> DataFrame:
    """LINES of dependency manifests, with their language."""
    from ..functions.text import explode_lines

    name = F.element_at(F.split("path", "/"), -1)
    of = [F.lit(x) for kv in {"requirements.txt": "python", "Cargo.toml": "rust", "go.mod": "golang", "mix.lock": "elixir", "CMakeLists.txt": "cpp", "package.json": "js", "Gemfile": "ruby"}.items() for x in kv]
    return explode_lines(files.withColumn("lang", F.try_element_at(F.create_map(*of), name)).where("lang IS NOT NULL").select("path", "lang", "text"))


def notebook_outputs(files: DataFrame) -> DataFrame:
    """``(path, cells, with_output)`` of notebooks, read as JSON; what is no notebook has nulls."""
    cell = "struct<cells:array<struct<cell_type:string,outputs:array<string>>>>"
    j = files.where("endswith(path, '.ipynb')").select("path", F.from_json("text", cell).alias("j"))
    return j.select("path", F.size("j.cells").alias("cells"), F.size(F.filter("j.cells", lambda c: F.size(F.coalesce(c["outputs"], F.array().cast("array<string>"))) > 0)).alias("with_output"))


def sarif_counts(files: DataFrame) -> DataFrame:
    """``(path, files, critical, warning, info)`` of SARIF reports: results by level (none: warning), and distinct files; invalid ones are skipped."""
    schema = "struct<runs:array<struct<results:array<struct<level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>>"
    results = files.select("path", F.from_json("text", schema).alias("j")).where("j.runs IS NOT NULL").select("path", F.explode_outer(F.flatten(F.transform("j.runs", lambda r: F.coalesce(r["results"], F.array().cast("array<struct<level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>"))))).alias("r"))
    level = F.coalesce("r.level", F.lit("warning"))
    there = F.col("r").isNotNull()
    uri = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]["artifactLocation"]["uri"]
    count = lambda c, name: F.count(F.when(there & c, 1)).alias(name)
    return results.groupBy("path").agg(F.count_distinct(uri).alias("files"), count(level == "error", "critical"), count(level == "warning", "warning"), count(~level.isin("error", "warning"), "info"))

"""Which files take part: ignores, extensions, sizes, lists, changes, tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EXTENSIONS, MARKERS, ScanConfig, languages
from ..functions.text import extension, ignored, language_of, perhaps_ignored

#: What the tests in a file begin with.
TEST_MARKER = r"^\s*#\[cfg\(test\)\]|^\s*mod\s+tests\b"


def classify(files: DataFrame, extensions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``files`` with ext and lang from the path."""
    return files.withColumn("ext", extension(F.col("path"))).withColumn("lang", language_of(F.col("ext"), extensions or EXTENSIONS))


def prune(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Files within the ignores, the size limit, the wanted languages and outside the directories that their language leaves out."""
    kept = classify(files, config.extensions)
    if "n_bytes" in files.columns:
        kept = kept.where(F.col("n_bytes") <= config.max_file_bytes)
    wanted = languages(list(config.extensions), list(config.only), list(config.exclude))
    kept = kept.where(F.col("lang").isin(wanted))
    excluded = {lang: globs for lang, globs in config.excluded.items() if globs and lang in wanted}
    folder = F.left("path", F.length("path") - F.length(F.substring_index("path", "/", -1)) - 1)
    each = [~ignored(F.col("path"), config.ignores), *((F.col("lang") != lang) | ~ignored(folder, globs) for lang, globs in excluded.items())]
    # One test of all names lets most files pass; the others are looked at name by name and language by language.
    return kept.where(~perhaps_ignored(F.col("path"), sorted({*config.ignores}.union(*excluded.values()))) | reduce(lambda a, b: a & b, each))


def targets(directories: DataFrame, explicit: DataFrame, config: ScanConfig) -> DataFrame:
    """Files of several targets: ignores hold for those found in directories, not for those named; each path once."""
    named = classify(explicit, config.extensions)
    return prune(directories, config).unionByName(named, allowMissingColumns=True).dropDuplicates(["path"])


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose path is in ``changed``; no rows there, no files here."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def changed_or_all(files: DataFrame, changed: DataFrame | None) -> DataFrame:
    """As changed_only, but all files where no list of changes could be had (None)."""
    return files if changed is None else changed_only(files, changed)


def without(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose path is not in ``paths``, such as those that version control ignores."""
    return files.join(paths.select("path").distinct(), "path", "left_anti")


def detected_languages(files: DataFrame) -> DataFrame:
    """``(lang, n_files)``: a language is there if a file has its extension or is one of its marker files."""
    name = F.element_at(F.split("path", "/"), -1)
    pairs = [F.lit(x) for lang, names in MARKERS.items() for m in names for x in (m, lang)]
    lang = F.coalesce(F.try_element_at(F.create_map(*pairs), name), language_of(extension(F.col("path")), EXTENSIONS))
    return files.select(lang.alias("lang")).where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))


def project_megabytes(files: DataFrame) -> DataFrame:
    """One row: whole megabytes of all files."""
    return files.agg(F.floor(F.coalesce(F.sum("n_bytes"), F.lit(0)) / (1 << 20)).cast("long").alias("megabytes"))


def guard_size(files: DataFrame, config: ScanConfig) -> None:
    """Raise if the project is larger than the limit; a limit of 0 is none."""
    size = project_megabytes(files).first()["megabytes"]
    if config.max_project_mb and size > config.max_project_mb:
        raise ValueError(f"{size} MB are to be scanned; the limit is {config.max_project_mb}")


def suggested_ignores(files: DataFrame, config: ScanConfig, more_than: int = 200) -> DataFrame:
    """``(top_dir, n_files)``: top directories with many files that no ignore covers."""
    top = F.split("path", "/")
    counted = files.where(F.size(top) > 1).groupBy(top[0].alias("top_dir")).agg(F.count(F.lit(1)).alias("n_files"))
    return counted.where((F.col("n_files") > more_than) & ~ignored(F.col("top_dir"), config.ignores))


def before_tests(lines: DataFrame, marker: str = TEST_MARKER) -> DataFrame:
    """Lines before the first test marker of their file."""
    first = F.min(F.when(F.col("line").rlike(marker), F.col("line_no"))).over(Window.partitionBy("path"))
    return lines.withColumn("_first", first).where("_first IS NULL OR line_no < _first").drop("_first")


def outside_test_directories(files: DataFrame, names: tuple[str, ...] = ("tests", "benches")) -> DataFrame:
    """Files without one of the directories in their path."""
    return files.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*names)))


def module_edges(files: DataFrame) -> DataFrame:
    """``(src, dst, gated)``: Rust files and the files of the modules they declare; gated where a declaration is for tests only."""
    declared = r"(?m)^[ \t]*((?:#\[cfg\(test\)\]\s*(?:#\[[^\]]*\]\s*)*)?)(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"
    found = lambda k: F.regexp_extract_all("text", F.lit(declared), k)
    folder, name = F.regexp_replace("path", "[^/]*$", ""), F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    below = F.when(name.isin("mod", "lib", "main"), folder).otherwise(F.concat(folder, name, F.lit("/")))
    rust = files.where("endswith(path, '.rs')")
    modules = rust.where(F.col("text").contains("mod")).select(F.col("path").alias("src"), below.alias("_below"), F.explode(F.arrays_zip(found(1).alias("gate"), found(2).alias("module"))).alias("d"))
    places = F.array(F.concat("_below", "d.module", F.lit(".rs")), F.concat("_below", "d.module", F.lit("/mod.rs")))
    return modules.select("src", (F.col("d.gate") != "").alias("gated"), F.explode(places).alias("dst")).join(rust.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst", "gated")


def test_only_modules(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(path)``: modules that are reached only through gated references or from modules of that kind.

    ``edges`` has (src, dst, gated). A module nobody refers to is not test-only. The set grows from the
    modules all of whose references are gated, a round of joins at a time, until it stays the same.
    """
    from ..sources.steps import step

    edges = step(edges.select("src", "dst", F.col("gated").cast("boolean").alias("gated")).distinct())
    found = step(edges.groupBy("dst").agg(F.min("gated").alias("all")).where("all").select(F.col("dst").alias("path")))
    n = found.count()
    for _ in range(most_rounds):
        open_ = edges.where("NOT gated").join(found, F.col("src") == F.col("path"), "left_anti").select("dst").distinct()
        found = step(edges.select("dst").distinct().join(open_, "dst", "left_anti").select(F.col("dst").alias("path")))
        before, n = n, found.count()
        if n == before:
            return found
    raise RuntimeError(f"the set of test-only modules did not settle in {most_rounds} rounds")


def any_of(column: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found."""
    return reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns), F.lit(False))

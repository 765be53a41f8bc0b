"""What version control says of files: ignore rules, and changes since a branch was left."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import by_file
from .tree import changed_paths

IGNORE_FILE = ".gitignore"
_RULES = "base string, k int, pattern string, keeps boolean, directories boolean"


def ignore_pattern(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression over the path below the ignore file, whether it keeps, whether it is for directories only); None for no rule.

    ``*`` and ``?`` stop at a slash, ``**`` does not; a slash at the front or inside ties the rule to its folder.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[keeps:].removeprefix("\\") if line[keeps:][:2] in ("\\#", "\\!") else line[keeps:]
    directories = line.endswith("/")
    body = line.rstrip("/")
    tied = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    out, at = [], 0
    for m in re.finditer(r"(?:^|(?<=/))\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.", body):
        out.append(re.escape(body[at : m.start()]))
        token = m[0]
        if token == "**/":
            out.append("(?:.*/)?")
        elif token == "/**":
            out.append("/.+")
        elif token[0] == "*":
            out.append("[^/]*")
        elif token == "?":
            out.append("[^/]")
        elif token[0] == "[":
            inner = token[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^/{inner[1:]}]" if inner[0] in "!^" else f"[{inner}]")
        else:
            out.append(re.escape(token[1]))
        at = m.end()
    out.append(re.escape(body[at:]))
    return ("" if tied else "(?:.*/)?") + "".join(out), keeps, directories


def ignore_rules(files: DataFrame) -> DataFrame:
    """``(base, k, pattern, keeps, directories)``: rules of all ignore files of ``files(path, text)`` with their folder (empty at the root) and order."""

    def listed(path: str, text: str | None) -> Iterator[tuple]:
        return ((path.rpartition("/")[0], k, *rule) for k, line in enumerate(text.splitlines() if isinstance(text, str) else ()) if (rule := ignore_pattern(line)))

    return by_file(files.where(F.col("path").rlike(r"(^|/)\.gitignore$")), ["path", "text"], listed, _RULES)


def version_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``(path)`` of the files that the ignore rules leave out.

    A folder or file is out if the last rule that matches it, in the deepest folder first, is not one that
    keeps; what lies in a folder that is out cannot be kept. Each folder is decided once: paths are joined to
    the rules of the folders above them by equality, and only the folders that are out meet the files again.
    """
    whole = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(whole)), lambda n: F.struct(F.array_join(F.slice(whole, F.lit(1), n), "/").alias("at"), (n < F.size(whole)).alias("directory")))
    paths = files.select("path").distinct()
    places = paths.select(F.explode(up).alias("u")).select("u.*").distinct()
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    met = places.select("at", "directory", F.explode(above).alias("base")).join(rules, "base")
    below = F.expr("CASE WHEN base = '' THEN at ELSE substring(at, length(base) + 2) END")
    # Only rules whose expression matches count; the expression differs from row to row, so it is a column.
    hit = met.withColumn("_below", below).where(F.expr("_below RLIKE concat('^(?:', pattern, ')$')") & (F.col("directory") | ~F.col("directories")))
    order = F.struct(F.length("base").alias("depth"), "k")
    out = hit.groupBy("at", "directory").agg(F.max_by("keeps", order).alias("keeps")).where("NOT keeps").select("at")
    return paths.select("path", F.explode(F.transform(up, lambda u: u["at"])).alias("at")).join(out, "at", "left_semi").select("path").distinct()


def _git(root: str, *words: str) -> str | None:
    """Output of a git command, None if it fails or there is no git."""
    try:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=60, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def since_merge_base(spark: SparkSession, root: str, branches: tuple[str, ...] = ("origin/HEAD", "origin/main", "HEAD~1")) -> DataFrame | None:
    """``(path)`` of the files changed since HEAD left the first of ``branches`` that it has a base with.

    A driver step, whose result is for ``changed_or_all``: None without git, base or change, so all files are scanned.
    """
    base = next((b for x in branches if (b := _git(root, "merge-base", "HEAD", x))), None)
    listed = _git(root, "diff", "--relative", "--name-status", f"{base}...HEAD") if base else None
    return changed_paths(spark.createDataFrame([(x,) for x in listed.splitlines()], "value string")) if listed else None

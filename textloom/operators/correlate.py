"""Correlation of rows within a file: containment, context, resources, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import number_literal


def _within(m: DataFrame, g: DataFrame) -> tuple[DataFrame, Column]:
    """``g`` renamed, and the condition that a row of ``m`` lies inside one of its rows: an equi-join on the path with a residual range."""
    g = g.select(F.col("path").alias("g_path"), F.struct(F.col("s_line").alias("l"), F.col("s_col").alias("c")).alias("g_start"), F.struct(F.col("e_line").alias("l"), F.col("e_col").alias("c")).alias("g_end"))
    start, end = F.struct(m["s_line"].alias("l"), m["s_col"].alias("c")), F.struct(m["e_line"].alias("l"), m["e_col"].alias("c"))
    return g, (m["path"] == g["g_path"]) & (start >= g["g_start"]) & (end <= g["g_end"])


def outside(matches: DataFrame, guards: DataFrame) -> DataFrame:
    """Matches that lie in no guard region of their file, ends included."""
    g, inside = _within(matches, guards)
    return matches.join(g, inside, "left_anti")


def inside(matches: DataFrame, regions: DataFrame) -> DataFrame:
    """Matches that lie in a region of their file."""
    g, within = _within(matches, regions)
    return matches.join(g, within, "left_semi")


def in_context(matches: DataFrame, regions: DataFrame, kinds: list[str], cold: list[str] | None = None, header: str | None = None) -> DataFrame:
    """Matches inside a block of one of ``kinds`` (whose header has a pattern), but not inside a ``cold`` block; each place once."""
    hot = regions.where(F.col("kind").isin(kinds))
    found = inside(matches, hot.where(F.col("header").rlike(header)) if header else hot)
    if cold:
        found = outside(found, regions.where(F.col("kind").isin(cold)))
    return found.dropDuplicates(["rule_id", "path", "s_line", "code"])


def guard_regions(guards: DataFrame) -> DataFrame:
    """What each guard protects, from ``guards(path, form, cond_*, body_*, whole_*)``: a membership test or a ternary all of it, a conjunction its condition only, any other guard its body."""
    form = F.col("form")
    pick = lambda k: F.when(form.isin("membership", "ternary"), F.col(f"whole_{k}")).when(form == "and", F.col(f"cond_{k}")).otherwise(F.col(f"body_{k}")).alias(k)
    return guards.select("path", *[pick(k) for k in ("s_line", "s_col", "e_line", "e_col")])


def without_partner(acquired: DataFrame, released: DataFrame) -> DataFrame:
    """``acquired(path, name, off, ...)`` without a later row of ``released(path, name, off)`` for the same name in the file.

    Only the last release of a name matters, so each acquisition meets one row at most.
    """
    last = released.groupBy(F.col("path").alias("r_path"), F.col("name").alias("r_name")).agg(F.max("off").alias("r_off"))
    return acquired.join(last, (F.col("path") == F.col("r_path")) & (F.col("name") == F.col("r_name")) & (F.col("r_off") > F.col("off")), "left_anti")


def latest_open(events: DataFrame) -> DataFrame:
    """Acquisitions that stay open when each release ends the latest open one of its name.

    ``events`` has (path, name, off, opens boolean). As in matching brackets, an acquisition stays open if no
    later point of its name's running balance falls below the balance in front of it.
    """
    by = Window.partitionBy("path", "name").orderBy("off")
    steps = F.when(F.col("opens"), 1).otherwise(-1)
    # A release without an open acquisition does nothing: the balance is taken from its lowest point so far.
    raw = events.withColumn("_sum", F.sum(steps).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    low = raw.withColumn("_low", F.least(F.min("_sum").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    level = low.withColumn("_level", F.col("_sum") - F.col("_low"))
    later = level.withColumn("_least", F.min("_level").over(by.rowsBetween(1, Window.unboundedFollowing)))
    return later.where("opens AND (_least IS NULL OR _least >= _level)").select("path", "name", "off")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, latest: bool = True) -> DataFrame:
    """``left`` with the value of the nearest row of ``right`` not after it (not before it unless ``latest``) and equal keys.

    One shuffle of both sides and a running last value; no pairs are formed.
    """
    both = left.select(*[F.col(c) for c in left.columns], F.lit(True).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.select(*[F.col(k) for k in keys], F.col(at), F.lit(False).alias("_left"), F.col(value).alias("_value"))
    order = (F.col(at).asc(), F.col("_left").asc()) if latest else (F.col(at).desc(), F.col("_left").asc())
    seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other, allowMissingColumns=True).withColumn(value, F.last("_value", ignorenulls=True).over(seen))
    return joined.where("_left").drop("_left", "_value")


def dependency_gaps(hooks: DataFrame) -> DataFrame:
    """Missing and unused dependencies of ``hooks(path, line_no, used, local, declared)``, arrays of names."""
    used = F.array_except("used", "local")
    return hooks.select("path", "line_no", F.array_sort(F.array_except(used, "declared")).alias("missing"), F.array_sort(F.array_except("declared", used)).alias("unused"))


def risky_divisions(matches: DataFrame, capture: str = "R", safe_names: tuple[str, ...] = ("100", "1000", "Math.PI", "math.pi", "PI", "EPSILON", "Number.EPSILON")) -> DataFrame:
    """Divisions whose captured denominator may be zero: no literal other than 0, no safe constant, no fallback to one, no lower bound."""
    text = F.trim(F.regexp_replace(F.col("captures")[capture]["text"], r"^\(+|\)+$", ""))
    value = number_literal(text)
    fallback = F.regexp_extract(text, r"(?:\|\||\?\?|\bor\b)\s*([0-9][\w.]*)\s*$", 1)
    bounded = text.rlike(r"^(Math\.max|max)\s*\(\s*[1-9]") | text.rlike(r"[,(]\s*[1-9][0-9.]*\s*\)?\s*$") & text.rlike(r"^(Math\.max|max)\b")
    safe = F.coalesce(value != 0, F.lit(False)) | text.isin(*safe_names) | F.coalesce(number_literal(fallback) != 0, F.lit(False)) | bounded
    return matches.where(~safe)


def with_permalinks(rows: DataFrame, blob: str | None, files: DataFrame | None = None) -> DataFrame:
    """``rows`` with url, a link to path and line below ``blob``; null without one, or where the file is unknown."""
    if not blob:
        return rows.withColumn("url", F.lit(None).cast("string"))
    url = F.concat(F.lit(blob.rstrip("/") + "/"), F.col("path"), F.lit("#L"), F.col("line_no").cast("string"))
    if files is None:
        return rows.withColumn("url", url)
    known = files.select(F.col("path").alias("_known")).distinct()
    return rows.join(known, F.col("path") == F.col("_known"), "left").withColumn("url", F.when(F.col("_known").isNotNull(), url)).drop("_known")

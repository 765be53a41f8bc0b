"""From occurrences to counts, findings, summaries and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import count_or_zero
from ..plans.catalogue import Rule, rules_frame

RANKS = {"critical": 0, "warning": 1, "info": 2, "good": 3}
#: Names that other tools give severities; fixed values.
_NAMES = {"error": "critical", "err": "critical", "fatal": "critical", "high": "critical", "serious": "critical", "critical": "critical", "warning": "warning", "warn": "warning", "medium": "warning", "info": "info", "note": "info", "hint": "info", "low": "info", "good": "good"}


def rank(severity: Column) -> Column:
    """0 for the worst severity; unknown ones come last."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), severity), F.lit(9))


def normal_severity(name: Column) -> Column:
    """Severity of any tool's name for it; unknown names are info."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), F.lower(F.trim(name))), F.lit("info"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "critical", "error").when(severity == "warning", "warning").otherwise("note")


def tier(n: Column, tiers: Column) -> Column:
    """Severity of a count by an array of (min_n, severity) in order; good if it exceeds none."""
    passed = F.filter(tiers, lambda t: n > t["min_n"])
    return F.coalesce(F.try_element_at(passed, F.lit(1))["severity"], F.lit("good"))


def counts(occurrences: DataFrame) -> DataFrame:
    """``(lang, category, rule_id, n)`` of what is not suppressed."""
    rows = occurrences.where("NOT suppressed") if "suppressed" in occurrences.columns else occurrences
    n = F.sum("n") if "n" in occurrences.columns else F.count(F.lit(1))
    return rows.groupBy("lang", "category", "rule_id").agg(n.alias("n"))


def grouped_counts(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts added up over ``groups(rule_id, group_id)``: several patterns of one rule."""
    return counted.join(F.broadcast(groups), "rule_id").groupBy("lang", "group_id").agg(F.sum("n").alias("n"))


def samples(occurrences: DataFrame, k: int = 3) -> DataFrame:
    """``(rule_id, samples)``: the first ``k`` occurrences by path and line of each rule.

    Each task keeps its own first ``k`` before anything is shuffled, so a frequent rule does not gather in one place.
    """
    rows = occurrences.where("NOT suppressed") if "suppressed" in occurrences.columns else occurrences
    order = Window.partitionBy("rule_id").orderBy("path", "line_no", "code")
    # Spark pushes the limit of a row number below the shuffle (WindowGroupLimit).
    first = rows.select("rule_id", "path", "line_no", "code").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    listed = F.array_sort(F.collect_list(F.struct("k", F.col("path").alias("file"), F.col("line_no").alias("line"), "code")))
    return first.groupBy("rule_id").agg(listed.alias("s")).select("rule_id", F.transform("s", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["code"].alias("code"))).alias("samples"))


def findings(spark: SparkSession, counted: DataFrame, rules: list[Rule], sampled: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """A row for each rule of ``rules``, with its count, severity and samples; rules without a hit are good.

    When not ``strict``, warnings of the asynchronous checks count as information.
    """
    catalogue = rules_frame(spark, rules)
    out = catalogue.join(counted.select("rule_id", "n"), "rule_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    severity = tier(n, F.col("tiers"))
    if not strict:
        severity = F.when((severity == "warning") & F.col("rule_id").contains("async"), "info").otherwise(severity)
    out = out.select("lang", "category", "rule_id", severity.alias("severity"), n.alias("n"), "title", F.col("remediation").alias("description"))
    if sampled is None:
        return out.withColumn("samples", F.expr("CAST(array() AS array<struct<file:string,line:int,code:string>>)"))
    return out.join(sampled, "rule_id", "left").withColumn("samples", F.coalesce("samples", F.expr("CAST(array() AS array<struct<file:string,line:int,code:string>>)"))).select("lang", "category", "rule_id", "severity", "n", "title", "description", "samples")


def _of(severity: str) -> Column:
    return F.sum(F.when(F.col("severity") == severity, F.col("n")).otherwise(0)).cast("long").alias(severity)


def summary(found: DataFrame, files: DataFrame) -> DataFrame:
    """``(lang, files, critical, warning, info)`` of each language that has files."""
    per = found.groupBy("lang").agg(_of("critical"), _of("warning"), _of("info"))
    n = files.groupBy("lang").agg(F.count_distinct("path").alias("files"))
    return n.join(per, "lang", "left").select("lang", "files", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in ("critical", "warning", "info")])


def totals(summaries: DataFrame) -> DataFrame:
    """One row of the four measures over all languages; what is no number counts as 0."""
    return summaries.agg(*[F.coalesce(F.sum(count_or_zero(F.col(m).cast("string"))), F.lit(0)).cast("long").alias(m) for m in ("files", "critical", "warning", "info")])


def subtotals(found: DataFrame) -> DataFrame:
    """Counts by language and severity with the language's subtotal and the grand total (nulls), as a rollup gives."""
    return found.where("severity <> 'good'").rollup("lang", "severity").agg(F.sum("n").cast("long").alias("n"))


def by_category(found: DataFrame) -> DataFrame:
    """``(lang, category, n)``."""
    return found.where("severity <> 'good'").groupBy("lang", "category").agg(F.sum("n").cast("long").alias("n"))


def matrix(found: DataFrame, categories: DataFrame) -> DataFrame:
    """Total and severities of each of ``categories(lang, category)``, zero where nothing was found."""
    wide = found.groupBy("lang", "category").pivot("severity", ["critical", "warning", "info"]).agg(F.sum("n").cast("long"))
    out = categories.join(wide, ["lang", "category"], "left").fillna(0, ["critical", "warning", "info"])
    return out.withColumn("total", F.col("critical") + F.col("warning") + F.col("info"))


def histogram(occurrences: DataFrame) -> DataFrame:
    """``(rule_id, n)`` of all occurrences."""
    return occurrences.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def worst_first(found: DataFrame) -> DataFrame:
    """Findings by severity, then larger counts, then rule."""
    return found.orderBy(rank(F.col("severity")), F.desc("n"), "rule_id")


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings as severe as ``severity`` or worse."""
    return found.where(rank(F.col("severity")) <= RANKS[severity])


def merged(reports: list[DataFrame]) -> DataFrame:
    """Findings of several scanners one below the other; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def merged_metrics(metrics: DataFrame) -> DataFrame:
    """``(lang, payload)``: the maps of each language put together by seq; of a key's values the last wins."""
    last = metrics.select("lang", "seq", F.explode("payload").alias("key", "value")).groupBy("lang", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("payload"))


def difference(current: DataFrame, baseline: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``current`` against ``baseline``: both values of each measure and their difference; what is missing on a side is 0."""
    side = lambda df, old: df.select(*keys, F.lit(old).alias("_old"), *[count_or_zero(F.col(m).cast("string")).alias(m) for m in measures])
    both = side(current, False).unionByName(side(baseline, True))
    pick = lambda m, old: F.coalesce(F.sum(F.when(F.col("_old") == old, F.col(m))), F.lit(0)).cast("long")
    return both.groupBy(*keys).agg(*[x for m in measures for x in (pick(m, False).alias(m), pick(m, True).alias(f"{m}_baseline"), (pick(m, False) - pick(m, True)).alias(f"{m}_delta"))])


def exit_code(critical: int, warning: int, files: int, strict: bool, allow_empty: bool = False, max_critical: int = 0, max_warning: int | None = None) -> int:
    """0 if clean, 1 if findings fail the run, 3 if nothing was scanned."""
    if not files:
        return 0 if allow_empty else 3
    if critical > max_critical or strict and critical + warning > 0 or max_warning is not None and warning > max_warning:
        return 1
    return 0

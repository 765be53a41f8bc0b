"""Rules over lines: one pass of the corpus for all rules of a kind."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SUPPRESSION_MARKERS
from ..functions.text import java_regex, literal_of, texts_of
from ..plans.catalogue import Rule


def hit(rule: Rule, line: Column, low: Column | None = None) -> Column:
    """Whether a rule's pattern is found and its veto is not. A text that every match holds is looked for first; without one, in ``low`` (the line in lower case) texts of which a match holds one."""
    flag = "(?i)" if rule.ignore_case else ""
    found = line.rlike(flag + java_regex(rule.pattern))
    if not flag and (text := literal_of(rule.pattern)):
        found = line.contains(text) & found
    elif low is not None and (texts := texts_of(flag + rule.pattern)):
        found = _one_of(texts, low) & found
    return found & ~line.rlike(java_regex(rule.exclude)) if rule.exclude else found


def _one_of(texts: Iterable[str], line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(t) for t in sorted(texts)])


def _any_hit(rules: list[Rule], line: Column, low: Column) -> Column:
    """Whether a line may satisfy one of the rules: plain searches where patterns hold a text or one of several, one alternation for the others."""
    texts = {"" if r.ignore_case else literal_of(r.pattern) for r in rules}
    tests = [line.contains(t) for t in sorted(texts - {""})]
    loose = [r for r in rules if r.ignore_case or not literal_of(r.pattern)]
    some = {r.rule_id: texts_of(r.pattern) for r in loose}
    if any(some.values()):
        tests.append(_one_of(frozenset().union(*some.values()), low))
    loose = [r for r in loose if not some[r.rule_id]]
    if loose:
        tests.append(line.rlike("|".join(f"(?:{'(?i)' if r.ignore_case else ''}{java_regex(r.pattern)})" for r in loose)))
    return reduce(lambda a, b: a | b, tests)


def _satisfied(rules: list[Rule], line: Column, low: Column, of: Callable[[Rule], Column]) -> Column | None:
    """For each line the array of what ``of`` gives for the rules of its language that it satisfies; null if none can be."""
    cases = None
    for lang in dict.fromkeys(r.lang for r in rules):
        mine = [r for r in rules if r.lang == lang]
        test = (F.col("lang") == lang) & _any_hit(mine, line, low)
        hits = F.array_compact(F.array(*[F.when(hit(r, line, low), of(r)) for r in mine]))
        cases = F.when(test, hits) if cases is None else cases.when(test, hits)
    return cases


def occurrences(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(lang, category, rule_id, path, line_no, code)`` and ``lines``' suppressed column: a row per rule and line.

    All rules of a language are tried in one pass: a line that holds no text and no pattern of any is let go
    at once; the others get the array of the rules they satisfy, which is exploded. Nothing is joined or
    shuffled.
    """
    cases = _satisfied(rules, F.col("line"), F.col("_low"), lambda r: F.struct(F.lit(r.category).alias("category"), F.lit(r.rule_id).alias("rule_id")))
    more = [c for c in ("suppressed",) if c in lines.columns]
    if cases is None:
        return lines.where("false").select("lang", F.lit(0).alias("category"), F.lit("").alias("rule_id"), "path", "line_no", F.col("line").alias("code"), *more)
    return lines.withColumn("_low", F.lower("line")).select("lang", F.explode(cases).alias("r"), "path", "line_no", F.col("line").alias("code"), *more).select("lang", "r.category", "r.rule_id", "path", "line_no", "code", *more)


def has_marker(name: str, markers: tuple[str, ...] = SUPPRESSION_MARKERS, ignore_case: bool = True) -> Column:
    """Whether a column, a line or a whole text, holds a marker."""
    text = F.lower(name) if ignore_case else F.col(name)
    return reduce(lambda a, b: a | b, (text.contains(m.lower() if ignore_case else m) for m in markers), F.lit(False))


def mark_suppressed(lines: DataFrame, markers: tuple[str, ...] = SUPPRESSION_MARKERS, previous_line: bool = True, ignore_case: bool = True) -> DataFrame:
    """``lines`` with suppressed: a marker stands on the line, or on the one before it in the file.

    Lines that come with the one before them (``previous``) are marked where they are; others are shuffled by file.
    """

    here = has_marker("line", markers, ignore_case)
    if not previous_line:
        return lines.withColumn("suppressed", here)
    if "previous" in lines.columns:
        return lines.withColumn("suppressed", here | F.coalesce(has_marker("previous", markers, ignore_case), F.lit(False))).drop("previous")
    before = F.lag(here, 1, False).over(Window.partitionBy("path").orderBy("line_no"))
    return lines.withColumn("suppressed", here | before)


def suppressed_statements(occurrences: DataFrame, regions: DataFrame, lines: DataFrame, markers: tuple[str, ...] = SUPPRESSION_MARKERS) -> DataFrame:
    """``occurrences`` that no marker covers when a marker anywhere in a statement, or on the line above it, holds for all of it."""
    marked = lines.where(reduce(lambda a, b: a | b, (F.lower("line").contains(m) for m in markers))).select(F.col("path").alias("m_path"), F.col("line_no").alias("m_line"))
    covered = regions.join(marked, (F.col("path") == F.col("m_path")) & F.col("m_line").between(F.col("s_line") - 1, F.col("e_line"))).select(F.col("path").alias("c_path"), "s_line", "e_line").distinct()
    inside = (F.col("path") == F.col("c_path")) & F.col("line_no").between(F.col("s_line"), F.col("e_line"))
    return occurrences.join(covered, inside, "left_anti")


def one_pass_counts(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(lang, rule_id, n)`` of all rules in one pass: only the rules' numbers are exploded, and the sums are partial; rules without a hit have 0."""
    spark = lines.sparkSession
    table = spark.createDataFrame([(k, r.lang, r.rule_id) for k, r in enumerate(rules)], "k int, lang string, rule_id string")
    numbers = {r.rule_id: k for k, r in enumerate(rules)}
    cases = _satisfied(rules, F.col("line"), F.col("_low"), lambda r: F.lit(numbers[r.rule_id]))
    if cases is None:
        return table.select("lang", "rule_id", F.lit(0).cast("long").alias("n"))
    counted = lines.withColumn("_low", F.lower("line")).select(F.explode(cases).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    return table.join(counted, F.col("k") == F.col("_k"), "left").select("lang", "rule_id", F.coalesce("n", F.lit(0)).alias("n"))


def balances(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(lang, category, rule_id, path, acquired, released, n)``: files that acquire more than they release."""
    mine = [r for r in rules if r.kind == "balance"]
    if not mine:
        return lines.where("false").select("lang", F.lit(0).alias("category"), F.lit("").alias("rule_id"), "path", F.lit(0).cast("long").alias("acquired"), F.lit(0).cast("long").alias("released"), F.lit(0).cast("long").alias("n"))
    sums = []
    for k, r in enumerate(mine):
        own = F.col("lang") == r.lang
        sums += [F.count(F.when(own & F.col("line").rlike(java_regex(r.pattern)), 1)).alias(f"a{k}"), F.count(F.when(own & F.col("line").rlike(java_regex(r.exclude)), 1)).alias(f"r{k}")]
    rows = F.array(*[F.when(F.col(f"a{k}") > F.col(f"r{k}"), F.struct(F.lit(r.category).alias("category"), F.lit(r.rule_id).alias("rule_id"), F.col(f"a{k}").alias("acquired"), F.col(f"r{k}").alias("released"))) for k, r in enumerate(mine)])
    return lines.groupBy("lang", "path").agg(*sums).select("lang", "path", F.explode(F.array_compact(rows)).alias("x")).select("lang", "x.category", "x.rule_id", "path", "x.acquired", "x.released", (F.col("x.acquired") - F.col("x.released")).alias("n"))


def files_with(lines: DataFrame, pattern: str) -> DataFrame:
    """Paths of the files that have the pattern on a line."""
    return lines.where(F.col("line").rlike(java_regex(pattern))).select("path").distinct()


def lacking(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(lang, category, rule_id, path)``: files that have a rule's first pattern and nowhere its second.

    A conditional aggregation per file decides all rules at once, in place of an anti join for each.
    """
    mine = [r for r in rules if r.kind == "file_without"]
    if not mine:
        return lines.where("false").select("lang", F.lit(0).alias("category"), F.lit("").alias("rule_id"), "path")
    sums = []
    for k, r in enumerate(mine):
        own = F.col("lang") == r.lang
        sums += [F.max(own & F.col("line").rlike(java_regex(r.pattern))).alias(f"a{k}"), F.max(own & F.col("line").rlike(java_regex(r.exclude))).alias(f"b{k}")]
    rows = F.array(*[F.when(F.col(f"a{k}") & ~F.col(f"b{k}"), F.struct(F.lit(r.category).alias("category"), F.lit(r.rule_id).alias("rule_id"))) for k, r in enumerate(mine)])
    return lines.groupBy("lang", "path").agg(*sums).select("lang", "path", F.explode(F.array_compact(rows)).alias("x")).select("lang", "x.category", "x.rule_id", "path")


def ratios(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(lang, category, rule_id, first, second, n)``: rules whose first pattern is on more lines of the corpus than the second."""
    mine = [r for r in rules if r.kind == "ratio"]
    sums = []
    for k, r in enumerate(mine):
        own = F.col("lang") == r.lang
        sums += [F.count(F.when(own & F.col("line").rlike(java_regex(r.pattern)), 1)).alias(f"a{k}"), F.count(F.when(own & F.col("line").rlike(java_regex(r.exclude)), 1)).alias(f"b{k}")]
    rows = F.array(*[F.when(F.col(f"a{k}") > F.col(f"b{k}"), F.struct(F.lit(r.lang).alias("lang"), F.lit(r.category).alias("category"), F.lit(r.rule_id).alias("rule_id"), F.col(f"a{k}").alias("first"), F.col(f"b{k}").alias("second"))) for k, r in enumerate(mine)])
    return lines.agg(*sums).select(F.explode(F.array_compact(rows)).alias("x")).select("x.*", (F.col("x.first") - F.col("x.second")).alias("n"))


def unreachable(lines: DataFrame, jump: str = r"^(\s*)(return|raise|throw|break|continue)\b") -> DataFrame:
    """Lines at the same indent right behind a jump: code that is never reached."""
    after = Window.partitionBy("path").orderBy("line_no")
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    dead = F.lag(F.col("line").rlike(jump) & ~F.col("line").rlike(r"[,(\[{\\]\s*$"), 1, False).over(after) & (indent == F.lag(indent).over(after)) & ~F.col("line").rlike(r"^\s*($|[)\]}#/*]|else|elif|except|finally|catch|case|default|end\b|when\b|rescue\b|ensure\b)")
    return lines.withColumn("_dead", dead).where("_dead").drop("_dead")


def context_has(lines: DataFrame, pattern: str, back: int, ahead: int = 0) -> Column:
    """Whether the pattern is on one of the ``back`` lines before a line, on it or on the ``ahead`` lines behind it."""
    return F.max(F.col("line").rlike(java_regex(pattern))).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(-back, ahead))


def debt_markers(lines: DataFrame) -> DataFrame:
    """Per language the lines with each debt marker, and their total; notes are counted but no debt."""
    counts = [F.count(F.when(F.col("line").rlike(f"(?i){w}"), 1)).alias(w.lower()) for w in ("TODO", "FIXME", "HACK", "XXX", "NOTE")]
    return lines.groupBy("lang").agg(*counts).withColumn("total", F.col("todo") + F.col("fixme") + F.col("hack") + F.col("xxx"))

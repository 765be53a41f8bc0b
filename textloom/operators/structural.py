"""Joins along the axes of syntax trees, for all rules at once and without pairs.

Nodes are numbered as they are entered and left. Marked nodes become events at their two numbers, questions events at theirs, and one
running sum over a file's events of a label says how many marks are open where a question stands (what is around it) and how
many begin while it lasts (what is in it). The work is one sort of the marks and questions, whatever the number of
rules and however deep the trees; a file's events are split by label and stream through the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AROUND, WITHIN = "around", "within"


def labelled(nodes: DataFrame, tests: dict[int, tuple[str, Column]], name: str) -> DataFrame:
    """A row of ``nodes`` for each of ``tests`` (a language and a condition) that it passes, with the test's number in column ``name``; a node is asked its language's tests only."""
    passed = None
    for lang in dict.fromkeys(of for of, _ in tests.values()):
        mine = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, (of, test) in tests.items() if of == lang]))
        passed = F.when(F.col("lang") == lang, mine) if passed is None else passed.when(F.col("lang") == lang, mine)
    return nodes.withColumn(name, F.explode(passed if passed is not None else F.array().cast("array<int>")))


def axis_counts(questions: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """``questions`` with n_around and n_within: the marks of its file and label around a question, and those in it.

    Both have path, label, pre and post, and questions are told apart by ``keys`` besides. A mark is neither around nor in a
    question of the same node. Repeated marks count each; marks of other files or labels do not. Nested or
    disjoint intervals are what trees have; others give no meaningful counts.
    """
    of = [F.col("path"), F.col("label")]
    blank = [F.lit(None).cast(questions.schema[k].dataType).alias(k) for k in keys]
    mark = lambda at, opens, begins: marks.select(*of, F.col(at).alias("at"), F.lit(opens).alias("opens"), F.lit(begins).alias("begins"), F.lit(None).cast("boolean").alias("ends"), *blank)
    ask = lambda at, ends: questions.select(*of, F.col(at).alias("at"), F.lit(0).alias("opens"), F.lit(0).alias("begins"), F.lit(ends).alias("ends"), *keys)
    events = mark("pre", 1, 1).unionByName(mark("post", -1, 0)).unionByName(ask("pre", False)).unionByName(ask("post", True))
    order = Window.partitionBy("path", "label").orderBy("at")
    before, up_to = order.rangeBetween(Window.unboundedPreceding, -1), order.rangeBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("opened", F.coalesce(F.sum("opens").over(before), F.lit(0))).withColumn("begun", F.sum("begins").over(up_to)).where("ends IS NOT NULL")
    begun = lambda ends: F.max(F.when(F.col("ends") == ends, F.col("begun")))
    return summed.groupBy("path", "label", *keys).agg(F.max(F.when(~F.col("ends"), F.col("opened"))).alias("n_around"), (begun(True) - begun(False)).alias("n_within"))


def structural_filter(hits: DataFrame, marks: DataFrame, wants: DataFrame) -> DataFrame:
    """``hits(path, rule, pre, post, ...)`` that fulfil all of their rule's ``wants(rule, label, axis, wanted)``.

    A want asks for a mark with ``label`` around or within the hit, or for none if not ``wanted``. ``wants`` is as large as
    the rules are, so it is broadcast; hits of rules without wants pass.
    """
    questions = hits.select("path", "rule", "pre", "post").join(F.broadcast(wants), "rule")
    counted = axis_counts(questions, marks, ["rule", "pre", "axis", "wanted"])
    there = F.when(F.col("axis") == AROUND, F.col("n_around")).otherwise(F.col("n_within")) > 0
    failed = counted.where(there != F.col("wanted")).select("path", "rule", "pre").distinct()
    return hits.join(failed, ["path", "rule", "pre"], "left_anti")


def parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the kind, name and code of the node that each lies in directly."""
    up = nodes.select(F.col("path").alias("_path"), F.col("pre").alias("_pre"), F.col("kind").alias("parent_kind"), F.col("name").alias("parent_name"), F.col("code").alias("parent_code"))
    return nodes.join(up, (F.col("path") == F.col("_path")) & (F.col("parent") == F.col("_pre")), "left").drop("_path", "_pre")

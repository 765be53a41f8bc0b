"""Exact deduplication with a split of heavy hitters.

Texts are equal when they are identical after deleting ASCII white space. Digests are found on the JVM and
written once; Misra-Gries summaries name the frequent digests; the verified winners of those are broadcast
(``counters`` rows at most) and answer their rows without a shuffle; the other digests go through an
ordinary aggregation and a join that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, materialise

#: Counters of a Misra-Gries summary, and the most digests that are broadcast.
COUNTERS = 256


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int = COUNTERS) -> dict:
    """Misra-Gries summary of the first column: each count is low by n / (counters + 1) at most."""
    held: dict = {}
    for batch in batches:
        counted = pa.table({"k": batch.column(0)}).group_by("k").aggregate([("k", "count")])
        for key, n in zip(counted.column("k").to_pylist(), counted.column("k_count").to_pylist(), strict=True):
            held[key] = held.get(key, 0) + n
        if len(held) > counters:
            # Merging summaries: take the next count off all, which leaves `counters` of them at most.
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_points, digest)``: code points of the original text and SHA-256 of the normalised one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.length(text).alias("n_points"), F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Return ``(id, digest, keep_id, group_size)`` for every row of ``docs``.

    keep_id is the row with the most code points in the original text, then the smallest id. Null text
    counts as empty, so null, empty and all-white texts are one group. Repeated ids are rows of their own
    (all count in group_size); a null id sorts after the others and is kept only if no other row ties. Other columns are not
    read, so clashing names do no harm. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark, 20_000)
    found = materialise(digests(docs, id_col, text_col))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries(batches, counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    summaries = found.select("digest").mapInArrow(summarise, "digest binary, n long")
    # The summed counts are at most the rows, so a digest with over 2 / (counters + 1) of all rows is among the first.
    frequent = summaries.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    best = F.max(F.struct("n_points", F.coalesce(-F.col("id"), F.lit(-(2**63))).alias("low"), "id"))

    def winners(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), "group_size")

    heavy = materialise(winners(found.join(F.broadcast(frequent), "digest", "left_semi")).where("group_size > 1"))
    # At most `counters` rows of 56 bytes, whatever the input.
    first = found.join(F.broadcast(heavy), "digest").select("id", "digest", "keep_id", "group_size")
    rest = found.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return first.union(rest.join(winners(rest), "digest").select("id", "digest", "keep_id", "group_size"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with the row of its group that stays."""
    from .common import table

    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Documents are dealt to blocks of about 3 MB. A block sends each distinct n-gram once, with its count, to the
shard that its hash belongs to; a shard adds up its part of the count table and answers each block in the
block's own order; the answers are joined to the block's n-grams and summed per document. A document is scored
against all others: its own counts are taken off. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_shuffles, materialise, raw
from .substring_dedup import _Hashes, _mixed

ALPHA, ORDER = 0.4, 2
#: Bytes of text in a block, and distinct n-grams of all blocks in a shard, on average.
BLOCK, SHARD = 3 << 20, 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for n = 1 to order the hash of the n-gram that ends at each word (0 where it would begin before the text)."""
    hashes = _Hashes()
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, grown = [], h
    for n in range(1, order + 1):
        if n > 1:
            grown = np.concatenate([grown[:0], np.zeros(min(1, len(h)), np.uint64), grown[:-1]]) * _BASE + h
        g = _mixed(grown + np.uint64(n)) | np.uint64(1)
        out.append(np.where(place >= n - 1, g, np.uint64(0)))
    return sizes, out


def _planes(x: np.ndarray) -> bytes:
    """Bytes of a uint64 array, all first bytes, then all second and so on: runs of zeros for Spark's codec."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _table(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a block in order, the position of each occurrence among them, and their counts."""
    return np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)


def _cuts(distinct: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shards that sorted n-grams belong to, shard 0 in any case, and where the part of each begins and ends.

    Shards are ranges of the hash: its product with their number, over 2^64. Only shards with n-grams are looked at.
    """
    low = np.uint64(32)
    n = np.uint64(shards)
    shard = ((distinct >> low) * n + (((distinct & np.uint64(0xFFFFFFFF)) * n) >> low)) >> low
    begin = np.flatnonzero(np.diff(shard, prepend=np.uint64(2**64 - 1)))
    to, end = shard[begin], np.append(begin[1:], len(distinct))
    if not len(to) or to[0]:
        to, begin, end = np.insert(to, 0, 0), np.insert(begin, 0, 0), np.insert(end[: len(to)], 0, 0)
    return to.astype(np.int64), begin, end


def score_block(sizes: np.ndarray, grams: list[np.ndarray], inverse: np.ndarray, counts: np.ndarray, total: int, alpha: float = ALPHA) -> np.ndarray:
    """Log score of each document of a block; ``counts`` are the corpus counts of its distinct n-grams."""
    n = int(sizes.sum())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    others = np.maximum(total - sizes, 1).astype(float)
    left = []
    for k in range(len(grams)):
        at = inverse[k * n : (k + 1) * n]
        _, pair, own = np.unique(doc * len(counts) + at, return_inverse=True, return_counts=True)
        left.append(counts[at].astype(np.int64) - own[pair])
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(left[0] > 0, np.log(left[0]), np.log(alpha)) - np.log(others)[doc] if n else np.zeros(0)
        for k in range(1, len(grams)):
            before = np.concatenate([[0], left[k - 1][:-1]]) if n else np.zeros(0)
            there = grams[k] != 0
            hit = there & (left[k] > 0)
            value = np.where(hit, np.log(np.where(hit, left[k], 1)) - np.log(np.where(hit, before, 1)), np.where(there, np.log(alpha) + value, value))
    return np.bincount(doc, value, len(sizes)) if n else np.zeros(len(sizes))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK, shard_size: int = SHARD) -> DataFrame:
    """Return ``(id, n_words, log_score)`` for every row of ``docs``.

    Words are runs without ASCII white space, unchanged. With c the counts over all other documents, a word
    scores c(gram) / c(gram without its last word) for the longest gram of ``order`` words or fewer that
    others have, times ``alpha`` for each word given up; a lone word c(word) / N, and a word that no other
    document has alpha / N, with N the words of the others, 1 at least. log_score adds the natural logarithms;
    it is 0 for null and empty texts. Every row is a document, so repeated rows count for each other. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw(text_col).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-size // block_bytes))
    shards = max(1, round(n_blocks * block_bytes / 8 / shard_size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)))

    def sent(key: tuple, part: pa.Table) -> pa.Table:
        sizes, grams = _grams(part["t"].to_pylist(), order)
        distinct, _, counts = _table(grams)
        # A shard that the block has nothing for gets no row, so there are never more rows than n-grams.
        to, begin, end = _cuts(distinct, shards)
        blobs = [_planes(np.concatenate([np.diff(distinct[a:b], prepend=np.uint64(0)), counts[a:b].astype(np.uint64)])) for a, b in zip(begin, end, strict=True)]
        words = [int(sizes.sum())] + [0] * (len(to) - 1)
        return pa.table({"block": pa.array([key[0].as_py()] * len(to), pa.int64()), "shard": pa.array(to, pa.int32()), "words": pa.array(words, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    tables = dealt.groupBy("block").applyInArrow(sent, "block long, shard int, words long, blob binary")

    def answered(part: pa.Table) -> pa.Table:
        distinct, counts, sizes = [], [], []
        for blob in part["blob"]:
            x = _from_planes(blob.as_py())
            half = len(x) // 2
            distinct.append(np.cumsum(x[:half], dtype=np.uint64))
            counts.append(x[half:])
            sizes.append(half)
        _, inverse = np.unique(np.concatenate(distinct), return_inverse=True)
        del distinct
        # Sums are exact in doubles up to 2^53.
        summed = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        ends = np.cumsum(sizes)
        blobs = [_planes(summed[inverse[e - s : e]].astype(np.uint64)) for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"block": part["block"], "shard": part["shard"], "words": part["words"], "blob": pa.array(blobs, pa.binary())})

    answers = materialise(tables.groupBy("shard").applyInArrow(answered, "block long, shard int, words long, blob binary"))
    free_shuffles(spark)
    total = answers.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]

    def scored(mine: pa.Table, replies: pa.Table) -> pa.Table:
        sizes, grams = _grams(mine["t"].to_pylist(), order)
        _, inverse, _ = _table(grams)
        parts = [_from_planes(b.as_py()) for b in replies.sort_by("shard")["blob"]]
        counts = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return pa.table({"id": mine["id"], "n_words": pa.array(sizes, pa.int64()), "log_score": pa.array(score_block(sizes, grams, inverse, counts, total, alpha), pa.float64())})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "id long, n_words long, log_score double")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Query: words, log score and mean log score of every document."""
    from .common import table

    found = score_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 3).alias("log_score"), F.round(F.col("log_score") / F.greatest(F.col("n_words"), F.lit(1)), 5).alias("mean_log_score"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), t AS (
  SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM d
), p AS (
  SELECT r, k, w, lag(w) OVER (PARTITION BY r ORDER BY k) AS v FROM t
), n AS (SELECT count(*) AS total FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
ud AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
b AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
bd AS (SELECT r, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
s AS (
  SELECT p.r, CASE
      WHEN b.c - bd.c > 0 THEN ln(b.c - bd.c) - ln(uv.c - udv.c)
      ELSE CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4) END
        + CASE WHEN uw.c - udw.c > 0 THEN ln(uw.c - udw.c) ELSE ln(0.4) END - ln(greatest(n.total - len(d.w), 1))
    END AS x
  FROM p JOIN d USING (r) CROSS JOIN n
  JOIN u uw ON uw.w = p.w JOIN ud udw ON udw.r = p.r AND udw.w = p.w
  LEFT JOIN u uv ON uv.w = p.v LEFT JOIN ud udv ON udv.r = p.r AND udv.w = p.v
  LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.r = p.r AND bd.v = p.v AND bd.w = p.w
)
SELECT d.doc_id, len(d.w) AS n_words, round(coalesce(sum(s.x), 0.0), 3) AS log_score,
       round(coalesce(sum(s.x), 0.0) / greatest(len(d.w), 1), 5) AS mean_log_score
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id, len(d.w)
"""

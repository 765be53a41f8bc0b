"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Each view has a logistic regression, fitted first on labelled documents. In each round every other document of
the corpus is looked at: where one view is confident, its label is a lesson for the other view. A lesson is a
gradient and a Hessian, so tasks add lessons up and the driver sees sums of a fixed size; a round ends with
one Newton step over labelled and pseudo-labelled documents. Both views are then calibrated on labelled rows
that took no part in training, and the calibrated views are combined to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, fresh, materialise

#: Labelled rows that the models are fitted on, at most; the pool of co-training is every other row, and all rows are scored.
LABELLED = 10_000
ROUNDS, CONFIDENT = 5, 0.95
#: Documents with a lower score are rejected.
KEEP = 0.5
#: Buckets that words and pairs of words are hashed to.
BUCKETS = 64
#: Lessons that one task or the driver adds up.
_FAN_IN = 64
_MEMO = 400_000

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SETS = (_UPPER, _LOWER, _DIGIT, b"!?", b"|", b"%&*#$@~^", b".,;:", b"<>{}[]()/\\=_+", b"\"'`", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256)))
_SHARES, _LANGS, _SOURCES = len(_SETS) + 7, 16, 32
N_TEXT = _SHARES + BUCKETS
N_META = _LANGS + _SOURCES + 5


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word)
        return value


def text_view(text: bytes, hashes: _WordHashes) -> np.ndarray:
    """Features of the whole text: shares of character classes, words and lines, and the roots of the shares of hashed words and pairs of words."""
    n = len(text) or 1
    shares = [(len(text) - len(text.translate(None, s))) / n for s in _SETS]
    words, lines = text.split(), text.split(b"\n")
    w, m = len(words) or 1, len(lines)
    letters = shares[0] + shares[1] + shares[11]
    out = np.zeros(N_TEXT, np.float32)
    out[:_SHARES] = [*shares, len(set(words)) / w, len(set(lines)) / m, sum(map(len, words)) / w / 10, shares[0] / (letters or 1), shares[5] * n / w, shares[3] * n / w, shares[4] * n / w]
    if words:
        h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
        pairs = h[:-1] * 31 + h[1:] * 17
        out[_SHARES:] = np.sqrt(np.bincount(np.concatenate([h, pairs]) % BUCKETS, minlength=BUCKETS) / (2 * w))
    if len(hashes) > _MEMO:
        hashes.clear()
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Features of the row beside its text; language and source are hashed."""
    out = np.zeros(N_META, np.float32)
    out[zlib.crc32((lang or "").encode()) % _LANGS] = 1.0
    out[_LANGS + zlib.crc32((source or "").encode()) % _SOURCES] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    out[-5:] = [size / 10, (size / 10) ** 2, float(n_chars is None), float((n_chars or 0) < 200), float((n_chars or 0) > 20_000)]
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[1:] + self.weights[0], -30, 30)


RIDGE = 1.0


def lesson(view: Logistic, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What rows teach a view at its present weights, as one vector: their number, the gradient and the Hessian."""
    z = np.column_stack([np.ones(len(x)), (x - view.mean) / view.scale])
    p = _sigmoid(z @ view.weights)
    return np.concatenate([[len(x)], z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def stepped(view: Logistic, taught: np.ndarray) -> Logistic:
    """The view after one Newton step on summed lessons."""
    d = len(view.weights)
    penalty = np.r_[1e-6, np.full(d - 1, RIDGE)]
    step = np.linalg.solve(taught[1 + d :].reshape(d, d) + np.diag(penalty), taught[1 : 1 + d] - penalty * view.weights)
    return replace(view, weights=view.weights + step / max(1.0, np.abs(step).max() / 5))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> Logistic:
    """Fit by Newton's method."""
    mean, scale = x.mean(0), x.std(0)
    view = Logistic(np.zeros(x.shape[1] + 1), mean, np.where(scale > 1e-9, scale, 1.0))
    for _ in range(steps):
        before, view = view, stepped(view, lesson(view, x, y))
        if np.abs(view.weights - before.weights).max() < 1e-6:
            break
    return view


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Two views, their calibrations and the weights that combine them; or the constant score of a degenerate fit."""

    views: list[Logistic]
    calibrations: list[Logistic]
    both: Logistic | None
    constant: float = 1.0

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability of quality by text, by metadata and by both; shape (n, 3)."""
        if self.both is None:
            return np.full((len(text), 3), self.constant)
        calibrated = np.column_stack([c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, meta), strict=True)])
        return _sigmoid(np.column_stack([calibrated, self.both.logit(calibrated)]))


def pool_lessons(views: list[Logistic], prior: float, text: np.ndarray, meta: np.ndarray, confident: float = CONFIDENT) -> list[np.ndarray]:
    """For each view what the rows teach it that the other view is confident of: the lesson of the low ones, then that of the good ones.

    A view is confident of a row if what it sees would be enough without the classes' frequencies, whose logit
    is ``prior``: a view that sees nothing and only repeats that most rows are good is never confident.
    """
    sides, enough = (text, meta), np.log(confident / (1 - confident))
    seen = [v.logit(x) - prior for v, x in zip(views, sides, strict=True)]
    return [np.concatenate([lesson(views[k], sides[k][m], np.full(int(m.sum()), y)) for y, m in ((0.0, seen[1 - k] <= -enough), (1.0, seen[1 - k] >= enough))]) for k in (0, 1)]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held_out: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """Co-training with a pool that is at hand; see ``co_train_with``."""
    return co_train_with(text, meta, y, held_out, lambda views, prior: pool_lessons(views, prior, pool_text, pool_meta, confident), rounds)


def co_train_with(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held_out: np.ndarray, pool: Callable[[list[Logistic], float], list[np.ndarray]], rounds: int = ROUNDS) -> CoTrained:
    """Co-training on labelled rows (``held_out`` of them for calibration) and the lessons that ``pool`` has for two views.

    Pseudo-labelled rows of a class weigh as much as its labelled ones all together, and never more than one of
    these each, so lessons do not shift the classes' frequencies; a view that is confident of one class only
    teaches nothing. Without both classes on either side of the split the score is the same for all rows: the
    share of positive labels, or 1 without labels.
    """
    fit_, cal = ~held_out, held_out
    if len(y) == 0 or len(set(y[fit_])) < 2 or len(set(y[cal])) < 2:
        return CoTrained([], [], None, float(y.mean()) if len(y) else 1.0)
    sides, good = (text, meta), y[fit_].sum()
    own_n = (fit_.sum() - good, good)
    prior = float(np.log(good / own_n[0]))
    views = [logistic(x[fit_], y[fit_]) for x in sides]
    for _ in range(rounds):
        before, views = views, [_taught(v, lesson(v, x[fit_], y[fit_]), np.split(t, 2), own_n) for v, x, t in zip(views, sides, pool(views, prior), strict=True)]
        if max(np.abs(v.weights - b.weights).max() for v, b in zip(views, before, strict=True)) < 1e-4:
            break
    raw = [v.logit(x[cal])[:, None] for v, x in zip(views, sides, strict=True)]
    calibrations = [logistic(r, y[cal]) for r in raw]
    calibrated = np.column_stack([c.logit(r) for c, r in zip(calibrations, raw, strict=True)])
    return CoTrained(views, calibrations, logistic(calibrated, y[cal]))


def _taught(view: Logistic, own: np.ndarray, lessons: list[np.ndarray], own_n: tuple) -> Logistic:
    """A view after a step on its labelled rows and, if there are lessons of both classes, on these."""
    if all(t[0] for t in lessons):
        own = own + sum(t * min(1.0, n / t[0]) for t, n in zip(lessons, own_n, strict=True))
    return stepped(view, own)


def features(docs: DataFrame) -> DataFrame:
    """``(id, a, b)`` for every row of ``docs``: both views as binary, little-endian 32-bit floats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *_inputs())

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            a = [text_view(t.as_py(), hashes).astype("<f4").tobytes() for t in batch.column(1)]
            b = [meta_view(*m).astype("<f4").tobytes() for m in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["id", "a", "b"])

    return rows.mapInArrow(mapped, "id long, a binary, b binary")


def _inputs() -> list[Column]:
    return [F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]


def _matrix(blobs: pa.Array | list, width: int) -> np.ndarray:
    joined = b"".join(x.as_py() for x in blobs) if isinstance(blobs, pa.Array) else b"".join(map(bytes, blobs))
    return np.frombuffer(joined, "<f4").reshape(-1, width).astype(float)


def summed_lessons(pool: DataFrame, views: list[Logistic], prior: float, confident: float = CONFIDENT) -> list[np.ndarray]:
    """``pool_lessons`` over all rows of ``pool(a, b)``: each task adds up its own, then groups of tasks do, until the driver has 64 vectors at most."""

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            now = np.concatenate(pool_lessons(views, prior, _matrix(batch.column(0), N_TEXT), _matrix(batch.column(1), N_META), confident))
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def added(key: tuple, part: pa.Table) -> pa.Table:
        # In order of their parts, so that a repeated run adds floats up alike.
        total = sum(np.frombuffer(x.as_py()) for x in part.sort_by("part")["sums"])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    sums, n = pool.select("a", "b").mapInArrow(taught, "part long, sums binary"), pool.rdd.getNumPartitions()
    while n > _FAN_IN:
        n = -(-n // _FAN_IN)
        sums = sums.withColumn("into", F.pmod("part", F.lit(n))).groupBy("into").applyInArrow(added, "part long, sums binary")
    rows = sorted(sums.collect(), key=lambda r: r["part"])
    widths = [2 * (1 + (v := N + 1) + v * v) for N in (N_TEXT, N_META)]
    total = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(sum(widths)))
    return np.split(total, [widths[0]])


def fit(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Fit on ``labelled`` labelled documents at most, chosen by a hash of their ids, and on all other ``rows`` (of ``features``) as the pool.

    A document with several labels has their mean, rounded up at a half; null labels and ids count for
    nothing. Of rows with the id of a label one is taken, the least by its features.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))
    # ``labelled`` rows of 16 bytes at most.
    chosen = F.broadcast(known.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(labelled))
    picked = rows.join(chosen, "id").groupBy("id", "y").agg(F.min(F.struct("a", "b")).alias("v"))
    first = sorted(picked.select("id", "y", "v.a", "v.b").collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    y = np.array([r["y"] for r in first], float)
    a, b = _matrix([r["a"] for r in first], N_TEXT), _matrix([r["b"] for r in first], N_META)
    pool = rows.join(chosen.select("id"), "id", "left_anti")
    return co_train_with(a, b, y, np.arange(len(y)) % 4 == 3, lambda views, prior: summed_lessons(pool, views, prior), rounds)


_SCORES = "p_text double, p_meta double, score double"


def score_columns(model: CoTrained) -> Column:
    """A struct (p_text, p_meta, score) for each row of a ``documents``-shaped table."""

    def scored(batches: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for texts, langs, sources, sizes in batches:
            a = np.array([text_view(t or b"", hashes) for t in texts], float).reshape(-1, N_TEXT)
            b = np.array([meta_view(x, y, None if pd.isna(z) else int(z)) for x, y, z in zip(langs, sources, sizes, strict=True)], float).reshape(-1, N_META)
            yield pd.DataFrame(model.scores(a, b), columns=["p_text", "p_meta", "score"])

    return F.pandas_udf(scored, _SCORES, functionType=204)(*_inputs())


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, labelled: int = LABELLED) -> DataFrame:
    """Return ``(doc_id, p_text, p_meta, score, kept)`` for every row of ``docs``.

    Null text, language, source and size have features of their own; rows with equal ids are scored each.
    Other columns are not read. An empty table gives an empty result; without usable labels all rows score 1.
    """
    bound_batches(docs.sparkSession)
    rows = materialise(features(docs))
    model = fit(rows, labels, labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_matrix(batch.column(1), N_TEXT), _matrix(batch.column(2), N_META))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], names=["doc_id", "p_text", "p_meta", "score"])

    return rows.mapInArrow(scored, f"doc_id long, {_SCORES}").withColumn("kept", F.col("score") >= keep)


def keep_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, with their columns, whatever these are called."""
    bound_batches(docs.sparkSession)
    rows = materialise(features(docs))
    model = fit(rows, labels)
    drop(rows)
    name = fresh(docs, "scores")
    return docs.withColumn(name, score_columns(model)).where(F.col(f"{name}.score") >= keep).drop(name)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: scores of every document by both views and combined."""
    from .common import table

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

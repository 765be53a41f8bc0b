"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into low-dimensional blocks. Two vectors within a squared distance of d
are within d / blocks in one block at least; so each block is range-joined under that budget, and the union
of the candidates is verified exactly. A pair is dealt with in the first block that finds it, so it is
counted once without being written down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, materialise
from .components import components
from .trie_join import _merge

COSINE, BLOCKS = 0.98, 8
#: Widths of a cell of the range join along a block's first two coordinates, neither below a block's reach; vectors near its border are
#: sent to the next cells too. A task searches a sorted first coordinate itself, so it is the second that must be narrow.
CELL, CELL_Y = 0.21, 0.075
#: Vectors of a cell that meet in one task; a larger cell is cut into chunks whose pairs are tasks.
CHUNK = 8192
_SLACK = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision times a power of two each, so that no square is too large or too small."""
    x = vectors.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors turned by two rounds of fixed signs and a Walsh-Hadamard transform, padded to a power of two.

    Only element-wise operations and sums along a row are used, so a vector's result does not depend on the
    batch that it is in.
    """
    n, d = vectors.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, size))
    x[:, :d] = scaled(vectors)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    signs = np.random.default_rng(20_240_229).choice([-1.0, 1.0], (2, size))
    for s in signs:
        x *= s
        h = 1
        while h < size:
            y = x.reshape(n, -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
            h *= 2
        x = x / np.sqrt(size)
    return x


def _blocks(size: int, blocks: int) -> int:
    return min(blocks, size)


def _distance(x: np.ndarray, y: np.ndarray, block: int, width: int) -> np.ndarray:
    """Squared distances in a block, added up in one order everywhere."""
    total = np.zeros(len(x))
    for k in range(block * width, (block + 1) * width):
        total += (x[:, k] - y[:, k]) ** 2
    return total


def _near(x: np.ndarray, y: np.ndarray, block: int, width: int, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with rows x[i] and y[j] within the budget in the block; both sorted by its first coordinate."""
    first, reach = block * width, np.sqrt(budget)
    ys = y[:, first]
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        lo, hi = np.searchsorted(ys, part[0, first] - reach), np.searchsorted(ys, part[-1, first] + reach, side="right")
        if lo == hi:
            continue
        d = (part[:, first, None] - ys[None, lo:hi]) ** 2
        if width > 1:
            d += (part[:, first + 1, None] - y[None, lo:hi, first + 1]) ** 2
        i, j = np.nonzero(d <= budget)
        d = d[i, j]
        i, j = i + at, j + lo
        for k in range(first + 2, first + width):
            d = d + (x[i, k] - y[j, k]) ** 2
            keep = d <= budget
            i, j, d = i[keep], j[keep], d[keep]
        if len(i):
            yield i, j


def linked(home: tuple, other: tuple | None, block: int, cosine: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join of two sets (ids, weights, vectors) in a block; of ``home`` with itself if ``other`` is None.

    Returns ids, the weight of their partners and the least-position member of their group, for ids with a partner.
    """
    sets = [home] if other is None else [home, other]
    turned = [rotated(v) for _, _, v in sets]
    width = turned[0].shape[1] // _blocks(turned[0].shape[1], blocks)
    order = [np.argsort(t[:, block * width], kind="stable") for t in turned]
    ids, weights, exact = (np.concatenate([s[k][o] for s, o in zip(sets, order, strict=True)]) for k in range(3))
    turned = [t[o] for t, o in zip(turned, order, strict=True)]
    exact = scaled(exact)
    norms = np.sqrt((exact * exact).sum(axis=1))
    shift = 0 if other is None else len(turned[0])
    budget = (2 - 2 * cosine) / _blocks(turned[0].shape[1], blocks) + _SLACK
    x, y = turned[0], turned[-1]
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in _near(x, y, block, width, budget):
        keep = i < j if other is None else np.ones(len(i), bool)
        for b in range(block):  # an earlier block has this pair
            keep[keep] = _distance(x[i[keep]], y[j[keep]], b, width) > budget
        i, j = i[keep], j[keep] + shift
        i, j = (k[(exact[i] * exact[j]).sum(axis=1) / (norms[i] * norms[j]) >= cosine] for k in (i, j)) if len(i) else (i, j)
        if not len(i):
            continue
        np.add.at(links, i, weights[j])
        np.add.at(links, j, weights[i])
        new = labels[i] != labels[j]
        if new.any():
            _merge(labels, labels[i][new], labels[j][new])
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], ids[labels[hit]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS, cell: float = CELL, cell_y: float = CELL_Y, chunk: int = CHUNK) -> DataFrame:
    """Return ``(id, n_links, component)`` for every row of ``vectors``.

    Vectors are compared within a label and a number of dimensions, in double precision from the components as
    they are. Null vectors, zero vectors, vectors with a null or non-finite component, rows with a null label
    and rows with a null id link with nothing. Identical vectors of a label are joined as one with a weight
    and all linked, so copies cost no pairs. Rows that repeat an id are vectors of their own, each with its own
    links; a component's name is the least id in it. Other columns are not read. An empty table gives an empty result.
    """
    bound_batches(vectors.sparkSession, 5000)
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    dtype, kind_of = (np.float32, "array<float>") if narrow else (np.float64, "array<double>")
    v = F.col(vector_col).cast(kind_of)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable, F.col(label_col)).alias("label"), F.when(usable, v).alias("v"))
    copies = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"))
    copies = materialise(copies.withColumn("rep", F.monotonically_increasing_id()))  # a number of its own for each vector, fixed once it is written

    side_x, side_y = cell, cell_y

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in v])
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                plain = np.array([v[k] for k in pick], dtype)
                turned = rotated(plain)
                m = _blocks(turned.shape[1], blocks)
                width = turned.shape[1] // m
                reach = np.sqrt((2 - 2 * cosine) / m + _SLACK) + 1e-12
                cell, cell_y = max(side_x, 1.001 * reach), max(side_y, 1.001 * reach)  # fewer blocks reach farther
                # The first two coordinates of each block; blocks of one coordinate have one row of cells.
                x, y = turned[:, ::width], turned[:, 1::width] if width > 1 else np.full((len(plain), m), cell_y / 2)
                cx, cy = (np.floor(c / side).astype(np.int64) for c, side in ((x, cell), (y, cell_y)))
                up, down = np.floor((y + reach) / cell_y) > cy, np.floor((y - reach) / cell_y) < cy
                right = np.floor((x + reach) / cell) > cx
                # Cells are no narrower than the reach, so what meets in a block is in the same cell or in neighbours. A vector visits the neighbours that follow its own cell in
                # order, so two vectors of different cells meet in the later one and nowhere else.
                visits = [(np.ones_like(right), 0, 0), (up, 0, 1), (right & down, 1, -1), (right, 1, 0), (right & up, 1, 1)]
                at, b, px, py, guest = [], [], [], [], []
                for n, (there, dx, dy) in enumerate(visits):
                    i, k = np.nonzero(there)
                    at, b, px, py, guest = [*at, i], [*b, k], [*px, cx[i, k] + dx], [*py, cy[i, k] + dy], [*guest, np.full(len(i), n > 0)]
                at, b, px, py, guest = map(np.concatenate, (at, b, px, py, guest))
                blobs = [x.tobytes() for x in plain]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pick[at])), pa.array(np.full(len(at), d), pa.int32()), pa.array(b, pa.int32()), pa.array(px, pa.int64()), pa.array(py, pa.int64()), pa.array(guest), batch.column(1).take(pa.array(pick[at])), batch.column(3).take(pa.array(pick[at])), pa.array([blobs[k] for k in at], pa.binary())], names=["label", "dims", "block", "x", "y", "guest", "rep", "w", "blob"])

    kind = copies.schema["label"].dataType.simpleString()
    dealt = materialise(copies.select("label", "rep", "v", "w").mapInArrow(cells, f"label {kind}, dims int, block int, x long, y long, guest boolean, rep long, w long, blob binary"))
    key = ["label", "dims", "block", "x", "y"]
    large = materialise(dealt.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select(*key, F.ceil(F.col("n") / chunk).cast("int").alias("c")))
    cut = dealt.join(large, key, "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int"))
    # Task (i, j) of a cell joins chunk i of its own vectors with chunk j of its guests and, if i <= j, with its own chunk j.
    others = F.sequence(F.lit(0), F.col("c") - 1)
    rows_of = F.transform(others, lambda o: F.struct(F.col("k").alias("i"), o.alias("j")))
    columns_of = F.transform(others, lambda o: F.struct(o.alias("i"), F.col("k").alias("j")))
    tasks = F.when(F.col("guest"), columns_of).otherwise(F.array_union(rows_of, columns_of))
    spread_ = cut.withColumn("t", F.explode(tasks)).select(*key, F.col("t.i").alias("i"), F.col("t.j").alias("j"), "k", "guest", "rep", "w", "blob")

    def joined(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        d, block, i, j = group[1], group[2], group[5], group[6]

        def of(which: pd.Series) -> tuple:
            x = part[which].sort_values("rep", kind="stable")
            return x["rep"].to_numpy(), x["w"].to_numpy(), np.frombuffer(b"".join(x["blob"]), dtype).reshape(-1, d)

        own = of(~part["guest"] & (part["k"] == i))
        found = []
        if len(own[0]):
            sides = [of(part["guest"])] + ([None if i == j else of(~part["guest"] & (part["k"] == j))] if i <= j else [])
            found = [linked(own, s, block, cosine, blocks) for s in sides if s is None or len(s[0])]
        return pd.DataFrame({"rep": np.concatenate([f[0] for f in found]), "links": np.concatenate([f[1] for f in found]), "root": np.concatenate([f[2] for f in found])}) if found else pd.DataFrame({"rep": [], "links": [], "root": []}, dtype="int64")

    found = materialise(spread_.groupBy(*key, "i", "j").applyInPandas(joined, "rep long, links long, root long"))
    drop(dealt)
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = materialise(copies.join(sums, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("label", "v", "w", F.coalesce("links", F.lit(0)).alias("links"), "least", "root"))
    leasts = named.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(leasts, "root", "left").select(F.col("label").alias("l"), F.col("v").alias("x"), (F.col("w") - 1 + F.col("links")).alias("n_links"), F.coalesce("component", "least").alias("component"))
    vertices = rows.where("v IS NOT NULL").join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("x"))).select("id", "n_links", "component")
    return vertices.union(rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: links and component of every vector."""
    from .common import table

    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.node AS vec_id, coalesce(c.n, 0) AS n_links, r.component_id, r.node = r.component_id AS kept
FROM roots r LEFT JOIN counts c ON c.a = r.node
"""

"""The trie of conversations' common beginnings, found by peeling off last turns.

Texts become digests on the JVM; one pass over each family of conversations rebuilds them and names every beginning by
a chained digest. From the deepest level on, the nodes of a level are the conversations that end there together
with the parents of the nodes below: the last turn is stripped, equal beginnings are grouped, and counts, leaves and
savings are summed on the way, so no level is looked at twice and a beginning is a row only once it is grouped.

Levels come in slabs, each twice as deep as all above it, so a conversation of many turns takes few jobs. In a slab, beginnings that share
what is above it are peeled together by one task, level after level; where these are more than a task should hold, their levels are
peeled by one aggregation each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

#: Levels of the first slab.
SLAB = 8
#: Turns (rows times their levels in the slab) that are peeled in one task at most.
CELLS = 200_000
#: Bytes of member ids that are hashed as one row.
PIECE = 1 << 20
#: A rebuilt conversation takes 0 to SHARED - 1 turns from the first of its family.
SHARED, FAMILY = 9, 5
_KEY = 16
ROOT = hashlib.sha256(b"").digest()[:_KEY]
_PATHS = "conv_id long, slab long, length long, top binary, key binary, keys array<binary>, sizes array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("slab", pa.int64()), ("length", pa.int64()), ("top", pa.binary()), ("key", pa.binary()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])


def shared_turns(conv_id: int) -> int:
    """How many turns conversation ``conv_id`` takes over."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


def above(slab: int, first: int = SLAB) -> int:
    """Levels above a slab."""
    return first << (slab - 1) if slab else 0


class _Path:
    """Keys and sizes of one rebuilt conversation, a slab at a time."""

    def __init__(self, conv_id: int, out: list[tuple], first: int):
        self.conv_id, self.out, self.first = conv_id, out, first
        self.slab = self.length = 0
        self.top = self.key = ROOT
        self.keys, self.sizes = [], []

    def add(self, digest: bytes, size: int) -> None:
        if self.length == above(self.slab + 1, self.first):
            self.out.append((self.conv_id, self.slab, None, self.top, self.key, self.keys, self.sizes))
            self.slab, self.top, self.keys, self.sizes = self.slab + 1, self.key, [], []
        self.key = hashlib.sha256(self.key + digest).digest()[:_KEY]
        self.keys.append(self.key)
        self.sizes.append(size)
        self.length += 1

    def end(self) -> None:
        self.out.append((self.conv_id, self.slab, self.length, self.top, self.key, self.keys, self.sizes))


def _walk(levels: int, rebuild: bool):
    """Over turns sorted by family, its first conversation ahead, and turn: a row per conversation and slab."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        family = now = None
        first: list[tuple[bytes, int]] = []
        path, skip, at = None, 0, 0
        for batch in batches:
            for base, conv, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if path:
                        path.end()
                    if base != family:
                        family, first = base, []
                    now, at, path = conv, 0, _Path(conv, out, levels)
                    skip = shared_turns(conv) if rebuild and conv != base else 0
                    for turn in first[:skip]:
                        path.add(*turn)
                if conv == base and at < SHARED - 1:
                    first.append((digest, size))
                if at >= skip:
                    path.add(digest, size)
                at += 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row, strict=True)) for row in out], _ARROW)
                out.clear()
        if path:
            path.end()
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row, strict=True)) for row in out], _ARROW)

    return walk


def paths(conversations: DataFrame, first: int = SLAB, rebuild: bool = True) -> DataFrame:
    """``(conv_id, slab, length, top, key, keys, sizes)``: the keys of the beginnings of every conversation, a row a slab; top is the key above it, length is null but in the last.

    ``conversations`` has conv_id, turn, role and text. Only digests of turns are shuffled; a family of FAMILY conversations is read as a sorted stream, so a long
    conversation takes no memory.
    """
    bound_batches(conversations.sparkSession, 5_000)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, _KEY)
    turns = conversations.select((conv - conv % FAMILY if rebuild else conv).alias("base"), conv.alias("conv_id"), F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")
    streamed = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
    return streamed.select("base", "conv_id", "digest", "size").mapInArrow(_walk(first, rebuild), _PATHS)


_ENDS = "key binary, conv_id long, length long, n_ends long, ends_sha256 string, slab long, top binary, keys array<binary>, sizes array<long>"
_PIECES = "key binary, conv_id long, length long, n_ends long, ids binary, slab long, top binary, keys array<binary>, sizes array<long>"


_PIECE_SCHEMA = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("length", pa.int64()), ("n_ends", pa.int64()), ("ids", pa.binary()), ("slab", pa.int64()), ("top", pa.binary()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])


def _pieces(limit: int):
    """Rows sorted by key and conversation become ids joined by commas, some ``limit`` bytes a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = None, [], 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is None or row["key"] != held["key"] or size > limit:
                    if held is not None:
                        out.append(held | {"n_ends": len(ids), "ids": ",".join(ids).encode()})
                    held, ids, size = row, [], 0
                ids.append(str(row["conv_id"]))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, _PIECE_SCHEMA)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"n_ends": len(ids), "ids": ",".join(ids).encode()}], _PIECE_SCHEMA)

    return cut


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and least id become one row a key with the SHA-256 of all its ids."""
    schema = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("length", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string()), ("slab", pa.int64()), ("top", pa.binary()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
    held, sha = None, hashlib.sha256()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = row.pop("ids")
            if held is not None and row["key"] == held["key"]:
                held["n_ends"] += row["n_ends"]
                sha.update(b"," + ids)
                continue
            if held is not None:
                out.append(held | {"ends_sha256": sha.hexdigest()})
            held, sha = row, hashlib.sha256(ids)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held | {"ends_sha256": sha.hexdigest()}], schema)


def ended(found: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each beginning at which conversations end: the least of them, how many, and the hash of their ids in ascending order.

    Ids are sorted over the whole cluster, so the members of one beginning are dealt to many tasks; only their decimal ids, ``piece`` bytes a row, meet
    in one task, which reads them as a stream.
    """
    ends = found.where("length IS NOT NULL").select("key", "conv_id", "length", "slab", "top", "keys", "sizes")
    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces(piece), _PIECES)
    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, _ENDS)


_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_ROWS = ("top", "keys", "sizes", "conv_id", *_SUMS, "ends_sha256")
_NODES = "depth long, key binary, parent_key binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, complete boolean"
_NODE_SCHEMA = pa.schema([("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), *((c, pa.int64()) for c in _SUMS), ("ends_sha256", pa.string()), ("complete", pa.bool_())])


def peel(top: bytes, rows: list[tuple], base: int) -> Iterator[tuple]:
    """The nodes below ``top``, whose depth is ``base``, and then what they add to it.

    ``rows`` are (keys, sizes, conv_id, n_convs, n_children, n_leaves, saved, ends): conversations that end in the slab, equal ones as one, and what
    nodes of the slab below add to their parents. The row of ``top`` is complete if it is the root.
    """
    ending: dict[int, list[tuple]] = {}
    for row in rows:
        ending.setdefault(len(row[0]), []).append(row)
    risen: list[tuple] = []
    for level in range(max(ending), -1, -1):
        nodes: dict[bytes, list] = {}
        for keys, sizes, *sums, ends in [*ending.pop(level, ()), *risen]:
            node = nodes.setdefault(keys[level - 1] if level else top, [keys, sizes, sums[0], 0, 0, 0, 0, None])
            node[2] = min(node[2], sums[0])
            for k in range(1, 5):
                node[2 + k] += sums[k]
            node[7] = node[7] or ends
        risen = []
        for key, (keys, sizes, conv, n, children, leaves, saved, ends) in nodes.items():
            if level or not base:
                leaves = leaves if children else 1
                saved += (n - 1) * sizes[level - 1] if level else 0
            yield base + level, key, (keys[level - 2] if level > 1 else top) if level else None, conv, n, children, leaves, saved, ends, bool(level or not base)
            risen.append((keys, sizes, conv, n, 1, leaves, saved, None))


def _peeled(base: int):
    """Rows sorted by ``top`` become nodes; a task holds the rows of one ``top`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, rows = None, []

        def nodes() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*peel(top, rows, base), strict=True), _NODE_SCHEMA, strict=True)], schema=_NODE_SCHEMA)

        for batch in batches:
            for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != top and rows:
                    yield nodes()
                    rows = []
                top = now
                rows.append(tuple(row))
        if rows:
            yield nodes()

    return run


def _level_by_level(rows: DataFrame, base: int, deepest: int) -> list[DataFrame]:
    """``peel`` as one aggregation a level, for any number of rows below one ``top``; ``deepest`` is the level of the longest keys."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string").alias("ends_sha256")
    out: list[DataFrame] = []
    for level in range(deepest, -1, -1):
        here = rows.where(F.size("keys") == level)
        if out:
            cut = [F.slice(c, 1, F.size(c) - 1).alias(c) for c in ("keys", "sizes")]
            here = here.unionByName(out[-1].select("top", *cut, "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", none))
        key = F.try_element_at("keys", F.lit(level)) if level else F.col("top")
        sums = [F.sum(c).alias(c) for c in _SUMS]
        node = here.groupBy(key.alias("key")).agg(F.min("conv_id").alias("conv_id"), F.min(F.struct("top", "keys", "sizes")).alias("path"), *sums, F.max("ends_sha256").alias("ends_sha256")).select("*", "path.*")
        whole = bool(level or not base)
        leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")) if whole else F.col("n_leaves")
        saved = F.col("saved_tokens") + ((F.col("n_convs") - 1) * F.element_at("sizes", level) if level else zero)
        parent = (F.element_at("keys", level - 1) if level > 1 else F.col("top")) if level else F.lit(None).cast("binary")
        out.append(materialise(node.select(F.lit(base + level).cast("long").alias("depth"), "key", parent.alias("parent_key"), "conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), "ends_sha256", F.lit(whole).alias("complete"), "top", "keys", "sizes")))
    return out


def _slab(rows: DataFrame, base: int, cells: int) -> list[DataFrame]:
    """All nodes of a slab, and what they add to the nodes above it (rows that are not complete)."""
    weight = F.size("keys") + 1
    # A top is here only if over `cells` turns lie below it, so there are rows / cells of them at most.
    large = materialise(rows.groupBy("top").agg(F.sum(weight).alias("cells"), F.max(F.size("keys")).alias("deepest")).where(F.col("cells") > cells))
    deepest = large.agg(F.max("deepest")).first()[0]
    small = rows if deepest is None else rows.join(large, "top", "left_anti")
    out = [materialise(small.select(*_ROWS).repartition("top").sortWithinPartitions("top").mapInArrow(_peeled(base), _NODES))]
    if deepest is not None:
        out += _level_by_level(rows.join(large, "top", "left_semi").select(*_ROWS), base, deepest)
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    """One scan of written steps, in the columns that they share."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*(x._textloom_path for x in frames))


def prefix_trie(conversations: DataFrame, first: int = SLAB, rebuild: bool = True, cells: int = CELLS) -> DataFrame:
    """Return the nodes of the trie: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    A conversation is its rows in the order of turn, null first; equal turns are ordered by the digest of role and
    text, and repeated rows are turns of their own. Null role or text is empty; rows without conv_id belong to no
    conversation. With ``rebuild`` a conversation's first turns are replaced by those of its family's first one (the
    contract's rule); without it conversations are taken as they are. Turnless conversations are members of the root.
    An empty table has no nodes, not even a root; other columns are not read.
    """
    found = materialise(paths(conversations, first, rebuild))
    ends = materialise(ended(found))
    last = ends.agg(F.max("slab")).first()[0]
    if last is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    zero = F.lit(0).cast("long")
    done: list[DataFrame] = []
    risen: DataFrame | None = None
    for slab in range(last, -1, -1):
        rows = ends.where(F.col("slab") == slab).select("top", "keys", "sizes", "conv_id", F.col("n_ends").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
        if risen is not None:  # the keys above a node are those of its least member
            whole = found.where((F.col("slab") == slab) & F.col("length").isNull()).select(F.col("conv_id").alias("member"), "top", "keys", "sizes")
            rows = materialise(rows.unionByName(risen.join(whole, F.col("conv_id") == F.col("member")).select(*_ROWS)))
        now = _slab(rows, above(slab, first), cells)
        done += now
        risen = _all(now).where("NOT complete").drop("key", "parent_key", "depth", "complete")
    nodes = _all(done).where("complete")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(parents, "parent_key", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Contract query: all nodes of the trie of the rebuilt conversations."""
    from .common import table

    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
  SELECT c, j, ascii(substr(c::VARCHAR, j::INTEGER, 1)) AS b FROM (SELECT c, unnest(range(1, length(c::VARCHAR) + 1)) AS j FROM (SELECT DISTINCT c FROM own))
), crc(c, j, k, v) AS (  -- bit by bit: k counts the eight steps of byte j
  WITH RECURSIVE step(c, j, k, v) AS (
    SELECT c, j, 0, xor(4294967295, b)::BIGINT FROM bytes WHERE j = 1
    UNION ALL
    SELECT step.c, CASE WHEN step.k < 8 THEN step.j ELSE step.j + 1 END, CASE WHEN step.k < 8 THEN step.k + 1 ELSE 0 END,
           CASE WHEN step.k < 8 THEN xor(step.v >> 1, 3988292384 * (step.v & 1)) ELSE xor(step.v, n.b) END
    FROM step LEFT JOIN bytes n ON n.c = step.c AND n.j = step.j + 1
    WHERE step.k < 8 OR n.b IS NOT NULL
  ) SELECT * FROM step
), ids AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, v) % 9 AS h FROM crc WHERE k = 8 AND j = length(c::VARCHAR)
), rebuilt AS (
  SELECT ids.c, 0 AS part, own.i, role, text FROM ids JOIN own ON own.c = ids.base WHERE own.i <= h
  UNION ALL
  SELECT ids.c, 1, own.i, role, text FROM ids JOIN own ON own.c = ids.c WHERE own.i > h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, role, text FROM rebuilt
), member AS (
  SELECT c, 0 AS d, [] AS k, 0 AS size FROM ids
  UNION ALL
  SELECT c, d, list([role, text]) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), strlen(text) FROM turns
), lasts AS (
  SELECT c, max(d) AS d FROM member GROUP BY c
), node AS (
  SELECT d, k, min(c) AS id, count(*) AS n, any_value(size) AS size FROM member GROUP BY d, k
), above AS (
  SELECT x.id, x.d, x.k, p.k AS up, p.id AS parent FROM node x JOIN member m ON m.c = x.id AND m.d = x.d - 1 JOIN node p ON p.d = m.d AND p.k = m.k
), kids AS (
  SELECT d - 1 AS d, up AS k, count(*) AS n FROM above GROUP BY 1, 2
), below AS (
  SELECT m.d, m.k, count(*) FILTER (kids.n IS NULL) AS leaves, sum((x.n - 1) * x.size)::BIGINT AS saved
  FROM node x LEFT JOIN kids ON kids.d = x.d AND kids.k = x.k JOIN member m ON m.c = x.id AND m.d <= x.d GROUP BY m.d, m.k
), ends AS (
  SELECT m.d, m.k, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS ids FROM member m JOIN lasts USING (c, d) GROUP BY m.d, m.k
)
SELECT node.id AS conv_id, node.d::BIGINT AS depth, above.parent AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       below.leaves AS n_leaves, below.saved AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node JOIN below USING (d, k) LEFT JOIN above USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k)
"""

"""Ranked lexical search by one scan of the documents, without an index of them.

The terms of all items become one Aho-Corasick automaton whose words are guarded by a blank on either side, so it
finds whole terms only. It is broadcast, every text is run through it once, and what it puts out are the numbers
of terms, which lead to the items that hold them. A document's counts are written as two short arrays; document
frequencies are summed from these, and the scores are made from them without another look at the texts.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, raw

#: Characters of distinct terms in one automaton at most (an automaton takes some 40 bytes a character); more items
#: take more scans. One item beyond it has an automaton of its own.
CHARS = 1_000_000
#: Cells of documents times items that are scored at a time in a task.
CELLS = 2_000_000
_A, _Z = ord("A"), ord("Z")
#: ASCII letters and digits are parts of terms, as is all beyond ASCII; A-Z are lowered; all else is a blank.
_FOLD = bytes(c + 32 if _A <= c <= _Z else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order and with repeats."""
    return text.translate(_FOLD).split() if text else []


class Items:
    """A set of items with the automaton of their terms.

    ``owners`` and ``times`` are the items that hold a term and how often, term by term; term t's lie between
    ``starts[t]`` and ``starts[t + 1]``.
    """

    def __init__(self, items: list[tuple[object, Counter]]):
        self.ids = [item for item, _ in items]
        terms: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, counts) in enumerate(items):
            for term, n in counts.items():
                terms.setdefault(term, []).append((k, n))
        self.starts = np.cumsum([0, *map(len, terms.values())])
        self.owners = np.array([k for held in terms.values() for k, _ in held], np.int64)
        self.times = np.array([n for held in terms.values() for _, n in held], np.int64)
        machine = ahocorasick.Automaton()
        for t, term in enumerate(terms):
            machine.add_word(f" {term.decode('utf-8', 'surrogateescape')} ", t)
        machine.make_automaton()
        self.machine = pickle.dumps(machine)
        self.n_terms = len(terms)


def item_sets(items: DataFrame, id_col: str, text_col: str, chars: int = CHARS) -> Iterator[Items]:
    """Sets of items whose distinct terms have ``chars`` characters at most together; items without terms are left out."""
    held: list[tuple[object, Counter]] = []
    seen: set[bytes] = set()
    size = 0
    for row in items.select(F.col(id_col).alias("id"), raw(text_col).alias("text")).toLocalIterator():
        counts = Counter(terms_of(bytes(row.text)))
        if not counts:
            continue
        more = sum(len(t) for t in counts if t not in seen)
        if held and size + more > chars:
            yield Items(held)
            held, seen, size = [], set(), 0
            more = sum(map(len, counts))
        held.append((row.id, counts))
        seen.update(counts)
        size += more
    if held:
        yield Items(held)


_machines: dict[str, ahocorasick.Automaton] = {}


def _machine(name: str, pickled: bytes) -> ahocorasick.Automaton:
    """The automaton called ``name``, unpickled once a worker; earlier ones are let go."""
    if name not in _machines:
        _machines.clear()
        _machines[name] = pickle.loads(pickled)
    return _machines[name]


def term_counts(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with a term: all its terms, and the counts of the items' terms in it (int32 arrays)."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items.machine)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, shared.value)
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folded = text.as_py().translate(_FOLD)
                n = len(folded.split())
                if n:
                    found = Counter(t for _, t in machine.iter(f" {folded.decode('utf-8', 'surrogateescape')} "))
                    ids.append(doc)
                    ns.append(n)
                    terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                    tfs.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n long, terms binary, tfs binary")


def corpus_counts(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term; each task sends one array of sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for n, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[np.frombuffer(terms, np.int32)] += 1
                sums[n_terms:] += (1, n)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["k", "v"])

    out = np.zeros(n_terms + 2, np.int64)
    # As many rows as the automaton has terms at most.
    for k, v in counts.select("n", "terms").mapInArrow(add, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[k] = v
    return int(out[n_terms]), int(out[n_terms + 1]), out[:n_terms]


def _sums(rows: int, items: int, row: np.ndarray, item: np.ndarray, value: np.ndarray, exact: bool) -> np.ndarray:
    """Sum of ``value`` by row and item; in doubles where these hold every sum exactly."""
    if exact:
        return np.bincount(row * items + item, value, rows * items).reshape(rows, items)
    out = np.zeros((rows, items), np.int64)
    np.add.at(out, (row, item), value)
    return out


def best_documents(counts: DataFrame, items: Items, n_docs: int, n_all: int, df: np.ndarray, top: int) -> DataFrame:
    """``(item, item_id, doc_id, score)``: each task's ``top`` documents of every item, by score and then by least id."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    used = np.repeat(np.arange(items.n_terms), np.diff(items.starts))
    worth = items.times * weight[used]
    live = worth > 0  # a term of nearly every document weighs nothing
    starts = np.concatenate(([0], np.cumsum(np.bincount(used[live], minlength=items.n_terms))))
    owners, worth, ids = items.owners[live], worth[live], items.ids
    exact = int(np.bincount(owners, worth.astype(float), len(ids)).max(initial=0)) * 10**6 < 2**52
    step = max(1, CELLS // len(ids))

    def scores(rows: list[tuple]) -> np.ndarray:
        terms = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        tf = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows])
        norm = np.array([12 * (75 + 25 * r[1] * n_docs // n_all) for r in rows], np.int64)[row]
        share = 1_000_000_000 * tf // (1000 * tf + norm)
        many = starts[terms + 1] - starts[terms]
        each = np.repeat(np.arange(len(terms)), many)
        at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + starts[terms][each]
        return _sums(len(rows), len(ids), row[each], owners[at], worth[at] * share[each], exact)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        least = np.ones(len(ids))  # a score has to be above 0
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                found = scores(part)
                for r, i in zip(*(x.tolist() for x in np.nonzero(found >= least)), strict=True):
                    doc, held = part[r][0], best[i]
                    new = (int(found[r, i]), -(2**63) if doc is None else -doc, doc is None)
                    if len(held) < top:
                        heapq.heappush(held, new)
                    elif new > held[0]:
                        heapq.heapreplace(held, new)
                    if len(held) == top:
                        least[i] = held[0][0]
        out = [(i, ids[i], None if null else -low, score) for i, held in enumerate(best) for score, low, null in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])

    return counts.select("doc_id", "n", "terms", "tfs").mapInArrow(choose, "item long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chars: int = CHARS) -> DataFrame:
    """Return ``(item_id, rank, doc_id, score)``: the ``top`` documents with a score above 0 of every row of ``items``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z are lowered. Null texts
    have no terms; items without terms, or none of whose terms weighs anything, have no rows. Equal scores are ranked by
    ascending id, a null id after the others. Documents that repeat an id are documents of their own; so are
    items, each with ranks of its own, a null item_id included. Empty tables give an empty result; other columns are not read.
    ``chars`` bounds an automaton: items beyond it take another scan of the documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in item_sets(items.withColumn(item_col, F.col(item_col).cast("long")), item_col, item_text, chars):
        counts = materialise(term_counts(docs, some, id_col, text_col))
        n_docs, n_all, df = corpus_counts(counts, some.n_terms)
        if n_docs:
            found = best_documents(counts, some, n_docs, n_all, df, top)
            place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            out = out.union(found.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= top))
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 20 best documents of each benchmark item."""
    from .common import table

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), it AS (
  SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_all FROM d WHERE len(terms) > 0
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
), scored AS (
  SELECT q, item_id, doc_id, r,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(d.terms) * n_docs) // n_all))))::BIGINT AS score
  FROM it JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), s
  GROUP BY q, item_id, doc_id, r
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 20
"""

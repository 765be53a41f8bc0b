"""SimHash near-duplicates: fingerprints of word shingles, joined over a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_shuffles, materialise, raw
from .components import components
from .trie_join import trie_links

#: Words in a shingle, seed of its XXH64, and the most bits in which linked fingerprints differ.
SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints in one unit of the join: 16 bytes each, so a unit is 16 MB at most.
UNIT = 1 << 20
_LEAST_BITS, _MOST_BITS = 4, 16


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of UTF-8 bytes: bit j is 1 if over half of the shingles' hashes have it.

    A-Z are lower-cased, words are runs without ASCII white space; with fewer words than a shingle the whole
    sequence is one shingle; without words the fingerprint is 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[k : k + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(j) for j in np.flatnonzero(2 * ones > len(hashes)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, hashed: bool = False) -> DataFrame:
    """``(id, fp)`` for every row; fp is the fingerprint's 64 bits as a signed long. With ``hashed`` also ``sha``, the SHA-256 of the text."""
    extra = [F.sha2(raw(text_col), 256).alias("sha")] if hashed else []
    names = ["id", "fp", *(["sha"] if hashed else [])]
    bound_batches(docs.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(simhash(x.as_py(), shingle, seed)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), raw(text_col).alias("t"), *extra).mapInArrow(mapped, "id long, fp long" + ", sha string" * hashed)


def hamming_links(fps: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct ``fps(fp)`` which differ in ``budget`` bits or fewer.

    Fingerprints are cut into units: subtrees of the trie by their first bits, large subtrees into chunks.
    Two units whose prefixes are within the budget meet in one task, which joins their tries. Each unit is
    written once; a row for each unit that it meets is made from it on the JVM. A task returns a star for
    each group it finds, not its pairs, so a dense group costs a row a member.
    """
    total = fps.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, (max(1, total) // unit).bit_length()))
    prefix = F.shiftrightunsigned("fp", 64 - bits).cast("int")
    # Two integers for each of 2^bits prefixes: 65,536 rows at most, whatever the input.
    sizes = materialise(fps.groupBy(prefix.alias("p")).agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("n")))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": [key[0]], "c": [key[1]], "blob": [np.sort(rows["fp"].to_numpy().view(np.uint64)).tobytes()]})

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = {u: np.frombuffer(x, np.uint64) for u, x in zip(rows["unit"], rows["blob"], strict=True)}
        left, right = sides.get(key[0]), sides.get(key[1]) if key[0] != key[1] else None
        if left is None or right is None and key[0] != key[1]:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        labels = trie_links(left, right, budget)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        both = (left if right is None else np.concatenate([left, right])).view(np.int64)
        return pd.DataFrame({"a": both[linked], "b": both[labels[linked]]})

    chunked = fps.select("fp", prefix.alias("p")).join(F.broadcast(sizes), "p").select("fp", "p", F.pmod(F.hash("fp"), "n").cast("int").alias("c"))
    units = materialise(chunked.groupBy("p", "c").applyInPandas(packed, "p int, c int, blob binary"))
    masks = [m for m in range(1 << bits) if m.bit_count() <= budget]
    around = units.withColumn("q", F.explode(F.transform(F.lit(masks), lambda m: F.col("p").bitwiseXOR(m))))
    met = around.join(F.broadcast(sizes.withColumnRenamed("p", "q")), "q").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    name = lambda p, c: F.shiftleft(F.col(p).cast("long"), 32) + F.col(c)
    mine, other = name("p", "c"), name("q", "k")
    ends = met.select(F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"), mine.alias("unit"), "blob")
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A few pairs of units a task, of which there may be many: small rows would have them put into few tasks.
    tasks = max(1, min(100_000, n * n * len(masks) // (6 << bits)))
    return ends.repartition(tasks, "low", "high").groupBy("low", "high").applyInPandas(joined, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Return ``(id, fp, component)`` for every row of ``docs``; component is the smallest id reachable by links.

    Fingerprints that differ in ``budget`` bits or fewer link their documents. Null and empty texts have
    fingerprint 0 and link like others. Rows with equal ids are rows of their own; rows with a null id take
    part, but name a component (as null) only if no row of it has an id. Other columns are not read. An
    empty table gives an empty result.
    """
    rows, named = _named(docs, id_col, text_col, budget, shingle, seed)
    return rows.join(named, "fp").select("id", "fp", "component")


def near_keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Return ``(id, sha, n)``, one row of each near-duplicate group: its smallest id (null only if it has no other), then SHA-256 of the text, and how many rows have both."""
    rows, named = _named(docs, id_col, text_col, budget, shingle, seed, True)
    placed = rows.groupBy("id", "fp", "sha").agg(F.count(F.lit(1)).alias("n")).join(named, "fp")
    return placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "sha", "n")).alias("k")).select("k.id", "k.sha", "k.n")


def _named(docs: DataFrame, id_col: str, text_col: str, budget: int, shingle: int, seed: int, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and ``(fp, root, component)`` of the distinct ones."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, seed, hashed))
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    found = materialise(hamming_links(nodes.select("fp"), budget))
    free_shuffles(docs.sparkSession)
    roots = components(found)
    rooted = materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("fp", "root", "component")
    return rows, named


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    from .common import table

    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

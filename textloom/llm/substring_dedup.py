"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is a fixed number of consecutive words. Each window is filed under one of its own phrases (the one
with the least hash, its anchor), so equal windows are filed alike; phrases that occur once in the corpus
rule out nearly all windows. What stands under recurring anchors is cut out of every document as segments and
dealt to shards by anchor; equal segments are one with a count. A shard confirms which windows recur, joins
those that always stand together to passages, compiles the passages into an automaton, and streams its
segments through it to locate every occurrence and the first one. A document meets the automata of its own
anchors only, since no other can find anything in it: work and traffic grow with the repeated text, not with
automata times documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, free_shuffles, materialise, raw

WINDOW, PHRASE = 20, 8
#: Occurrences above which a phrase's windows are filed one by one, each under its own words.
HOT = 8192
#: Distinct segments in one shard, on average.
SHARD = 4000
_MEMO = 400_000
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _poly(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of every ``n`` consecutive entries."""
    out, length, power, block, size = None, 0, 1, h, 1
    base = _BASE
    while True:
        if n & size:
            count = len(h) - length - size + 1
            piece = block[length : length + max(0, count)] * np.uint64(power)
            out = piece if out is None else out[: len(piece)] + piece
            length, power = length + size, power * base & _ALL
        if size * 2 > n:
            return out
        block = block[:-size] + block[size:] * np.uint64(base) if len(block) > size else block[:0]
        base, size = base * base & _ALL, size * 2


def _mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return g ^ (g >> np.uint64(33))


def _leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least entry in every ``width`` consecutive ones."""
    value, at, size = g, np.arange(len(g)), 1

    def merged(step: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[step:] < value[:-step]
        return np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])

    while size * 2 <= width:
        value, at = merged(size)
        size *= 2
    if size < width:
        value, at = merged(width - size)
    return at


def anchors(h: np.ndarray, room: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of the anchors in order, for word hashes of several documents; ``room`` is how many words a document has from each word on."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _mixed(_poly(h, phrase))
    at = _leftmost_least(g, window - phrase + 1)
    windows = np.flatnonzero(room[: len(at)] >= window)
    at = at[windows]
    # Windows of two documents never share a position, so a document begins with an anchor of its own.
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[starts]], windows[starts], windows[np.append(starts[1:], len(windows)) - 1] if len(starts) else windows


class _Words:
    """Words of a batch of texts, one document after the other."""

    def __init__(self, texts: pa.Array, hashes: _Hashes):
        split = [t.as_py().split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.ends = np.cumsum(self.sizes)
        self.words = list(chain.from_iterable(split))
        self.h = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, len(self.words))
        self.room = np.repeat(self.ends, self.sizes) - np.arange(len(self.words))
        if len(hashes) > _MEMO:
            hashes.clear()

    def row(self, at: np.ndarray) -> np.ndarray:
        """The document of each position."""
        return np.searchsorted(self.ends, at, side="right")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(k, x, id, t)``: order of the documents, and their bytes; and the same without repeated documents. Null ids come last.

    x tells documents with one id apart, by a hash of the text; it is 0 throughout where no id is repeated.
    """
    text = raw(text_col)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k"), F.col(id_col).cast("long").alias("id"), text.alias("t"))
    repeats = not keyed.groupBy("k").count().where("count > 1").isEmpty()
    keyed = keyed.select("k", (F.xxhash64("t") if repeats else F.lit(0).cast("long")).alias("x"), "id", "t")
    return keyed, keyed.dropDuplicates(["k", "x"]) if repeats else keyed


def _found_anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(k, x, hash, n)``: how often each anchor stands in a document."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            words = _Words(batch.column(2), hashes)
            found, first, _ = anchors(words.h, words.room, window, phrase)
            row = words.row(first)
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(found, prepend=np.uint64(0)) != 0)) if len(row) else row
            rows = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found[new].view(np.int64)), pa.array(np.diff(np.append(new, len(row))).astype(np.int32))], names=["k", "x", "hash", "n"])

    return docs.select("k", "x", "t").mapInArrow(mapped, "k long, x long, hash long, n int")


def _segments(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``(key, digest, words, k, x, start)`` of the segments under recurring anchors; ``docs`` has those as arrays again and hot.

    A task gives the words of a segment with its first occurrence; they are null with most later ones.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _Hashes(), set()
        for batch in batches:
            words = _Words(batch.column(2), hashes)
            found, first, last = anchors(words.h, words.room, window, phrase)
            again, hot = (batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (3, 4))
            here = np.isin(found, again)
            found, first, last = found[here], first[here], last[here]
            lone = np.isin(found, hot)
            many = np.where(lone, last - first + 1, 1)
            start = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            lone = np.repeat(lone, many)
            end = np.where(lone, start, np.repeat(last, many)) + window
            key = np.where(lone, _mixed(_poly(words.h, window))[start], np.repeat(found, many)) if len(start) else np.zeros(0, np.uint64)
            joined = b" ".join(words.words)
            offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words.words), np.int64, len(words.words)) + 1)])
            text = [joined[a:b] for a, b in zip(offset[start].tolist(), (offset[end] - 1).tolist(), strict=True)]
            digest = list(map(xxhash.xxh3_128_digest, text))
            for n, d in enumerate(digest):
                if d in known:
                    text[n] = None
                else:
                    known.add(d)
            if len(known) > _MEMO:
                known.clear()
            row = words.row(start)
            place = start - (words.ends - words.sizes)[row]
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest, pa.binary()), pa.array(text, pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place, pa.int64())], names=["key", "digest", "words", "k", "x", "start"])

    return docs.select("k", "x", "t", "again", "hot").mapInArrow(mapped, "key long, digest binary, words binary, k long, x long, start long")


#: An odd base and its inverse modulo 2^64.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
#: Words that characters can stand for: all code points but the surrogates and the separator.
_CHARACTERS = 0x110000 - 0x800 - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _passages(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, last window) of the passages: runs of recurring windows that stand together wherever one of them stands.

    The first three have the hash, segment and place of each window. Windows are in one run if their
    occurrences lie on the same diagonals, which a sum over the occurrences tells: an occurrence at position q
    of segment s adds r(s) * g^q, and dividing by g^o for the window's own position o makes the sums of
    windows on the same diagonals equal.
    """
    _, inverse = np.unique(hashes, return_inverse=True)
    recurs = (np.bincount(inverse, np.minimum(times, 2)[owner]) > 1)[inverse]
    longest = int(place.max(initial=0)) + 1
    parts = (_mixed(np.arange(1, len(times) + 1, dtype=np.uint64)) | np.uint64(1))[owner] * _powers(_STEP, longest)[place]
    order = np.argsort(inverse, kind="stable")
    sums = np.add.reduceat(parts[order], np.flatnonzero(np.diff(inverse[order], prepend=-1)))
    diagonals = sums[inverse] * _powers(_BACK, longest)[place]
    joined = np.zeros(len(hashes), bool)
    joined[1:] = recurs[1:] & recurs[:-1] & (owner[1:] == owner[:-1]) & (diagonals[1:] == diagonals[:-1])
    first = np.flatnonzero(recurs & ~joined)
    last = np.flatnonzero(recurs & ~np.append(joined[1:], False))
    return owner[first], place[first], place[last]


def located_runs(segments: list[list[bytes]], times: np.ndarray, firsts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Every occurrence of a recurring passage in the segments: rows (segment, first window, windows, k, x, start).

    ``times`` has how often a segment occurs, a row (k, x, start) of ``firsts`` its first occurrence; the last
    three columns of the result are the first occurrence of the passage. The automaton's patterns are the
    passages that windows with equal hashes suggest; what it finds in the segments decides. A character stands
    for each distinct word, so all segments are one string with separators.
    """
    import ahocorasick

    nothing = np.zeros((0, 6), np.int64)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    flat = list(chain.from_iterable(segments))
    numbers = dict(zip(dict.fromkeys(flat), count(1)))
    base = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(segments)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = np.zeros(int(sizes.sum()) + len(segments), np.uint32)
    codes[base[owner] + place] = np.fromiter(map(numbers.__getitem__, flat), np.uint32, len(flat))
    windows = place + window <= sizes[owner]
    if not windows.any():
        return nothing
    hashes = _mixed(_poly(codes.astype(np.uint64), window))
    owner, place = owner[windows], place[windows]
    if len(numbers) <= _CHARACTERS:
        text = (codes + np.uint32(0x800) * (codes >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton()
    else:
        text = tuple(codes.tolist())
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    known: dict = {}
    s, a, b = _passages(hashes[base[owner] + place], owner, place, np.asarray(times))
    for begin, end in zip((base[s] + a).tolist(), (base[s] + b + window).tolist(), strict=True):
        # Every suggestion is looked at, so two passages whose windows' hashes are equal are two patterns.
        passage = text[begin:end]
        if passage not in known:
            known[passage] = len(known)
            automaton.add_word(passage, known[passage])
    if not known:
        return nothing
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    p, lengths = hits[:, 1], np.fromiter(map(len, known), np.int64, len(known))
    begin = hits[:, 0] + 1 - lengths[p]
    segment = np.searchsorted(base, begin, side="right") - 1
    offset = begin - base[segment]
    where = np.asarray(firsts, np.int64).reshape(-1, 3)[segment] + offset[:, None] * np.array([0, 0, 1])
    order = np.lexsort((where[:, 2], where[:, 1], where[:, 0], p))
    best = where[order[np.flatnonzero(np.diff(p[order], prepend=-1))]]
    twice = (np.bincount(p, np.minimum(times, 2)[segment], len(known)) > 1)[p]
    return np.column_stack([segment, offset, lengths[p] - window + 1, best[p]])[twice]


def locate(segments: list[list[bytes]], times: list[int], firsts: list[tuple], window: int = WINDOW) -> list[dict[int, tuple]]:
    """For each segment, its recurring windows by their start, with the first occurrence in the corpus."""
    out: list[dict[int, tuple]] = [{} for _ in segments]
    for s, o, n, k, x, start in located_runs(segments, np.array(times), np.array(firsts), window).tolist():
        for j in range(n):
            where = (k, x, start + j)
            out[s][o + j] = min(out[s].get(o + j, where), where)
    return out


def _runs(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """``(key, digest, o, n, fk, fx, fs)``: a run of n windows of a segment that recur, from window o on, and where it stands first."""

    def located(rows: pd.DataFrame) -> pd.DataFrame:
        segments = [bytes(w).split(b" ") for w in rows["words"]]
        found = located_runs(segments, rows["times"].to_numpy(), rows[["k", "x", "start"]].to_numpy(), window)
        named = dict(zip(("o", "n", "fk", "fx", "fs"), found[:, 1:].T, strict=True))
        return pd.DataFrame({"key": rows["key"].to_numpy()[found[:, 0]], "digest": rows["digest"].to_numpy()[found[:, 0]]} | named)

    return distinct.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(located, "key long, digest binary, o long, n long, fk long, fx long, fs long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """``(k, x, runs)``: for each document with one, runs of windows whose words also start earlier; ``docs`` is _keyed.

    A run is one long: its first window times 2^16, and how many windows it has (never more than a window has
    phrases). Runs may overlap.
    """
    spark = docs.sparkSession
    found = materialise(_found_anchors(docs, window, phrase))
    counts = found.groupBy("hash").agg(F.sum("n").alias("c")).where("c > 1").select("hash", (F.col("c") > hot).alias("is_hot"))
    mine = materialise(found.join(counts, "hash").groupBy("k", "x").agg(F.collect_set("hash").alias("again"), F.collect_set(F.when(F.col("is_hot"), F.col("hash"))).alias("hot")))
    drop(found)
    free_shuffles(spark)
    segments = materialise(_segments(docs.join(mine, ["k", "x"]), window, phrase))
    drop(mine)
    free_shuffles(spark)
    distinct = segments.groupBy("key", "digest").agg(F.min(F.struct("k", "x", "start")).alias("at"), F.count(F.lit(1)).alias("times"), F.first("words", ignorenulls=True).alias("words"))
    distinct = materialise(distinct.select("key", "digest", "words", "times", "at.k", "at.x", "at.start"))
    shards = max(1, -(-distinct.count() // shard))
    runs = materialise(_runs(distinct, shards, window))
    drop(distinct)
    at = F.col("start") + F.col("o")
    later = segments.select("key", "digest", "k", "x", "start").join(runs, ["key", "digest"]).where((F.col("k") != F.col("fk")) | (F.col("x") != F.col("fx")) | (at != F.col("fs")))
    out = materialise(later.select("k", "x", (F.shiftleft(at, 16) + F.col("n")).alias("run")).groupBy("k", "x").agg(F.collect_list("run").alias("runs")))
    drop(segments)
    drop(runs)
    free_shuffles(spark)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """Return ``(id, n_words, n_removed, kept)`` for every row of ``docs``: kept is the bytes of the words that stay, joined by one space.

    Words are runs without ASCII white space. A word goes if a window over it also starts earlier: in a
    document with a smaller id, or earlier in the same one. Null text has no words. Documents with a null id
    come after all others. Rows that repeat an id with another text are ordered by a hash of the text; rows
    that repeat id and text are one document, and each has its result. Other columns are not read. An empty
    table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    keyed, once = _keyed(docs, id_col, text_col)
    marks = repeated_windows(once, window, phrase, hot, shard)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().split()
                kept = words
                if runs.is_valid:
                    run = runs.values.to_numpy()
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, run >> 16, 1)
                    np.add.at(change, (run >> 16) + (run & 0xFFFF) + (window - 1), -1)
                    kept = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    return keyed.join(marks, ["k", "x"], "left").select("id", "t", "runs").mapInArrow(cut, "id long, n_words long, n_removed long, kept binary")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: words, removed words and digest of the kept words of every document."""
    from .common import table

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

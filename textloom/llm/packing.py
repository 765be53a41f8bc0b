"""Packing of tokenised documents into fixed-size training sequences.

Large items (over a third of a sequence) go at most two to a sequence, matched greedily from the largest
down; smaller items then best-fit the remaining gaps.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, materialise

SIZE, END = 2048, 0
#: Items packed together in one task; a group leaves a few gaps open at its end, whatever its size.
GROUP = 1 << 15
#: How byte-level vocabularies of this kind cut a text into words; a fixed value.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokeniser:
    """Ids of whole texts by a byte-level ``tokenizers`` file, as little-endian unsigned 32-bit integers.

    Texts of Latin-1 characters without an added token's string go through tiktoken with the vocabulary of the
    same file, which gives the same ids in a third of the time (a test compares them over Latin-1); all other
    texts go through the library, as its character classes may be of another Unicode version.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Byte-level vocabularies write bytes as characters: printable ones as themselves, others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in token): k for token, k in self.library.get_vocab(with_added_tokens=False).items() if token not in self.added}
        self.fast = tiktoken.Encoding("same", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if _latin(text) and not any(a in text for a in self.added):
            ids = array("I", self.fast.encode_ordinary(text))
        else:
            ids = array("I", self.library.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """Return ``(id, piece, start, length, ids)``: each document's ids and ``end``, cut into pieces of ``size``.

    Only a document of more than ``size`` ids is cut; its first piece takes the remainder, the others are
    full. Null text counts as empty and has the end id alone. ids is binary, little-endian unsigned 32 bits.
    Every row is a document of its own, repeated ones too; null ids stay null. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    stop = np.array([end], "<u4").tobytes()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokeniser(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.encode(text.as_py()) + stop
                n = len(ids) // 4
                at = [0, *range(n % size or size, n, size)] if n > size else [0]
                out += [(key, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(mapped, "id long, piece int, start long, length long, ids binary")


def pack(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; lengths are from 1 to ``size``. Ties go by position."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    large = [k for k in order if 3 * lengths[k] > size]
    small = order[len(large) :]
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    sizes = 0  # bit s: a large item of length s waits
    for k in reversed(large):
        waiting[lengths[k]].append(k)
        sizes |= 1 << lengths[k]
    gaps: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = made = 0  # bit g of open_: a bin has a gap of g

    def take(s: int) -> int:
        nonlocal sizes
        k = waiting[s].pop()
        if not waiting[s]:
            sizes &= ~(1 << s)
        return k

    while sizes:
        s = sizes.bit_length() - 1
        k = take(s)
        gap = size - s
        bins[k] = made
        if fits := sizes & ((1 << (gap + 1)) - 1):
            m = fits.bit_length() - 1
            j = take(m)
            bins[j], offsets[j] = made, s
            gap -= m
        gaps[gap].append(made)
        open_ |= 1 << gap
        made += 1
    for k in small:
        s = lengths[k]
        if fits := open_ >> s:
            gap = s + (fits & -fits).bit_length() - 1
            home = gaps[gap].pop()
            if not gaps[gap]:
                open_ &= ~(1 << gap)
        else:
            gap, home, made = size, made, made + 1
        bins[k], offsets[k] = home, size - gap
        gaps[gap - s].append(home)
        open_ |= 1 << (gap - s)
    return bins, offsets


def place(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset added; reads id, piece and length, and carries the other columns.

    Pieces are dealt to groups of about ``group`` items, so tasks stay bounded at any input and a group's
    unfilled last sequences are a fixed small share. They are dealt by a hash of their place among the rows,
    so repeated and null ids spread like others; ``pieces`` is read from files, where a row's place is fixed.
    Equal rows are packed as separate items.
    """
    column = fresh(pieces, "group")
    n = pieces.count()
    groups = max(1, -(-n // group))
    dealt = pieces.withColumn(column, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("piece", "ascending")])).drop_columns([column])
        bins, offsets = pack(rows.column("length").to_pylist(), size)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + np.array(bins, np.int64))).append_column("offset", pa.array(np.array(offsets, np.int64)))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(column).applyInArrow(packed, f"{kept}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Return ``(sequence_id, n_tokens, ids)``: the ids of each sequence, for training."""
    pieces = materialise(token_pieces(docs, tokenizer, id_col, text_col, size))
    at = place(pieces.select("id", "piece", "start", "length"), size)
    ids = at.join(pieces.select("id", "piece", "start", "ids"), ["id", "piece", "start"])
    # A sequence holds `size` ids at most, so a group is small.
    return ids.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["ids"]).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's rows for ``documents``-shaped ``docs``: a row for each piece with its place and digest."""
    pieces = token_pieces(docs, tokenizer)
    found = materialise(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return place(found).withColumnRenamed("id", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, where the driver has it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of 2048 tokens."""
    from .common import table

    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))

"""SentencePiece encoding and decoding through a table of the corpus's distinct chunks.

No piece of the model has the white space marker after another character, so a merge never crosses from a
word into the next marker. A text may be cut before every marker that follows another character (a chunk is a
run of markers and the word behind it). Rows are dealt to blocks of about 16 MB in the order they are read. A
block sends each of its distinct chunks once to the shard that the chunk's hash belongs to; a shard is a part
of the corpus's table of distinct chunks: it segments each of them once, and answers every block that has it.
Answers are joined to their block, and ids are put back by the chunks' positions in each text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

MARK = "▁"
#: Bytes of text in a block; there are as many shards as blocks.
BLOCK = 16 << 20
#: Between chunks in a list: no chunk holds a space behind another character.
BETWEEN = "| "


class Codec:
    """Encode and decode as the library does for ``path``, with an end id and without sampling."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        # The model must also leave texts as they are but for a marker for each space and one in front.
        probe = "  Aé  ﬁ　\n\tx́ ① "
        plain = self.library.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.chunked = plain and not crossing

    def chunks(self, text: str) -> list[str]:
        """The texts whose segments, one after the other, are those of ``text``: the whole text where the model allows no cut."""
        return _chunks(text) if self.chunked else [text] if text else []

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk, as 32-bit integers."""
        found = dict(zip(chunks, (array("i", ids).tobytes() for ids in self.library.encode(chunks, num_threads=1)), strict=True))
        if "" in found:  # a marker that no word follows
            found[""] = array("i", [self.library.piece_to_id(MARK)]).tobytes()
        return found

    def encode_batch(self, texts: list[str]) -> list[array]:
        """Ids of each text and the end id."""
        cut = [self.chunks(t) for t in texts]
        return self.put_back(cut, self.segment(list(set().union(*cut))))

    def put_back(self, cut: list[list[str]], table: dict[str, bytes]) -> list[array]:
        """Ids of texts from their chunks in order and the table of chunks, with the end id behind each."""
        end, get = array("i", [self.end]).tobytes(), table.__getitem__
        return [array("i", b"".join(map(get, c)) + end) for c in cut]

    def decode(self, ids: array) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(1)
def _codec(path: str) -> Codec:
    return Codec(path)


_CUT = re.compile(r"(?<=[^ ▁])[ ▁]")


def _chunks(text: str) -> list[str]:
    """The texts whose encodings, one after the other, are the encoding of ``text``.

    The library puts a marker in front of each, which stands for the chunk's first space.
    """
    if not text:
        return []
    return _CUT.split(text) if MARK in text or "  " in text or text[0] == " " else text.split(" ")


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list, list[str]]]:
    """Number, ids and texts of each block: rows of a partition in order, up to ``block_bytes`` or one row."""
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(t) > block_bytes:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield number, ids, texts


def _dealt(chunks: set[str], shards: int) -> dict[int, list[str]]:
    """Chunks in order, by shard; shards without any are not there, so the work is the chunks', however many shards there are."""
    out: dict[int, list[str]] = {}
    for c in sorted(chunks):
        out.setdefault(zlib.crc32(c.encode()) % shards, []).append(c)
    return out


def _digest(chunks: str) -> str:
    return xxhash.xxh64_hexdigest(chunks.encode())


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, missed=None) -> DataFrame:
    """Return ``(id, ids, decoded)`` for every row: ids is an array with the end id last, decoded the text of the ids.

    Null text counts as empty and has the end id alone. Every row is encoded whole and alone, so repeated
    rows and ids give repeated results; null ids stay null. Other columns are not read. Blocks are cut by place,
    never by a key, so no key is hot; should ``docs`` be dealt otherwise when it is read again, a chunk that its
    block has no answer for is segmented in place, and the result is the same; ``missed``, an accumulator,
    counts such chunks.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-size // block_bytes))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for block, _, texts in _blocks(batches, block_bytes):
            chunks = set()
            for t in texts:
                chunks.update(codec.chunks(t))
            for shard, part in _dealt(chunks, shards).items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([BETWEEN.join(part)], pa.string())], names=["block", "shard", "chunks"])

    def answered(part: pa.Table) -> pa.Table:
        lists = [x.as_py() for x in part["chunks"]]
        table = _codec(model).segment(list(set().union(*(x.split(BETWEEN) for x in lists))))
        pack = zstandard.ZstdCompressor(1).compress
        ids, sizes = [], []
        for x in lists:
            found = [table[c] for c in x.split(BETWEEN)]
            ids.append(pack(b"".join(found)))
            sizes.append(pack(array("i", map(len, found)).tobytes()))
        return pa.table({"block": part["block"], "shard": part["shard"], "digest": pa.array(map(_digest, lists), pa.string()), "ids": pa.array(ids, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for block, ids, texts in _blocks(batches, block_bytes):
            raw = [t.encode() for t in texts]
            sizes = pa.array([[len(r) for r in raw]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), sizes, pa.array([pack(b"".join(raw))], pa.binary())], names=["block", "id", "sizes", "texts"])

    def put_back(mine: pa.Table, answers: pa.Table) -> pa.Table:
        codec, unpack = _codec(model), zstandard.ZstdDecompressor().decompress
        ids, texts, chunks = [], [], set()
        for row in mine.to_pylist():
            ids += row["id"]
            texts += map(bytes.decode, _slices(unpack(row["texts"]), row["sizes"]))
        for t in texts:
            chunks.update(codec.chunks(t))
        parts = _dealt(chunks, shards)
        table = {}
        for a in answers.to_pylist():
            part = parts.get(a["shard"], [])
            if a["digest"] == _digest(BETWEEN.join(part)):
                table.update(zip(part, _slices(unpack(a["ids"]), array("i", unpack(a["sizes"]))), strict=True))
        lacking = list(chunks - table.keys())
        table.update(codec.segment(lacking))
        if missed is not None:
            missed.add(len(lacking))
        # A text's chunks are cut again in place of keeping all of a block's, which take ten times its bytes.
        found = [codec.put_back([codec.chunks(t)], table)[0] for t in texts]
        offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
        flat = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(found))])
        return pa.table({"id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, flat), "decoded": pa.array(map(codec.decode, found), pa.string())})

    asking = rows.mapInArrow(asked, "block long, shard int, chunks string")
    answers = asking.groupBy("shard").applyInArrow(answered, "block long, shard int, digest string, ids binary, sizes binary")
    texts = rows.mapInArrow(packed, "block long, id array<long>, sizes array<int>, texts binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_back, "id long, ids array<int>, decoded string")


def _slices(whole: bytes, sizes) -> Iterator[bytes]:
    at = 0
    for n in sizes:
        yield whole[at : at + n]
        at += n


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Contract query: count and digests of every document's ids and decoded text."""
    from .common import table
    from .packing import tokenizer_path

    found = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

import random

import pytest

from textloom.llm.packing import tokenizer_path
from textloom.llm.sentencepiece_codec import Codec, encode_documents

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL)


def test_ids_and_texts_equal_the_library(codec):
    assert codec.chunked
    rng = random.Random(1)
    parts = [" ", " ", "  ", "▁", "\n", "a", "the", "é", "漢", "\t", "\xa0", "fi", "<s>", "</s>", "<0x0A>", "😀", "​", "x́", "ﬁ", "１", "\x00"]
    texts = ["", " ", "  ", "▁", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(8000))]
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids.tolist() == [*codec.library.encode(text), 2], repr(text)
        assert codec.decode(ids) == codec.library.decode(codec.library.encode(text))


def test_chunks_come_back_over_many_blocks_and_shards(spark, codec):
    rng = random.Random(2)
    parts = ["|", "| ", " ", "  ", "▁", "a", "b|", "the", "é", "漢字", "\n", "\x00", "x" * 40]
    texts = ["", None, *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)), *["| a |  b"] * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {k: [*codec.library.encode(t or ""), 2] for k, t in enumerate(texts)}
    for size in (700, 1 << 20):
        missed = spark.sparkContext.accumulator(0)
        got = encode_documents(docs, MODEL, block_bytes=size, missed=missed).collect()
        assert {r["id"]: list(r["ids"]) for r in got} == want and len(got) == len(texts)
        assert missed.value == 0  # all chunks come from the table


def test_whole_documents_round_trip(spark, codec):
    rows = [(1, None, 1), (1, "", 1), (2, "Été  à la\nplage ", 1), (None, "w " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["id"] or 0, list(r["ids"]), r["decoded"]) for r in encode_documents(docs, MODEL).collect())
    want = sorted((k or 0, [*codec.library.encode(t or ""), 2], t or "") for k, t, _ in rows)
    assert got == want
    assert encode_documents(docs.limit(0), MODEL).count() == 0

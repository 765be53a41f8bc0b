import random
import zlib

import numpy as np
import pytest

from textloom.llm.packing import Tokeniser, pack, packed_documents, packed_sequences, place, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokeniser():
    return Tokeniser(PATH)


def library(tokeniser, text):
    return tokeniser.library.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(tokeniser):
    rng = random.Random(1)
    latin = [chr(k) for k in range(256)]
    odd = [" ", " ", "\n", "a", "1", "'s", "'LL", "é", "\t", "\xa0", "!", "œ", "漢", "<|endoftext|>", "　"]
    for k in range(6000):
        text = "".join(rng.choice(latin if k % 2 else odd) for _ in range(rng.randrange(14)))
        assert np.frombuffer(tokeniser.encode(text), "<u4").tolist() == library(tokeniser, text), repr(text)
    for c in latin:
        for text in (c, f"a{c}b", f" {c} {c}", f"{c}1{c}"):
            assert np.frombuffer(tokeniser.encode(text), "<u4").tolist() == library(tokeniser, text)


def test_one_id_for_all_rows_and_clashing_names(spark, monkeypatch):
    """Rows with one id or none are spread over the groups, and a column of the caller's stays."""
    pieces = spark.createDataFrame([(None, 0, 0, 7, k) for k in range(4000)], "id long, piece int, start long, length long, `group` int")
    got = place(pieces, 16, 500).collect()
    assert sorted(r["group"] for r in got) == list(range(4000))
    groups = [r["sequence_id"] >> 32 for r in got]
    assert len(set(groups)) == 8 and max(groups.count(g) for g in set(groups)) < 700
    assert len({r["sequence_id"] for r in got}) <= 2000 + 8


def test_a_null_id_leaves_large_ids_exact(spark):
    ids = [None, 2**53 + 1, 2**53 + 3, 2**63 - 1, None, -(2**63), 5]
    got = place(spark.createDataFrame([(i, 0, 0, 7) for i in ids], "id long, piece int, start long, length long"), 16).collect()
    assert sorted((r["id"] for r in got), key=str) == sorted(ids, key=str)
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in packed_documents(docs, PATH).collect()), key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_pack_fits_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    lengths = [min(2048, int(rng.expovariate(1 / 700)) + 1) for _ in range(3000)]
    bins, offsets = pack(lengths)
    inside = {}
    for n, b, o in zip(lengths, bins, offsets):
        inside.setdefault(b, []).append((o, n))
    for parts in inside.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(inside) <= 1.02 * max(sum(lengths) / 2048, sum(2 * n > 2048 for n in lengths)) + 1


def test_large_items_are_matched_as_well_as_can_be():
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.randrange(8, 21) for _ in range(rng.randrange(1, 9))]  # all over a third of 20, and up to full
        n = len(lengths)

        def best(mask):
            if not mask:
                return 0
            k = (mask & -mask).bit_length() - 1
            rest = mask & ~(1 << k)
            return 1 + min([best(rest)] + [best(rest & ~(1 << j)) for j in range(n) if rest >> j & 1 and lengths[j] + lengths[k] <= 20])

        assert max(pack(lengths, 20)[0]) + 1 == best((1 << n) - 1)


def test_packed_documents(spark, tokeniser):
    rng = random.Random(4)
    texts = [None, "", "a b", "a b", *(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(3000))) for _ in range(12))]
    docs = spark.createDataFrame([(k // 2, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, piece string, length int")
    got = packed_documents(docs, PATH).collect()
    want = []
    for k, t in enumerate(texts):
        ids = [*library(tokeniser, t or ""), 0]
        at = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)] if len(ids) > 2048 else [0]
        want += [(k // 2, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(at, [*at[1:], len(ids)]))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, o, n), (s2, o2, _) in zip(places, [*places[1:], (None, 0, 0)]):
        assert o + n <= 2048 and (o2 == o + n if s == s2 else o2 == 0)
    assert sum(r["n_tokens"] for r in packed_sequences(docs.dropDuplicates(["doc_id"]), PATH).collect()) > 0
    assert packed_documents(docs.limit(0), PATH).count() == 0

import random

import numpy as np
import pytest
import xxhash

from textloom.llm.components import components
from textloom.llm.exact_dedup import exact_groups, misra_gries
from textloom.llm.simhash_dedup import hamming_links, near_groups, simhash
from textloom.llm.trie_join import trie_links


def union_find(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_trie_links_match_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 5), dtype=np.uint64), axis=1)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 700, dtype=np.uint64), rng.choice(centres, 600) ^ flips]))
    side = rng.random(len(values)) < 0.5
    both = np.concatenate([values[side], values[~side]])
    near = np.bitwise_count(both[:, None] ^ both[None, :]) <= 4
    n = int(side.sum())
    assert trie_links(values, None, 4).tolist() == union_find(len(values), np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4).tolist())
    cross = [(i, j) for i, j in np.argwhere(near).tolist() if i < n <= j]
    within = [(i, j) for i, j in np.argwhere(near).tolist() if (i < n) == (j < n)]
    got = trie_links(values[side], values[~side], 4)
    # Links between the sides, plus those inside a side found by their own self-joins, give the whole relation.
    assert union_find(len(both), [*within, *((i, int(x)) for i, x in enumerate(got))]) == union_find(len(both), cross + within)


def test_simhash_is_the_majority_of_shingle_hashes():
    def plain(text):
        words = text.lower().split() if text.isascii() else text.encode().lower().split()
        words = [w if isinstance(w, bytes) else w.encode() for w in words]
        grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))

    for text in ("", " \t", "One", "one two three", "A b c d", "É a Ä b c d e " * 50, "same " * 40):
        assert simhash(text.encode()) == plain(text)


def test_near_groups_match_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(30)]
    texts = [*base, *(b + " tail" for b in base[:12]), *base[:5], None, "", " \n", "x y", "X  Y"]
    rows = [(i * 3 - 7, t, "noise") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r["id"]: (r["fp"] & (2**64 - 1), r["component"]) for r in near_groups(docs).collect()}
    fps = [simhash((t or "").encode()) for t in texts]
    roots = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert got == {r[0]: (fps[i], rows[roots[i]][0]) for i, r in enumerate(rows)}


def test_near_groups_of_an_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 40)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (1001, 1000), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}


def test_misra_gries_keeps_what_is_frequent():
    import pyarrow as pa

    rng = random.Random(1)
    keys = [b"hot"] * 400 + [b"warm"] * 200 + [rng.randbytes(4) for _ in range(900)]
    rng.shuffle(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100])], names=["k"]) for k in range(0, len(keys), 100)]
    held = misra_gries(iter(batches), 10)
    assert len(held) <= 10 and 400 - 1500 / 11 <= held[b"hot"] <= 400 and b"warm" in held


def test_exact_groups_with_ties_nulls_and_repeats(spark):
    rows = [(1, "a b", 0), (2, "ab", 0), (3, " a b ", 0), (4, " a b\t", 0), (5, None, 0), (6, "", 0), (7, " ", 0), (8, "é", 0), (8, "é", 0), (9, "A b", 0), (None, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    for counters in (1, 256):
        got = sorted(((r["id"] or 0), r["keep_id"], r["group_size"]) for r in exact_groups(docs, counters=counters).collect())
        assert got == [(0, None, 1), (1, 3, 4), (2, 3, 4), (3, 3, 4), (4, 3, 4), (5, 7, 3), (6, 7, 3), (7, 7, 3), (8, 8, 2), (8, 8, 2), (9, 9, 1)]
    assert exact_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [4, 1 << 20])
def test_units_of_any_size_link_alike(spark, unit):
    """Hamming links over many small units and over few, against all pairs."""
    rng = random.Random(unit)
    base = [rng.getrandbits(64) for _ in range(40)] + [rng.getrandbits(8) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(3):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for n, a in enumerate(values):
        for b in values[:n]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    mine = {v: v for v in values}

    def found(v):
        while mine[v] != v:
            v = mine[v]
        return v

    for r in hamming_links(fps, 4, unit).collect():
        mine[found(r["a"] % 2**64)] = found(r["b"] % 2**64)
    group = lambda of: sorted(tuple(v for v in values if of(v) == r) for r in {of(v) for v in values})
    assert group(found) == group(root)


def test_simhash_of_a_very_long_text():
    words = [f"w{k % 977}" for k in range(120_000)]
    assert simhash(" ".join(words).encode()) == simhash("  ".join(words).upper().encode())

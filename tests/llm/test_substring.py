import random

import numpy as np
import pytest

from textloom.llm.substring_dedup import _leftmost_least, _poly, locate, remove_repeats


def brute(rows, window):
    """Results by trying all windows in order of (id, hash of the text is not needed: ids differ, start)."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno")
    passages = [[word() for _ in range(rng.choice([7, 19, 20, 21, 40, 90]))] for _ in range(12)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(40))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return [*texts, *texts[:8], "same " * 70, "é " * 25 + "x", "é " * 25 + "y", None, ""]


@pytest.mark.parametrize(("seed", "hot", "shard"), [(0, 1000, 4000), (1, 2, 10)])
def test_removal_matches_all_windows(spark, seed, hot, shard):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(-50, 500), len(texts))
    rows = [(i, t, "clash") for i, t in zip(ids, texts)] + [(None, texts[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {r["id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in remove_repeats(docs, hot=hot, shard=shard).collect()}
    assert got == brute([r[:2] for r in rows], 20)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["id"], r["n_removed"]) for r in remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 30)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_locate_is_exact_when_hashes_clash(monkeypatch):
    monkeypatch.setattr("textloom.llm.substring_dedup._poly", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    segments = [[b"a", b"b", b"c", b"d"], [b"x", b"b", b"c", b"d"], [b"q", b"r", b"s"]]
    got = locate(segments, [1, 1, 1], [(5, 0, 10), (3, 0, 2), (1, 0, 0)], window=3)
    assert got == [{1: (3, 0, 3)}, {1: (3, 0, 3)}, {}]


def test_a_very_long_text_is_read_to_its_end(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"{rng.randrange(10**9)}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, f"x {passage} y"), (3, long)], "doc_id long, text string")
    assert sorted((r["id"], r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()) == [(1, 150_060, 0), (2, 62, 60), (3, 150_000, 150_000)]


@pytest.mark.parametrize("characters", [0, 10**6])
def test_locate_matches_comparing_all_windows(monkeypatch, characters):
    monkeypatch.setattr("textloom.llm.substring_dedup._CHARACTERS", characters)
    rng = random.Random(8)
    for _ in range(60):
        base = [[rng.choice("abcd").encode() for _ in range(14)] for _ in range(3)]
        segments = []
        for _ in range(rng.randrange(1, 9)):
            b = rng.choice(base)
            a = rng.randrange(4)
            segments.append(b[a : a + rng.randrange(4, 11)] + [rng.choice("xyz").encode() for _ in range(rng.randrange(3))])
        times = [rng.choice([1, 1, 2]) for _ in segments]
        firsts = [(rng.randrange(9), 0, rng.randrange(50)) for _ in segments]
        where = {}
        for words, n, (k, x, s) in zip(segments, times, firsts):
            for o in range(len(words) - 3):
                where.setdefault(tuple(words[o : o + 4]), []).extend([(k, x, s + o)] * n)
        want = [{o: min(where[tuple(w[o : o + 4])]) for o in range(len(w) - 3) if len(where[tuple(w[o : o + 4])]) > 1} for w in segments]
        assert locate(segments, times, firsts, window=4) == want


def test_hashes_and_minima():
    h = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    for n in (1, 3, 8, 20):
        got = _poly(h, n)
        want = [sum(int(x) * pow(0x9E3779B97F4A7C15, j, 2**64) for j, x in enumerate(h[k : k + n])) % 2**64 for k in range(200 - n + 1)]
        assert got.tolist() == want
    g = np.array([3, 1, 1, 2, 0, 5, 0, 0, 9, 9, 9, 1], np.uint64)
    for w in (1, 2, 5, 7, 12):
        assert _leftmost_least(g, w).tolist() == [k + int(np.argmin(g[k : k + w])) for k in range(len(g) - w + 1)]

import math
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm.lm_scoring import _cuts, score_documents


def brute(texts, order, alpha=0.4):
    words = [(t or "").split() for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    own = [Counter(g for n in range(1, order + 1) for g in grams(w, n)) for w in words]
    every = sum(own, Counter())
    total = sum(map(len, words))
    out = []
    for w, mine in zip(words, own):
        c = lambda g: every[g] - mine[g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    score += math.log(factor * c(g) / c(g[:-1]))
                    break
                factor *= alpha
            else:
                score += math.log(factor * (c((w[i],)) or alpha) / max(1, total - len(w)))
        out.append((len(w), score))
    return out


@pytest.mark.parametrize(("order", "block", "shard"), [(2, 8 << 20, 3_000_000), (3, 900, 40), (1, 900, 40)])
def test_scores_match_counting(spark, order, block, shard):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(30))) for _ in range(60)]
    texts += [None, "", " \n", "lone", "é à é à", texts[0], "the " * 3000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, block string")
    got = {r["id"]: (r["n_words"], r["log_score"]) for r in score_documents(docs, order=order, block_bytes=block, shard_size=shard).collect()}
    for k, (n, score) in enumerate(brute(texts, order)):
        assert got[k][0] == n and got[k][1] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert len(score_documents(docs).collect()) == 3
    assert score_documents(docs.limit(0)).count() == 0
    assert score_documents(docs.where("doc_id IS NULL")).first()["log_score"] == pytest.approx(math.log(0.4) + 2 * math.log(0.4))


def test_shards_are_ranges_of_the_hash():
    rng = np.random.default_rng(1)
    for shards in (1, 2, 7, 1000, 2**30):
        grams = np.unique(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64, endpoint=True))
        want = {0: []}
        for x in grams.tolist():
            want.setdefault(x * shards >> 64, []).append(x)
        to, begin, end = _cuts(grams, shards)
        assert {int(t): grams[a:b].tolist() for t, a, b in zip(to, begin, end)} == want
    assert [x.tolist() for x in _cuts(np.zeros(0, np.uint64), 5)] == [[0], [0], [0]]

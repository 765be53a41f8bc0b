import numpy as np
import pytest

from textloom.llm.embedding_dedup import near_vectors, rotated


def brute(rows, cosine, dtype=np.float32):
    usable = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for n, a in enumerate(usable):
        for b in usable[:n]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype).astype(float) for k in (a, b))
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    least = {}
    for k in usable:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((r[0] if r[0] is not None else -99), links[k], least[root(k)] if k in usable else r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize("chunk", [7, 8192])
@pytest.mark.parametrize("dims", [64, 5])
def test_links_and_components_match_all_pairs(spark, chunk, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    near = base[rng.integers(0, 12, 120)] + rng.normal(scale=0.08, size=(120, dims))
    all_ = np.concatenate([base, near, near[:15], 3 * near[:5]]).astype(np.float32)
    ids = rng.permutation(len(all_))
    rows = [(int(i), [float(x) for x in v], int(k % 2)) for k, (i, v) in enumerate(zip(ids, all_))]
    rows += [(900, None, 0), (901, [0.0] * dims, 0), (902, [None] * dims, 0), (903, [float("nan")] * dims, 0), (904, [float("inf")] + [1.0] * (dims - 1), 0), (905, rows[0][1], None), (None, rows[0][1], 0), (906, [], 0), (907, [1.0], 0), (908, [2.0], 0), (909, [-2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS w")
    got = sorted((r["id"] if r["id"] is not None else -99, r["n_links"], r["component"]) for r in near_vectors(df, chunk=chunk).collect())
    assert got == brute(rows, 0.98)


def test_doubles_are_compared_as_they_are(spark):
    """Near the threshold, closer than 32-bit floats tell apart, and of sizes whose squares are no doubles."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        v = rng.normal(size=16)
        u = rng.normal(size=16)
        u -= (u @ v) / (v @ v) * v
        c = 0.98 + (1 if k % 2 else -1) * 1e-10
        w = c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * u / np.linalg.norm(u)
        rows += [(2 * k, [float(x) for x in v * 10.0 ** (k % 5 * 75 - 150)], k % 3), (2 * k + 1, [float(x) for x in w], k % 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["id"], r["n_links"], r["component"]) for r in near_vectors(df).collect())
    assert got == brute(rows, 0.98, float) and sum(n for _, n, _ in got) == 60


def test_rows_that_repeat_an_id_have_links_of_their_own(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    near = base[rng.integers(0, 12, 60)] + rng.normal(scale=0.05, size=(60, 8))
    rows = [(int(rng.integers(0, 9)), [float(x) for x in v.astype(np.float32)], int(k % 2)) for k, v in enumerate(np.concatenate([near, near[:20]]))]
    rows += [(1, [1.0] * 8, 5), (1, [-1.0] * 8, 5), (2, [1.0] * 8, 5), (1, [2.0] * 8, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["id"], r["n_links"], r["component"]) for r in near_vectors(df).collect())
    assert got == brute(rows, 0.98)
    assert [x for x in got if x[0] == 2 and x[1] == 1]


def test_a_very_long_vector(spark):
    v = np.random.default_rng(4).normal(size=20_000)
    rows = [(1, [float(x) for x in v], 0), (2, [float(x) for x in v * 2 + 0.01], 0), (3, [float(x) for x in -v], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r["id"], r["n_links"], r["component"]) for r in near_vectors(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rotation_keeps_lengths_and_ignores_the_batch():
    v = np.random.default_rng(0).normal(size=(50, 48)).astype(np.float32)
    whole = rotated(v)
    assert np.allclose((whole**2).sum(1), 1) and (rotated(v[7:8]) == whole[7:8]).all()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    assert np.allclose(whole @ whole.T, u @ u.T)

import numpy as np

from textloom.llm.common import materialise
from textloom.llm.quality import N_META, N_TEXT, _matrix, co_train, co_train_with, features, fit, keep_quality, lesson, logistic, pool_lessons, score_quality, stepped, summed_lessons


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(0)

    def draw(n):
        y = (rng.random(n) < 0.6).astype(float)
        return rng.normal(y[:, None] * 2.5, 1, (n, 3)), rng.normal(y[:, None] * 1.5, 1, (n, 2)), y

    a, b, y = draw(120)
    pa, pb, _ = draw(2000)
    model = co_train(a, b, y, np.arange(120) % 4 == 3, pa, pb)
    ta, tb, ty = draw(3000)
    p = model.scores(ta, tb)
    right = ((p >= 0.5) == (ty[:, None] > 0)).mean(0)
    assert right[0] > 0.95 and right[1] > 0.8 and right[2] >= right[0] - 0.02
    assert abs(p[:, 2].mean() - ty.mean()) < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    other = labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    rows = score_quality(docs, half).join(other, "doc_id").select("kept", "quality").collect()
    low = [r for r in rows if r["quality"] == 0]
    high = [r for r in rows if r["quality"] == 1]
    assert np.mean([not r["kept"] for r in low]) > 0.85 and np.mean([r["kept"] for r in high]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0.5), (1, "", "en", "s", 0, 0.5), (None, "a " * 40_000, "en", "s", -4, 0.5)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in score_quality(docs, labels).collect()] == [1.0] * 3
    assert [r["kept"] for r in score_quality(docs, labels.limit(0)).collect()] == [True] * 3
    assert score_quality(docs.limit(0), labels).count() == 0


def test_one_round_equals_brute_force(spark, monkeypatch):
    """The summed lessons of a round, and the step they lead to, against all rows in one place, row by row."""
    monkeypatch.setattr("textloom.llm.quality._FAN_IN", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = materialise(features(docs)).repartition(7)
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect()}
    mine = sorted((r["id"], bytes(r["a"]), bytes(r["b"])) for r in rows.collect())
    has = np.array([k in known for k, *_ in mine])
    a, b = _matrix([x for _, x, _ in mine], N_TEXT), _matrix([x for _, _, x in mine], N_META)
    y = np.array([known[k] for k, *_ in mine if k in known])
    views = [logistic(x[has], y) for x in (a, b)]
    pool = [(x, z) for x, z, h in zip(a, b, has) if not h]
    want = [np.zeros((2, 1 + (n + 1) + (n + 1) ** 2)) for n in (N_TEXT, N_META)]
    prior = 0.4
    for x, z in pool:
        odds = [np.exp(v.logit(q[None])[0] - prior) for v, q in zip(views, (x, z))]
        for k, side in ((0, x), (1, z)):
            if max(odds[1 - k], 1 / odds[1 - k]) >= 19:
                y_ = int(odds[1 - k] > 1)
                want[k][y_] += lesson(views[k], side[None], np.array([float(y_)]))
    want = [w.ravel() for w in want]
    chosen = spark.createDataFrame([(k,) for k in known], "id long")
    got = summed_lessons(rows.join(chosen, "id", "left_anti"), views, prior)
    assert len(pool) > 50 and sum(w.any() for w in want) > 0
    for g, w in zip(got, want):
        np.testing.assert_allclose(g, w, rtol=1e-7, atol=1e-7)
    whole = fit(rows, labels, rounds=1)
    order = [k for k, *_ in mine if k in known]
    import zlib

    place = np.argsort([(zlib.crc32(str(k).encode()) << 40) + k for k in order])
    held = np.zeros(len(order), bool)
    held[place[3::4]] = True
    local = co_train_with(a[has], b[has], y, held, lambda v, prior: pool_lessons(v, prior, a[~has], b[~has]), 1)
    for g, w in zip(whole.views, local.views):
        np.testing.assert_allclose(g.weights, w.weights, rtol=1e-5, atol=1e-6)


def test_ties_and_steps_that_teach_nothing():
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    view = logistic(x, np.array([0.0, 1.0, 0.0, 1.0]))
    assert np.allclose(view.logit(x), 0, atol=1e-6)
    assert np.allclose(stepped(view, lesson(view, x, np.array([0.0, 1.0, 0.0, 1.0]))).weights, view.weights, atol=1e-6)
    assert not pool_lessons([view, view], 0.0, x, x)[0].any()


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "x", "y", "z")], "doc_id long, text string, lang string, source string, n_chars long, scores string, scores_ string, wanted string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [tuple(r) for r in docs.collect()]


def test_a_view_that_sees_nothing_teaches_nothing():
    """With mostly good rows and metadata that tell nothing, rounds leave the text view as good as it was."""
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.87).astype(float)
    text, noise = rng.normal(y[:, None] * 2.5, 1, (4000, 4)), rng.normal(size=(4000, 6))
    known = np.arange(4000) < 800
    held = (np.arange(4000) % 4 == 3)[known]
    low = [((m := co_train(text[known], noise[known], y[known], held, text[~known], noise[~known], rounds)).scores(text[~known], noise[~known])[:, 2] < 0.5)[y[~known] == 0].mean() for rounds in (0, 5)]
    assert low[1] > 0.8 and low[1] >= low[0] - 0.03


def test_low_quality_is_found_at_scale(spark):
    """On a table of 10,000 documents, labels with even ids against those with odd ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    rows = score_quality(docs, labels.where("doc_id % 2 = 0")).join(known, "doc_id").select("kept", "quality").collect()
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.85 and np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.97

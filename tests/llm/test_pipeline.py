import random
import re

import corpus_pipeline
from textloom.llm.packing import Tokeniser, tokenizer_path
from textloom.llm.quality import score_quality
from textloom.llm.simhash_dedup import simhash


def write(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))


def corpus():
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8))) for _ in range(n)).capitalize() + "."
    good = [prose(rng.randrange(40, 160)) for _ in range(120)]
    bad = [" ".join(w.upper() + rng.choice(["!!", "%%%", "***"]) for w in prose(60).split()) for _ in range(60)]
    good += good[:9] + [t.replace(" ", "\n", 3) for t in good[:4]] + [t + " tail" for t in good[5:12]]
    good += [f"{prose(30)} token = 0123456789abcdef0123456789abcdef {prose(30)}", prose(4000), None, ""]
    docs = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(good + bad)]
    rng.shuffle(docs)
    return docs, [(k, int(k < len(good)), 0) for k, *_ in docs if k % 3]


def test_stages_match_plain_versions(spark, tmp_path):
    docs, labels = corpus()
    write(spark, tmp_path, docs, labels)
    sf, table = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: tuple(r)[1:] for r in df.collect()}

    kept = stages["quality classifier"](spark, table, sf)
    assert kept.columns == table.columns
    want = {r["doc_id"] for r in score_quality(table, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.5").collect()}
    now = rows(kept)
    assert set(now) == want and sum(k < 146 for k in now) >= 140 and sum(k >= 146 for k in now) <= 3

    def plain_exact(found):
        best = {}
        for k in sorted(found):
            text = found[k][0] or ""
            key = re.sub(r"[\x20\x09-\x0D]", "", text)
            if key not in best or len(text) > len(found[best[key]][0] or ""):
                best[key] = k
        return set(best.values())

    exact = stages["exact dedup"](spark, kept, sf)
    assert exact.columns == table.columns and set(rows(exact)) == plain_exact(now)
    now = rows(exact)

    def plain_near(found):
        fps = {k: simhash((v[0] or "").encode()) for k, v in found.items()}
        group = {k: k for k in fps}
        changed = True
        while changed:
            changed = False
            for a in fps:
                for b in fps:
                    if (fps[a] ^ fps[b]).bit_count() <= 4 and group[b] < group[a]:
                        group[a], changed = group[b], True
        return {k for k in fps if group[k] == k}

    near = stages["simhash near-dedup"](spark, exact, sf)
    assert near.columns == table.columns and set(rows(near)) == plain_near(now)
    now = rows(near)

    clean = stages["secret scan"](spark, near, sf)
    after = rows(clean)
    assert clean.columns == table.columns and set(after) == set(now)
    changed = [k for k in now if now[k][0] != after[k][0]]
    assert len(changed) == 1 and "[secret]" in after[changed[0]][0] and "0123456789abcdef" not in after[changed[0]][0]
    assert all(v[3] == (None if v[0] is None else len(v[0])) for v in after.values())

    packed = stages["best-fit packing"](spark, clean, sf).collect()
    tokeniser = Tokeniser(tokenizer_path("byte_bpe_50k.json"))
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {k: len(tokeniser.encode(v[0] or "")) // 4 + 1 for k, v in after.items()}

    places = lambda found: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in found)
    assert places(corpus_pipeline.run(spark, sf).collect()) == places(packed)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_stay(spark):
    """Columns of the caller's that are named as the stages' own."""
    names = ["_kept", "_key", "_of", "n", "row", "place", "rank", "key", "id", "fp", "sha", "digest", "_row"]
    docs = spark.createDataFrame([(k, f"text {k // 2} " + "word " * 30, "en", "s", None, *map(str, range(len(names)))) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in names))
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.secrets):
        found = stage(spark, docs, "")
        assert found.columns == docs.columns
        want = [tuple(r) for r in docs.collect() if stage is corpus_pipeline.secrets or r["doc_id"] % 2 == 0]
        got = sorted(tuple(r) for r in found.collect())
        assert got == want or stage is corpus_pipeline.near and set(got) <= set(want) and got


def test_dedup_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b.replace(" ", "  ")), (3, c), (None, c), (None, d), (None, d), (None, text()), (5, None), (5, ""), (None, "")]
    table = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda stage: sorted(((r["doc_id"], r["text"] or "") for r in stage(spark, table, "").collect()), key=str)
    want = [(1, a), (3, b.replace(" ", "  ")), (3, c), (None, d), (None, rows[9][1]), (5, "")]
    assert kept(corpus_pipeline.exact) == sorted(want, key=str)
    near = kept(corpus_pipeline.near)
    assert [(k, " ".join(t.split())) for k, t in near] == sorted(((k, " ".join(t.split())) for k, t in want), key=str)

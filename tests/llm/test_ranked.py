"""Ranked search against a plain version over term lists."""

import math
import re
from collections import Counter

from textloom.llm.ranked_search import OP13_SQL, op13_ranked_search, ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top=20):
    low = [(d, TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in docs]
    low = [(d, t) for d, t in low if t]
    n_docs, n_all = len(low), sum(len(t) for _, t in low)
    df = Counter(x for _, t in low for x in set(t))
    out = []
    for item, text in items:
        found = []
        for d, t in low:
            tf, score = Counter(t), 0
            for x in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * (75 + 25 * len(t) * n_docs // n_all)))
            if score > 0:
                found.append((-score, d is None, d, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, d, s) for k, (_, _, d, s) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [(1, "Alpha beta, GAMMA"), (2, "alpha ÄRGER ärger"), (3, None), (4, ""), (5, "... \n\t"), (6, "alpha-alpha alpha_alpha al pha"), (7, "beta"), (7, "beta"), (8, "beta"), (None, "gamma gamma beta"), (9, "x" * 50_000 + " gamma " + "word " * 30_000), (10, "\x00gamma\x7fdelta"), (2, "delta delta delta eps")]
ITEMS = [(1, "ALPHA alpha beta"), (1, "gamma"), (2, None), (3, "!!!"), (None, "ärger Ärger delta"), (4, "nowhere"), (5, "word"), (6, "x" * 50_000)]


def test_matches_a_plain_version(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain(DOCS, ITEMS)
    assert rows(ranked_search(docs, items)) == want
    # an automaton of few characters: the items take several scans
    assert rows(ranked_search(docs.repartition(3), items, chars=10)) == want
    assert rows(ranked_search(docs, items, top=2)) == plain(DOCS, ITEMS, 2)


def test_ties_beyond_the_last_rank_go_by_id(spark):
    docs = [(k * 7919 % 1000, f"same text {'more' if k % 3 else 'other'}") for k in range(1000)]
    items = [(1, "text more"), (2, "other"), (3, "same")]
    got = rows(ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain(docs, items)


def test_terms_are_cut_at_ascii_signs_only():
    text = "".join(map(chr, range(128))) + " É ß x 日本"
    assert [t.decode() for t in terms_of(text.encode())] == TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_empty_tables_and_clashing_columns(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full, asked = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(ranked_search(docs, asked)) == rows(ranked_search(full, items)) == []
    clash = full.selectExpr("*", "1 as n", "'x' as terms", "2 as tfs", "3 as score", "4 as item")
    assert rows(ranked_search(clash, asked.selectExpr("*", "1 as id", "2 as doc_id"))) == plain(DOCS, ITEMS)


def test_query_has_sql(spark):
    assert op13_ranked_search(spark, "/root/testdata/sf0.001").columns == ["item_id", "rank", "doc_id", "score"]
    assert "FROM benchmark" in OP13_SQL

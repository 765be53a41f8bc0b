"""The prefix trie against a plain version that lists every beginning."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from textloom.llm import prefix_trie
from textloom.llm.prefix_trie import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = []
    for k, ms in members.items():
        under = [x for x in members if x[: len(k)] == k]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in ms if len(built[c]) == len(k))
        out.append((ms[0], len(k), members[k[:-1]][0] if k else None, len(ms), sum(len(x) == len(k) + 1 for x in under), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def sample(seed, n=60, long=9):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-20, 90), n):
        for turn in range(rng.randrange(1, long)):
            out.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["", "a", "ä" * 3, "hello world"][: 1 + rng.randrange(4)])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("first", "cells"), [(1, 10**6), (2, 12), (3, 0), (8, 40)])
def test_matches_a_plain_version(spark, first, cells):
    data = sample(first)
    assert rows(trie(spark.createDataFrame(data, SCHEMA).repartition(5), first, cells=cells)) == plain(data)


def test_a_deep_conversation(spark):
    data = [(c, t, "user", str(t) if t < 60 else f"{c} {t}") for c in (5, 10, 15, 20) for t in range(58 + c // 5)]
    assert rows(trie(spark.createDataFrame(data, SCHEMA), 2)) == plain(data)


def test_conversations_as_they_are(spark):
    data = sample(7, 30, 6)
    assert rows(trie(spark.createDataFrame(data, SCHEMA), 2, rebuild=False)) == plain(data, False)


def test_odd_rows(spark):
    data = [
        (None, 0, "user", "no conversation"), (0, None, "user", "first"), (0, 0, None, "second"), (0, 1, "user", None),
        (1, 3, "user", "tie"), (1, 3, "user", "another"), (1, 3, "user", "tie"), (1, None, None, None), (1, None, "", ""),
        (2, 0, "user", "x" * 200_000), (3, 0, "user", "x" * 200_000), (7, 0, "us", "er:"), (8, 0, "user", ":"), (2**62, 0, "user", "first"), (-3, 0, "user", "first"),
    ]
    assert rows(trie(spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as key", "'x' as keys", "2 as depth", "3 as length"))) == plain(data)
    turnless = [c for c in range(5000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3][:6]
    data = [(c, t, "user", "alone") for c in turnless for t in range(2)]
    got = rows(trie(spark.createDataFrame(data, SCHEMA)))
    assert got == plain(data) and got[0][1:4] == (0, None, 6)


def test_empty_table(spark):
    assert rows(trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows(trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_members_of_one_beginning_are_hashed_in_pieces(spark):
    data = [(c, 0, "user", "same") for c in range(0, 2000, 5)] + [(1, 0, "user", "other")]
    found = prefix_trie.paths(spark.createDataFrame(data, SCHEMA).repartition(6))
    whole, cut = ({bytes(r.key): (r.conv_id, r.n_ends, r.ends_sha256) for r in prefix_trie.ended(found, piece).collect()} for piece in (1 << 20, 40))
    assert whole == cut and max(n for _, n, _ in whole.values()) >= 400
    assert rows(trie(spark.createDataFrame(data, SCHEMA))) == plain(data)

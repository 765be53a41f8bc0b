"""A linear-chain conditional random field over tokens, trained here and decoded exactly in bulk.

States are outside, begin and inside. A token's class is a set of shape features; the score of a state at a
token is the sum of the weights of its own class, of its two predecessors, of its successor and of the file.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

O, B, I = range(3)  # noqa: E741
#: Words that announce a secret; fixed values.
KEYWORDS = frozenset(b"password passwd pwd passphrase secret token apikey api_key api-key access_key secret_key private_key auth_token access_token client_secret credential credentials bearer authorization".split())
#: Prefixes of well-known credential formats; fixed values.
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghs_", b"github_pat_", b"glpat-", b"xoxb-", b"xoxp-", b"sk_live_", b"rk_live_", b"sk-", b"eyJ", b"AIza", b"npm_")
_EDGE = b"\"'`,;()[]{}<>!?%&*#$|"
_LOWER, _UPPER, _DIGIT = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_HIGH = bytes(range(128, 256))
_WORD = _LOWER + _UPPER + _HIGH
_SIGNS = b"+/_=-"
_JUNK = re.compile(rb"[^A-Za-z0-9+/_.=:@-]")
#: Features of a token's shape, in the order of their bits.
FEATURES = ("plain", "keyword", "separator", "ends_separator", "prefix", "digits", "mixed_kinds", "mixed_case", "len_8", "len_16", "len_20", "len_32", "len_64", "signs", "hex", "dotted", "at_or_slash", "other", "flips", "pem", "quoted", "keyword_inside")
_N = len(FEATURES)


def features(token: bytes) -> int:
    """Bits of the features that hold for a token."""
    if not token.translate(None, _WORD):
        return 1 << 1 if token.lower() in KEYWORDS else 1
    on = set()
    core = token.strip(_EDGE)
    if token in (b"=", b":", b":=", b"=>", b"->", b"=="):
        on.add("separator")
    elif core.endswith((b":", b"=")) and core.rstrip(b":=").lower().strip(b"\"'`") in KEYWORDS:
        on |= {"ends_separator", "keyword"}
    if core.lower() in KEYWORDS:
        on.add("keyword")
    if core.startswith(b"-----") or core.endswith(b"-----"):
        on.add("pem")
    plain = core.rstrip(b".:")
    if not plain.translate(None, _WORD):
        on.add("plain")
    else:
        digits, lower, upper = (len(plain) - len(plain.translate(None, x)) for x in (_DIGIT, _LOWER, _UPPER))
        if plain.startswith(PREFIXES):
            on.add("prefix")
        if digits == len(plain):
            on.add("digits")
        if digits and lower + upper:
            on.add("mixed_kinds")
        if lower and upper > 1:
            on.add("mixed_case")
        on |= {f"len_{n}" for n in (8, 16, 20, 32, 64) if len(plain) >= n}
        if plain.translate(None, _SIGNS) != plain:
            on.add("signs")
        if not plain.translate(None, b"0123456789abcdef"):
            on.add("hex")
        if b"." in plain:
            on.add("dotted")
        if b"@" in plain or b"//" in plain:
            on.add("at_or_slash")
        if _JUNK.search(plain):
            on.add("other")
        kinds = plain.translate(_KIND)
        if sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) >= max(4, len(plain) // 4):
            on.add("flips")
        if token[:1] in (b'"', b"'") or b'"' in token:
            on.add("quoted")
        if any(k in plain.lower() for k in (b"password=", b"token=", b"secret=", b"key=", b"password:", b"token:", b"secret:", b"key:")):
            on.add("keyword_inside")
    return sum(1 << k for k, name in enumerate(FEATURES) if name in on)


_KIND = bytes(0 if chr(c).islower() and c < 128 else 1 if chr(c).isupper() and c < 128 else 2 if 48 <= c < 58 else 3 for c in range(256))


def bits(mask: int) -> np.ndarray:
    return np.array([mask >> k & 1 for k in range(_N)], np.float64)


class Crf:
    """Weights: own, before, before2 and after of shape (features, 3), file (3, 3), transitions (3, 3)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        t = weights["transitions"]
        # What a path can gain at most by leaving O at one token: by both its transitions, or by the only one at a text's end or start, or by none.
        gains = [((t[:, s] - t[:, O]).max(), (t[s] - t[O]).max()) for s in (B, I)]
        self.reach = max(0.0, *(max(a + b, a, b) for a, b in gains))

    def table(self, mask: int) -> np.ndarray:
        x = bits(mask)
        return np.concatenate([x @ self.w[k] for k in ("own", "before", "before2", "after")])

    def emissions(self, rows: np.ndarray, starts: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Scores (tokens, 3): ``rows`` has each token's table row, ``starts`` each text's first token, ``files`` each text's file features."""
        e = rows[:, 0:3].copy()
        at = np.zeros(len(rows), bool)
        at[starts[starts < len(rows)]] = True
        second = np.zeros(len(rows), bool)
        second[1:] = at[:-1]
        before, before2, after = rows[:-1, 3:6].copy(), rows[:-2, 6:9].copy(), rows[1:, 9:12].copy()
        before[at[1:]] = 0
        before2[(at | second)[2:]] = 0
        after[at[1:]] = 0
        e[1:] += before
        e[2:] += before2
        e[:-1] += after
        lengths = np.diff(np.append(starts, len(rows)))
        e += np.repeat(files @ self.w["file"], lengths, axis=0)
        return e

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best state of each token of one chain."""
        t = self.w["transitions"].tolist()
        best, back = e[0].tolist(), []
        for x in e[1:].tolist():
            froms = [max(range(3), key=lambda p: (best[p] + t[p][s], -p)) for s in range(3)]
            best = [best[p] + t[p][s] + x[s] for s, p in enumerate(froms)]
            back.append(froms)
        state = max(range(3), key=lambda s: (best[s], -s))
        out = [state]
        for froms in reversed(back):
            out.append(state := froms[state])
        return out[::-1]

    def decode(self, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Best states of all texts' tokens, as Viterbi over each whole text gives.

        Where O leads by more than any two transitions can repay, the best path is in O; only the stretches
        between such tokens are searched, each with the certain tokens at its ends.
        """
        out = np.zeros(len(e), np.int8)
        open_ = np.flatnonzero(e[:, O] - e[:, 1:].max(axis=1) <= self.reach)
        if not len(open_):
            return out
        text = np.searchsorted(starts, open_, side="right") - 1
        ends = np.append(starts[1:], len(e))
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text) > 0)) + 1
        for run, k in zip(np.split(open_, cut), np.split(text, cut), strict=True):
            lo, hi = max(run[0] - 1, starts[k[0]]), min(run[-1] + 2, ends[k[0]])
            out[lo:hi] = self.viterbi(e[lo:hi])
        return out


def _synthetic(rng: np.random.Generator, n: int, length: int) -> tuple[list[list[bytes]], np.ndarray]:
    """Made-up token sequences with secrets in various settings, and their states."""
    letters, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def draw(chars: str, lo: int, hi: int) -> str:
        return "".join(chars[k] for k in rng.integers(0, len(chars), rng.integers(lo, hi)))

    def word() -> str:
        w = draw(letters, 1, 14)
        kind = rng.integers(0, 14)
        return [w, w, w, w, w, w + ",", w + ".", w.title(), w.upper(), w.upper() + "!!", w + "%%%", w + "***", "é" + w, f"({w})"][kind]

    def other() -> str:
        w = draw(letters, 2, 9)
        return [draw("0123456789", 1, 17), ".".join(str(x) for x in rng.integers(0, 256, 4)), f"{w}@{w}.com", f"https://{w}.org/{w}/{rng.integers(0, 999)}", f"{rng.integers(1900, 2100)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", "|", f"{w}_{w}()", w.title() + w.title(), f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}", f"{w}-{w}", f"{w}/{w}.py", "###", f"{w}{rng.integers(0, 99)}"][rng.integers(0, 13)]

    def value() -> str:
        kind = rng.integers(0, 6)
        v = [draw("0123456789abcdef", 32, 65), draw(alnum, 16, 48), draw(alnum + "+/", 24, 64) + "=", draw(alnum + "_-", 12, 40), draw(alnum, 8, 16) + "7xQ", PREFIXES[rng.integers(0, len(PREFIXES))].decode() + draw(alnum, 16, 40)][kind]
        return f'"{v}"' if rng.random() < 0.3 else v

    words = sorted(k.decode() for k in KEYWORDS)
    texts, states = [], np.zeros((n, length), np.int64)
    for k in range(n):
        tokens = [word() if rng.random() < 0.85 else other() for _ in range(length)]
        at = int(rng.integers(2, length - 4))
        kind = int(rng.integers(0, 8))
        key = words[rng.integers(0, len(words))]
        if kind == 0:
            tokens[at - 2 : at + 1] = [key, "=", value()]
            states[k, at] = B
        elif kind == 1:
            tokens[at - 1 : at + 1] = [key + ":", value()]
            states[k, at] = B
        elif kind == 2:
            tokens[at] = PREFIXES[rng.integers(0, len(PREFIXES))].decode() + draw(alnum, 18, 40)
            states[k, at] = B
        elif kind == 3:
            tokens[at - 1 : at + 4] = ["-----BEGIN", "PRIVATE", "KEY-----", draw(alnum + "+/", 64, 65), draw(alnum + "+/", 64, 65)]
            states[k, at + 2], states[k, at + 3] = B, I
        elif kind == 4:
            tokens[at - 1 : at + 1] = [key, word()]
        elif kind == 5:
            tokens[at - 1 : at + 2] = [word(), ":", other()]
        elif kind == 6:
            tokens[at - 1 : at + 1] = ["commit", draw("0123456789abcdef", 7, 41)]
        texts.append([t.encode() for t in tokens])
    return texts, states


@cache
def trained(seed: int = 7, n: int = 2000, length: int = 14, rounds: int = 120) -> Crf:
    """The model: maximum likelihood with a small penalty on ``n`` made-up sequences, by Adam.

    It depends on the parameters alone, so it is the same for every input.
    """
    rng = np.random.default_rng(seed)
    texts, states = _synthetic(rng, n, length)
    x = np.stack([np.stack([bits(features(t)) for t in text]) for text in texts])
    has = x[:, :, FEATURES.index("keyword")].max(axis=1)
    files = np.stack([np.ones(n), has, 1 - has], 1)
    pad = lambda a, k: np.concatenate([np.zeros_like(a[:, :k]), a[:, :-k]], 1)
    views = {"own": x, "before": pad(x, 1), "before2": pad(x, 2), "after": np.concatenate([x[:, 1:], np.zeros_like(x[:, :1])], 1)}
    w = {k: np.zeros((_N, 3)) for k in views} | {"file": np.zeros((3, 3)), "transitions": np.zeros((3, 3))}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    gold = np.eye(3)[states]
    flat = {k: np.ascontiguousarray(a.reshape(-1, _N).T) for k, a in views.items()}
    gold_t = np.einsum("nlp,nls->ps", gold[:, :-1], gold[:, 1:])
    for step in range(1, rounds + 1):
        e = sum(flat[k].T @ w[k] for k in flat).reshape(n, length, 3) + (files @ w["file"])[:, None, :]
        t = w["transitions"]
        f, b = e.copy(), np.zeros_like(e)
        for i in range(1, length):
            f[:, i] += np.logaddexp.reduce(f[:, i - 1, :, None] + t, axis=1)
        for i in range(length - 2, -1, -1):
            b[:, i] = np.logaddexp.reduce(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(f[:, -1], axis=1)
        p = np.exp(f + b - z[:, None, None])
        pairs = np.exp(f[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        d = gold - p
        g = {k: a @ d.reshape(-1, 3) for k, a in flat.items()} | {"file": files.T @ d.sum(1), "transitions": gold_t - pairs.sum((0, 1))}
        for k in w:
            grad = g[k] / n - 1e-4 * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad**2
            w[k] = w[k] + 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Crf(w)

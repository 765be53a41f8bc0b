"""Main text of web pages by minimum-cut labelling of their blocks.

A classifier gives each block the costs of calling it content or boilerplate: the capacities of its edges to
the terminals. Neighbouring blocks, and blocks of one container, are joined by edges that cost more the
nearer they are in the DOM. The minimum cut, found by maximum flow, is the labelling of least total cost.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .html_blocks import CONTEXT, WORDS, Block, blocks
from .quality import logistic

#: Cost of a border between adjacent blocks, and between successive blocks of one container, when nearest in the DOM.
ADJACENT, CONTAINER = 0.6, 0.4
_UNIT = 1000  # capacities are whole thousandths


#: Words that notices and reader comments are full of; fixed values.
NOTICE_WORDS = frozenset("cookie cookies consent accept privacy gdpr subscribe newsletter login datenschutz einwilligung akzeptieren einverstanden accepter confidentialité consentement aceptar privacidad consentimiento".split())
COMMENT_WORDS = frozenset("reply replies comment comments says wrote posted ago upvote antworten kommentar répondre commentaire responder comentario".split())
_NAMED = tuple(CONTEXT.index(x) for x in WORDS)


def page_features(found: list[Block]) -> list[list[float]]:
    """Features of each block: the elements around it, words in their names, its text, and its container's part of the page's sentences.

    The last ones let text overrule names: an element that holds most of a page's sentences is its article, whatever it is called.
    """
    sentences: Counter[int] = Counter()
    members: Counter[int] = Counter()
    heads: set[int] = set()
    kin: dict[int, set[int]] = {}
    called: Counter[tuple[int, int]] = Counter()
    plain, heading = [], CONTEXT.index("heading")
    for b in found:
        n = max(0, len(b.text) - 2 * b.linked) if b.text[-1] in ".!?:…»\"'" or sum(map(b.text.count, ".!?")) else 0
        plain.append(n)
        for c in {b.container, b.outer}:
            sentences[c] += n
        members[b.container] += 1
        called[b.naming] += n
        kin.setdefault(b.outer, set()).add(b.container)
        if b.context >> heading & 1:
            heads |= {b.container}
    total = sum(plain) + 1
    best = max((b.container for b in found), key=lambda c: sentences[c], default=0)
    last = max((k for k, b in enumerate(found) if best in (b.container, b.outer)), default=0)
    out = []
    for k, b in enumerate(found):
        words = b.text.lower().split()
        ends = sum(b.text.count(c) for c in ".!?;,")
        bare = [w.strip(".,:;!?()") for w in words]
        part = sentences[b.container] / total
        out.append([
            *(float(b.context >> j & 1) for j in range(len(CONTEXT))), *(float(b.named >> j & 1) for j in _NAMED), *((b.naming[1] >> j & 1) * (1 - called[b.naming] / total) for j in _NAMED),
            min(np.log1p(len(words)) / 4, 2.0), min(1.0, b.linked / len(b.text)), min(1.0, 4 * ends / len(words)), float("©" in b.text or "all rights" in b.text.lower()),
            part, float(part > 0.5), sentences[b.outer] / total, float(b.container in heads), float(k > last),
            min(1.0, 8 * sum(w in NOTICE_WORDS for w in bare) / len(words)), min(1.0, 8 * sum(w in COMMENT_WORDS for w in bare) / len(words)), float(members[b.container] <= 3 and len(kin[b.outer]) > 1), min(1.0, plain[k] / 400),
        ])
    return out


@cache
def _stock() -> list[str]:
    """Made-up words of 1 to 10 letters."""
    rng, letters = np.random.default_rng(5), np.array(list("abcdefghijklmnoprstuvwz"))
    return ["".join(letters[rng.integers(0, len(letters), n)]) for n in rng.integers(1, 11, 5000).tolist()]


def _sample_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A made-up page and whether each of its blocks is content."""
    stock = _stock()

    def words(lo: int, hi: int) -> str:
        return " ".join([stock[k] for k in rng.integers(0, len(stock), int(rng.integers(lo, hi))).tolist()])

    def sentences(n: int) -> str:
        return " ".join(words(3, 22).capitalize() + "." for _ in range(n))

    def pick(*options: str) -> str:
        return options[rng.integers(0, len(options))]

    def talk(said: frozenset[str], n: int) -> str:
        """Sentences with some words of a kind in them."""
        text = sentences(n).split()
        for _ in range(rng.integers(1, 2 + n)):
            text.insert(int(rng.integers(0, len(text))), pick(*sorted(said)))
        return " ".join(text)

    def pick_words() -> frozenset[str]:
        return NOTICE_WORDS if rng.random() < 0.5 else COMMENT_WORDS

    names = [w for words_ in WORDS.values() for w in words_.split()]

    def named(*usual: str) -> str:
        """A class or id: what is usual for a part, a name that says nothing, or none."""
        x = rng.random()
        if x < 0.6:
            return f' {pick("class", "class", "id")}="{pick(*usual)}"'
        return "" if x < 0.8 else f' class="{words(1, 3).lower()} {pick("c", "box", "u", "sc")}-{rng.integers(0, 99)}"'

    out: list[tuple[str, list[bool]]] = []

    def links(tag: str) -> tuple[str, list[bool]]:
        n = int(rng.integers(2, 8))
        return f"<{tag}><ul>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(n)) + f"</ul></{tag.split()[0]}>", [False] * n

    def junk(kind: int | None = None) -> tuple[str, list[bool]]:
        kind = rng.integers(0, 9) if kind is None else kind
        if kind == 0:
            return links(pick("nav", 'div' + named("menu", "navbar", "related-posts", "share"), 'aside class="sidebar"'))
        if kind == 1:
            return f"<{(t := pick('header', 'footer'))}><p>{pick('&copy; ', '')}{words(2, 12)}</p></{t}>", [False]
        if kind == 2:  # inside of articles too
            return f'<div {pick('class="ad"', 'class="advert"', 'class="ads banner"', 'class="sponsored"', 'id="promo"', "hidden", 'style="display:none"')}>{sentences(int(rng.integers(1, 4)))}</div>', [False]
        if kind == 3:
            n = int(rng.integers(1, 3))
            return f'<div{named("cookie-notice", "consent", "newsletter", "alert", "popup")}>' + "".join(f"<p>{talk(NOTICE_WORDS, int(rng.integers(1, 4)))}</p>" for _ in range(n)) + "</div>", [False] * n
        if kind == 4:
            return f"<form><label>{words(1, 4)}</label><input><p>{words(2, 12)}</p><button>{words(1, 3)}</button></form>", [False, False, False]
        if kind == 5:
            n = int(rng.integers(1, 5))
            return f'<{(t := pick("section", "div"))}{named("comments", "comment-list", "disqus", "replies")}>' + "".join(f"<div><p>{talk(COMMENT_WORDS, int(rng.integers(1, 5)))}</p></div>" for _ in range(n)) + f"</{t}>", [False] * n
        if kind == 6:
            return f"<aside><p>{sentences(int(rng.integers(1, 4)))}</p></aside>", [False]
        if kind == 7:
            return f'<div class="{pick("breadcrumb", "tags", "social")}"><a href="/">{words(1, 3)}</a> <a href="/y">{words(1, 3)}</a></div>', [False]
        return f'<div{named("footer", "header", "topbar", "bottom")}>{words(2, 14)}</div>', [False]

    def article() -> tuple[str, list[bool]]:
        tag = pick("article", "article", "main", 'div class="content"', 'div id="post"', 'div class="article-body"', "div", 'section class="story"')
        if rng.random() < 0.35:  # names that mislead, alone or beside a right one
            wrong = " ".join(pick(*names) for _ in range(rng.integers(1, 3)))
            tag = pick(f'article class="{wrong}"', f'div class="{pick("article", "post", "content", "story")} {wrong}"', f'main id="{wrong}"', f'article class="{pick("read", "open", "has", "top")}-{wrong}"')
        inner, labels = ([f"<h1>{words(3, 11)}</h1>"], [True]) if rng.random() < 0.85 else ([], [])
        for _ in range(rng.integers(1, 9) + (not inner)):
            kind = rng.integers(0, 9)
            if kind == 0:
                inner.append(f"<h2>{words(2, 7)}</h2>")
                labels.append(True)
            elif kind == 1:
                n = int(rng.integers(2, 5))
                inner.append("<ul>" + "".join(f"<li>{words(3, 15)}</li>" for _ in range(n)) + "</ul>")
                labels += [True] * n
            elif kind == 2:
                inner.append(f'<p>{words(3, 9)} <a href="/z">{words(1, 5)}</a> {sentences(1)}</p>')
                labels.append(True)
            elif kind in (3, 5):
                more, marks = junk(2 if rng.random() < 0.6 else None)
                inner.append(more)
                labels += marks
            elif kind == 4:
                inner.append(f"<p>{words(1, 6).capitalize()}.</p>")
                labels.append(True)
            else:
                n = int(rng.integers(1, 7))
                # Articles speak of such things too.
                inner.append(f"<p>{talk(pick_words(), n) if rng.random() < 0.3 else sentences(n)}</p>")
                labels.append(True)
        if not any(x.startswith("<p") for x in inner):
            inner.append(f"<p>{sentences(2)}</p>")
            labels.append(True)
        return f"<{tag}>" + "".join(inner) + f"</{tag.split()[0]}>", labels

    out += [junk() for _ in range(rng.integers(1, 4))]
    out.append(article())
    out += [junk() for _ in range(rng.integers(1, 4))]
    return "<body>" + "".join(x for x, _ in out) + "</body>", [y for _, ys in out for y in ys]


@cache
def trained(seed: int = 11, pages: int = 900) -> tuple[tuple[float, ...], float]:
    """Weights and bias of the block classifier, a logistic regression fitted on made-up pages; the same for every input."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        html, labels = _sample_page(rng)
        found = blocks(html)
        if len(found) == len(labels):
            x += page_features(found)
            y += labels
    model = logistic(np.array(x), np.array(y, float))
    w = model.weights[1:] / model.scale
    return tuple(w.tolist()), float(model.weights[0] - model.mean @ w)


def edges(found: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness edges and their capacities."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}

    def join(i: int, j: int, shared: int, weight: float) -> None:
        capacity = int(_UNIT * weight * (1 + shared) / (1 + max(found[i].depth, found[j].depth)))
        if capacity:
            out[i, j] = out.get((i, j), 0) + capacity

    for j, block in enumerate(found):
        if j:
            join(j - 1, j, block.shared, ADJACENT)
        if (i := last.get(block.container)) is not None:
            join(i, j, block.depth - (found[i].home != block.home), CONTAINER)
        last[block.container] = j
    return out


def minimum_cut(gains: list[int], links: dict[tuple[int, int], int]) -> list[bool]:
    """Labels of least cost: a node on the wrong side costs |gain| (positive gains want True), a cut edge its capacity.

    Nodes whose gain outweighs all their edges are settled first, which no optimum contradicts, and hand their
    pull to their neighbours; maximum flow labels the rest. Of several optima it takes the one with fewest True nodes.
    """
    n = len(gains)
    gain, near = list(gains), [{} for _ in range(n)]
    for (i, j), c in links.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, c in near[i].items():
                gain[j] += c if label[i] else -c
                del near[j][i]
                if label[j] is None:
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        reached = _max_flow([gain[i] for i in rest], [{at[j]: c for j, c in near[i].items()} for i in rest])
        for i in rest:
            label[i] = at[i] in reached
    return label


def _max_flow(gain: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes on the source's side of the cut after Dinic's maximum flow."""
    n = len(gain)
    source, sink = n, n + 1
    left: list[dict[int, int]] = [dict(x) for x in near] + [{}, {}]
    for i, g in enumerate(gain):
        if g > 0:
            left[source][i], left[i][source] = g, 0
        elif g < 0:
            left[i][sink], left[sink][i] = -g, 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in left[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        steps = [iter(list(x)) for x in left]
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= push
                    left[b][a] += push
                path = [source]
                steps[source] = iter(list(left[source]))
                continue
            j = next((j for j in steps[i] if left[i][j] > 0 and level.get(j) == level[i] + 1), None)
            if j is None:
                path.pop()
                level[i] = -1
            else:
                path.append(j)


def main_text(html: str, seed: int = 11) -> str:
    """Text of the content blocks in page order, joined by one space."""
    weights, bias = trained(seed)
    return _extract(html, weights, bias)


def _extract(html: str, weights: tuple[float, ...], bias: float) -> str:
    found = blocks(html)
    if not found:
        return ""
    gains = [int(_UNIT * (bias + sum(w * x for w, x in zip(weights, row, strict=True) if x))) for row in page_features(found)]
    keep = minimum_cut(gains, edges(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame, seed: int = 11) -> DataFrame:
    """Return ``(page_id, url, text)`` for every row of ``pages``: the main text of the whole html.

    Null and empty html give an empty text; any other string is read leniently. Every row is read alone, so
    repeated rows give repeated results and null ids and urls stay null. Other columns are not read.
    """
    bound_batches(pages.sparkSession, 200)
    weights, bias = trained(seed)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_extract(x.as_py(), weights, bias) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("h")).mapInArrow(mapped, "page_id long, url string, text string")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Contract query: main text of every page."""
    from .common import table

    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

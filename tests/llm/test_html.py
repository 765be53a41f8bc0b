import itertools
import random
import re
from html import unescape

import duckdb
import numpy as np
import pytest

from textloom.llm.html_blocks import CONTEXT, blocks
from textloom.llm.html_extract import _sample_page, edges, extract_pages, page_features, main_text, minimum_cut, trained


def cost(gains, links, labels):
    return sum(abs(g) for g, t in zip(gains, labels) if (g > 0) != t and g) + sum(c for (i, j), c in links.items() if labels[i] != labels[j])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(1, 9)
        gains = [rng.randrange(-20, 21) for _ in range(n)]
        links = {(i, j): rng.randrange(1, 15) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        best = min(cost(gains, links, t) for t in itertools.product([True, False], repeat=n))
        assert cost(gains, links, minimum_cut(gains, links)) == best


def test_blocks_are_read_leniently():
    read = lambda html: [b.text for b in blocks(html)]
    assert read("<p>a <b>b</b>c<br>d<p>e &amp;amp; f&eacute;&#x41;</div></p>tail") == ["a bc d", "e &amp; féA", "tail"]
    assert read("<p>x<!-- > y --><script>if (a<b) '</p>'</script>z") == ["x z"]
    assert read("<style>p{}") == [] and read("") == [] and read("<") == ["<"] and read("a < b") == ["a < b"]
    assert read('<p title="a>b">x</p><ul><li>1<li>2</ul>') == ["x", "1", "2"]
    assert read("<div " + "x" * 5 + ">" + "<div>" * 3000 + "deep") == ["deep"]


def test_article_of_a_page():
    html = """<html><head><title>T</title></head><body><header><p>Site name</p></header><nav><a href=/>Home</a><a href=/x>More</a></nav>
    <div class="cookie-banner"><p>We use cookies, you know. Accept them all please.</p></div>
    <article><h1>Title of it</h1><p>First &lt;paragraph&gt; of the article, with a few words in it.</p><div class="ad">Buy this now. It is very good.</div>
    <p>Short one.</p><ul><li>an item</li></ul></article><aside><p>Read this too. It is related.</p></aside>
    <section class="comments"><p>Nice article, I liked it. Thanks for that.</p></section><form><label>Mail</label></form><footer>&copy; 2020</footer>"""
    assert main_text(html) == "Title of it First <paragraph> of the article, with a few words in it. Short one. an item"


_PLAIN = "<p>The first sentence stands here. It is plain.</p><p>Another one follows, and it is plain too.</p>"


@pytest.mark.parametrize("tag", ['article class="read-more widget"', 'div class="article related-content"', 'div class="post tags-open"', 'div class="sidebar"', 'main id="popular comments"', "div", 'section class="x-17 u"'])
def test_text_overrules_names(tag):
    """An article stays whatever its class says, and notices and comments go whatever theirs do not say."""
    article = f"<{tag}>{_PLAIN}</{tag.split()[0]}>"
    want = "The first sentence stands here. It is plain. Another one follows, and it is plain too."
    assert main_text(article) == want
    assert main_text(f"<nav><a href=/>Home</a><a href=/x>More</a></nav>{article}<footer>&copy; site</footer>") == want
    others = "<div class='x9'><p>We use cookies. Please accept our privacy terms.</p></div><div class=u7><div><p>Nice, thanks for this. reply</p></div><div><p>Anna says: I do not agree. reply</p></div></div>"
    assert main_text(f"<h1>Title of it</h1>{article}{others}").endswith(want)


def test_an_article_may_speak_of_cookies():
    page = "<article><h1>How cookies work</h1><p>A cookie is a small text that a site keeps, and privacy laws want your consent to it.</p><p>She said that most of them live for a day.</p><p>The comments of the committee were short.</p></article>"
    assert main_text(page).startswith("How cookies work A cookie is") and main_text(page).endswith("were short.")


def test_reading_takes_linear_time():
    import time

    for page in ("<![CDATA[" * 20_000, '<a "' * 50_000, "<div>" * 60_000 + "x", "<div>" * 3000 + "<p>x</p>" * 20_000, "<!--" * 50_000, "<a href='%d'>" * 30_000):
        began = time.process_time()
        blocks(page)
        assert time.process_time() - began < 3, page[:20]
    assert [b.text for b in blocks("<p>a<![CDATA[b]]>c</p><![CDATA[d <p>e")] == ["abc", "e"]
    from textloom.llm.html_blocks import _word_bits

    before = _word_bits.cache_info().currsize
    blocks("".join(f'<a href="/{k}">x</a>' for k in range(5000)))
    assert _word_bits.cache_info().currsize <= before + 1 and _word_bits.cache_info().maxsize


def test_edges_are_exact_at_any_depth():
    """Depths and common ancestors agree with the paths of a plain reading."""
    rng = random.Random(8)
    for _ in range(60):
        html, path, made, want = "", [], 0, []
        for k in range(60):
            if path and rng.random() < 0.4:
                html += "</div>"
                path.pop()
            else:
                html += "<div>"
                made += 1
                path.append(made)
            if rng.random() < 0.5:
                html += f"t{k}"
                want.append(list(path))
        found, merged = blocks(html), []
        texts = re.findall(r"t\d+", " ".join(b.text for b in found))
        assert len(texts) == len(want)
        for b, p in zip(found, want):
            assert b.depth == len(p) and b.home == (p[-1] if p else 0)
        for (x, p), q in zip(zip(found[1:], want[1:]), want):
            assert x.shared == sum(1 for a, c in itertools.takewhile(lambda t: t[0] == t[1], zip(p, q)))


def test_held_out_blocks():
    weights, bias = trained()
    rng = np.random.default_rng(77)
    right = total = 0
    for _ in range(150):
        html, labels = _sample_page(rng)
        found = blocks(html)
        gains = [int(1000 * (bias + np.dot(weights, row))) for row in page_features(found)]
        got = minimum_cut(gains, edges(found))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_pages_of_the_test_table(sf):
    rows = duckdb.connect().execute(f"SELECT html FROM '/root/testdata/{sf}/pages.parquet'").fetchall()
    for (html,) in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        plain = " ".join(unescape(re.sub(r"<(?:/?(?:p|h1|br)\b)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert main_text(html) == plain


def test_odd_rows(spark):
    rows = [(1, "u", None, 0), (1, "u", "", 0), (None, None, "<p>" + "Words in a row, as usual. " * 20_000, 0)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted(len(r["text"]) for r in got.collect()) == [0, 0, 26 * 20_000 - 1]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("before", ["<form><datalist><option value=a>A<option value=b>B</datalist></form>", "<select><option>A<option>B", "<div><svg><text x=1></div>", *(f"<{x} data=y>" for x in "video audio object canvas svg math template noscript select option".split())])
def test_hidden_elements_without_end_tags(before):
    page = "<article><h1>A title</h1><p>First part.</p><p>Second part.</p></article>"
    want = ["A title", "First part.", "Second part."]
    assert [b.text for b in blocks(before + page)] == want
    later = "<video>v</video><audio>v</audio><object>v</object><canvas>v</canvas><svg>v</svg><math></math><template>v</template><noscript>v</noscript><select><option>v</select>"
    assert [b.text for b in blocks(before + page + later)] == want


def test_hidden_elements_and_formulas():
    read = lambda html: [b.text for b in blocks(html)]
    assert read("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds") == ["so x=1 holds"]
    assert read("<p>x <video><p>old <b>browser</b></p></video>y <svg><path d=1/><title>t</title><text>u</text></svg>z") == ["x y z"]
    assert read("<template><p>x</p></template><p>pick <select><option>a<option>b</select> one</p>") == ["pick one"]
    assert read("<video src=a><p>T.</p><video src=b><p>old</p></video><p>U.") == ["T.", "U."]


@pytest.mark.parametrize("deep", ["<div>" * 1000, "<font>" * 1000, "<a name=x>" * 450 + "<section>" * 450])
def test_context_at_any_depth(deep):
    found = blocks(f"<article>{deep}<nav><div>menu</div></nav><article><p>inner</p></article><p>outer</p>")
    named = [(b.text, [x for k, x in enumerate(CONTEXT) if b.context >> k & 1]) for b in found]
    assert named == [("menu", ["menu", "article"]), ("inner", ["article", "paragraph"]), ("outer", ["article", "paragraph"])]

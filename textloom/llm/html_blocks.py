"""Lenient reading of HTML into text blocks with the context that they stand in."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

#: Elements by their role in a page; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup: it runs to their end tag, or to the end of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements of markup whose text is not shown. One without its end tag hides nothing, save for CLOSED_BY.
HIDDEN = frozenset("noscript template svg object canvas audio video select option annotation annotation-xml".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input nobr blink".split()) | MATH
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
KEEPS_PARAGRAPH = INLINE | HIDDEN | frozenset(["optgroup"])
_BREAKS = frozenset("address article aside blockquote body center dd details dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section table ul".split())
#: Start tags that end a hidden element: what a list of choices, or a drawing outside foreignObject, cannot hold.
CLOSED_BY = {
    "option": _BREAKS | frozenset("option optgroup hr div".split()), "select": _BREAKS,
    "svg": _BREAKS | frozenset("b big br code div em embed hr i img meta nobr ruby s small span strong strike sub sup tt u var".split()),
}
#: Words in class, id or role that name a part of a page, by part; fixed values.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager",
    "top": "header masthead banner topbar branding logo",
    "foot": "footer copyright colophon bottom",
    "side": "sidebar aside rail widget related recommended popular trending more tags",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall disclaimer",
    "form": "form search login signup contact",
    "comments": "comment comments disqus discussion replies reply responses",
    "share": "share sharing social follow",
    "body": "article post content entry story main body text blog prose",
    "hidden": "hidden invisible sr-only screen-reader skip",
}
TAGS = {
    "nav": "menu", "menu": "menu", "header": "top", "footer": "foot", "aside": "side", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "main",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "blockquote": "paragraph", "pre": "paragraph", "li": "item", "td": "cell", "th": "cell", "figcaption": "caption", "address": "foot",
}
#: Context features; an element's are its ancestors' and its own. The last five hold for the innermost block only.
CONTEXT = ("menu", "top", "foot", "side", "advert", "notice", "form", "comments", "share", "body", "hidden", "article", "main", "heading", "paragraph", "item", "cell", "caption")
_BIT = {name: 1 << k for k, name in enumerate(CONTEXT)}
_OWN = sum(_BIT[x] for x in CONTEXT[-5:])
_BY_WORD = {w: _BIT[part] for part, words in WORDS.items() for w in words.split()}
#: ARIA roles whose name is not in WORDS; fixed values.
_ROLES = {"complementary": "side", "contentinfo": "foot", "dialog": "notice", "alertdialog": "notice"}

_COMMENT, _DATA = r"(?P<open>!--).*?(?:-->|\Z)", r"!\[CDATA\[(?P<data>.*?)\]\]>"
_MARKUP = r"""(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|[!?/][^>]*+>"""
_TAG = re.compile(rf"<(?:{_COMMENT}|{_DATA}|{_MARKUP})", re.S)
#: Where no CDATA section ends any more, none begins.
_TAG_ONLY = re.compile(rf"<(?:{_COMMENT}|(?P<data>(?!))|{_MARKUP})", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Block:
    """Text of one block with where it stands.

    ``context`` has the bits of the elements around it, ``named`` those of words in their class, id and role, ``naming`` the place of the
    innermost element with such a word and its bits. ``home`` and ``container`` are
    numbers of the innermost block element and of the one around that, ``outer`` of the next one; ``depth`` counts the block elements around it, ``shared`` those
    that are around the block before it too; ``linked`` is the length of its text inside links.
    """

    text: str
    context: int
    named: int
    naming: tuple[int, int]
    home: int
    container: int
    outer: int
    depth: int
    shared: int
    linked: int


@lru_cache(maxsize=20_000)
def _word_bits(value: str) -> int:
    """Bits of the words in one value of a class, id or role."""
    bits = 0
    for word in value.split():
        for part in {word, *_SPLIT.split(word)}:
            bits |= _BY_WORD.get(part, 0)
    return bits


def _attribute_bits(attrs: str) -> tuple[int, int]:
    """Context bits and named bits of a start tag; only what stands in class, id and role is remembered, up to a bound."""
    bits = named = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display:\s*none|visibility:\s*hidden", value):
            bits |= _BIT["hidden"]
        elif name in ("class", "id", "role"):
            named |= (_word_bits if len(value) < 500 else _word_bits.__wrapped__)(value)
            if name == "role":
                for word in value.split():
                    bits |= _BIT[_ROLES[word]] if word in _ROLES else 0
    return bits, named


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order. White space in a block is one space; blocks without text are left out.

    Scripts, styles, the head and other elements whose text is not shown are skipped, character references
    decoded, and missing end tags supplied, so any string gives a result.
    """
    out, unclosed = _read(html, frozenset())
    return _read(html, frozenset(unclosed))[0] if unclosed else out


def _read(html: str, shown: frozenset[int]) -> tuple[list[Block], list[int]]:
    """Blocks, and where the hidden elements without an end tag start; those in ``shown`` do not hide their text."""
    out: list[Block] = []
    unclosed: list[int] = []
    names, bits, named, homes, links, mute, starts = ["#root"], [0], [(0, (0, 0))], [(0, 0, 0, 0)], [0], [False], [0]
    low = 0  # the least number of block elements that were open since the last block
    where: dict[str, list[int]] = {}  # depths of the open elements by name
    hiding = [0]  # depths of the open hidden elements
    parts: list[tuple[str, bool]] = []
    at, made = 0, 0

    def flush() -> None:
        nonlocal low
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                top = len(names) - 1
                while mute[top]:
                    top -= 1
                home, container, outer, depth = homes[top]
                out.append(Block(text, bits[top], *named[top], home, container, outer, depth, min(low, depth), sum(len("".join(t.split())) for t, inside in parts if inside)))
                low = depth
            parts.clear()

    def close(depth: int, ended: bool = False) -> None:
        if any(not m and n not in INLINE and n not in HIDDEN for n, m in zip(names[depth:], mute[depth:], strict=True)):
            flush()
        for k in range(len(names) - 1, depth - 1, -1):
            where[names[k]].pop()
            if names[k] in HIDDEN:
                hiding.pop()
                if names[k] != "option" and not (ended and k == depth):
                    unclosed.append(starts[k])
        nonlocal low
        del names[depth:], bits[depth:], named[depth:], homes[depth:], links[depth:], mute[depth:], starts[depth:]
        low = min(low, homes[-1][3])

    def last(*wanted: str) -> int:
        """Depth of the innermost open element of these names, or 0."""
        return max(open_[-1] if (open_ := where.get(x)) else 0 for x in wanted)

    def push(name: str, bit: int, words: tuple[int, tuple[int, int]], home: tuple[int, int, int, int], link: int, muted: bool, start: int) -> None:
        where.setdefault(name, []).append(len(names))
        if name in HIDDEN:
            hiding.append(len(names))
        names.append(name)
        bits.append(bit)
        named.append(words)
        homes.append(home)
        links.append(link)
        mute.append(muted)
        starts.append(start)

    size = len(html)
    limit = html.rfind(">") + 1  # no tag ends behind it
    data_end = html.rfind("]]>")
    while at < size:
        m = (_TAG if at <= data_end else _TAG_ONLY).search(html, at, limit) if at < limit else None
        if not mute[-1]:
            text = html[at:] if m is None else html[at : m.start()]
            if text:
                parts.append((unescape(text), links[-1] > 0))
        if m is None:
            break
        at = m.end()
        if m["open"] is not None and html[max(m.start() + 4, at - 3) : at] != "-->":
            break  # a comment without an end runs to the end of the page
        if m["data"] is not None and not mute[-1]:
            parts.append((m["data"], links[-1] > 0))
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if depth := last(name):
                close(depth, True)
            elif name == "p" and not mute[-1]:
                flush()
            if name in ("mtd", "mtr") and not mute[-1]:
                parts.append((" ", False))
            continue
        for hidden, tags in CLOSED_BY.items() if len(hiding) > 1 else ():
            if name in tags and (depth := last(hidden)) and not (hidden == "svg" and last("foreignobject") > depth):
                close(depth, True)
        if name == "br":
            if not mute[-1]:
                parts.append((" ", False))
            continue
        attrs = m["attrs"]
        slash = attrs.rstrip().endswith("/")
        if name in RAW and not slash:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            if end is None:
                break
            stop = html.find(">", end.start())
            at = size if stop < 0 else stop + 1
            if not mute[-1]:
                parts.append((" ", False))
            continue
        if name in VOID or name == "head" or name == "html":
            if name not in INLINE and name in VOID and not mute[-1]:
                flush()
            continue
        if name == "body":
            continue
        if slash and (name == "svg" or last("svg", "math")):
            if not mute[-1]:
                parts.append((" ", False))
            continue
        if name in HIDDEN:
            if not mute[-1]:
                parts.append((" ", False))
            push(name, bits[-1], named[-1], homes[-1], links[-1], mute[-1] or m.start() not in shown, m.start())
            continue
        inside = hiding[-1]
        if name not in KEEPS_PARAGRAPH and (depth := last("p")) > inside:
            close(depth)
        if name in CLOSES:
            depth = last(*CLOSES[name])
            if depth > max(inside, last("ul", "ol", "table", "dl")):
                close(depth)
        inline = name in INLINE
        if not inline:
            if not mute[-1]:
                flush()
            made += 1
        own, words = _attribute_bits(attrs) if attrs else (0, 0)
        bit = bits[-1] | own if inline else (bits[-1] & ~_OWN) | own | _BIT.get(TAGS.get(name, ""), 0)
        home = homes[-1] if inline else (made, homes[-1][0], homes[-1][1], homes[-1][3] + 1)
        push(name, bit, (named[-1][0] | words, (m.start(), words)) if words else named[-1], home, links[-1] + (name == "a"), mute[-1], m.start())
    close(1)
    flush()
    return out, unclosed

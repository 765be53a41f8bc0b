"""Syntax nodes of source texts as rows: one tokeniser and one lenient parser for all ten languages.

A text becomes tokens, tokens nested groups (brackets; blocks by indentation in Python and up to ``end`` in Ruby and Elixir), and
the statements, blocks and expressions in these become nodes. Nodes are numbered as they are entered and left
(``pre``, ``post``), so that one lies in another if its numbers lie between the other's: containment is arithmetic on columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..schemas import NODES
from ..sources.steps import by_file
from .source import _COMPILED, Lines

_TOKEN = re.compile(r"(?P<w>[A-Za-z_$@\u0080-\U0010ffff][\w$]*)|(?P<n>\d(?:[\w.]*\w)?)|(?P<o>=>|->|::|\?\.|&\.|\.{2,3}|:=|&&|\|\||\?\?|\|>|<-|[=!<>+*/%&|^-]=+|\*\*|<<|>>|[^\s\w])")
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: What a statement or block is by the word that it begins with; fixed values.
_HEADS = {
    "if": "if elsif elif unless guard", "else": "else", "loop": "for foreach while until loop do repeat", "switch": "switch match case cond select when", "try": "try begin", "catch": "catch except rescue", "finally": "finally ensure",
    "return": "return", "throw": "throw raise", "function": "function fn func def defp fun sub init deinit", "class": "class struct impl trait interface enum module defmodule protocol extension namespace record actor union mod", "with": "with using", "defer": "defer", "async": "async", "unsafe": "unsafe", "import": "import use require include",
}
HEADS = {word: kind for kind, words in _HEADS.items() for word in words.split()}
_MODIFIERS = frozenset("public private protected internal static final abstract override virtual inline export default pub async const sealed readonly partial extern unsafe mutating open fileprivate synchronized native constexpr explicit".split())
#: What goes on with the statement in front of it; fixed values.
_FOLLOWS = frozenset("else elif elsif catch except rescue finally ensure".split())
_KEYWORDS = frozenset(HEADS) - {"init", "match", "record", "select", "when", "repeat", "loop", "open", "actor", "union", "include", "require", "sub", "fun", "case"} | frozenset("new await yield in of not and or is as let var const delete typeof instanceof lambda go then end pass break continue assert move mut where".split())
_JOINS = frozenset([".", "?.", "::", "->", "&."])
_ENDS = frozenset("ruby elixir".split())
_OPENERS = {"ruby": frozenset("def class module begin case if unless while until for".split()), "elixir": frozenset(["fn"])}
_ASSIGN = re.compile(r"(?::|[+*/%&|^-]|\*\*|<<|>>|\?\?|\|\||&&)?=")


#: Brackets and commas, and what stands for them in a node's code where they are not its own.
SIGNS, MARKS = "()[]{},", "⦅⦆⟦⟧⦃⦄‚"
MARKED, PLAIN = str.maketrans(SIGNS, MARKS), str.maketrans(MARKS, SIGNS)


#: Groups within groups that a node's code still writes out, so that codes of nested calls do not grow with the square of the depth.
HEIGHT = 40


class Token:
    __slots__ = ("text", "start", "stop", "kind", "fresh")

    def __init__(self, text: str, start: int, kind: str, fresh: bool):
        self.text, self.start, self.stop, self.kind, self.fresh = text, start, start + len(text), kind, fresh


class Group:
    """What stands between brackets, or a block; ``fresh`` if it begins a line, ``height`` the groups that lie in each other in it, ``made`` if it is a block without braces."""

    __slots__ = ("open", "start", "stop", "items", "fresh", "height", "made", "_inner")
    kind = text = ""

    def __init__(self, open_: str, start: int, fresh: bool, made: bool = False):
        self.open, self.start, self.stop, self.items, self.fresh, self.height, self.made, self._inner = open_, start, start + 1, [], fresh, 1, made, None

    def inner(self) -> str:
        """Its code as a part of a longer one, marked; blocks are not written out, nor is what is nested very deep (it has nodes of its own)."""
        if self._inner is None:
            body = ("…" if self.items else "") if self.open == "{" or self.height > HEIGHT else code(self.items).translate(MARKED)
            self._inner = " ".join(filter(None, (self.open.translate(MARKED), body, {"(": ")", "[": "]", "{": "}"}[self.open].translate(MARKED))))
        return self._inner


def code(items: list) -> str:
    """Tokens with a blank between them; what is in groups and literals is marked, so that commas are the items' own."""
    return " ".join(x.inner() if isinstance(x, Group) else x.text.translate(MARKED) if x.kind == "s" else x.text for x in items)


def call_code(items: list) -> str:
    """The code of a call, where only its own brackets and the commas between its arguments are plain."""
    last = items[-1]
    return " ".join(filter(None, (code(items[:-1]), last.open, code(last.items), ")" if last.open == "(" else "]")))


def _plain(items: list) -> str:
    return code(items).translate(PLAIN).replace(" ", "")


def tokens(text: str, lang: str) -> list[Token]:
    """Words, numbers, literals and signs without comments; ``fresh`` ones stand first on their line."""
    out: list[Token] = []
    at, seen = 0, -1

    def plain(end: int) -> None:
        nonlocal seen
        for m in _TOKEN.finditer(text, at, end):
            out.append(Token(m[0], m.start(), m.lastgroup, text.find("\n", seen, m.start()) >= 0 if seen >= 0 else True))
            seen = m.end()

    for m in _COMPILED[lang].finditer(text) if lang in _COMPILED else ():
        plain(m.start())
        at = m.end()
        if re.match(r"//|/\*|#", m[0]) and not (lang in ("rust", "cpp", "csharp", "js", "java", "swift", "golang") and m[0][0] == "#"):
            continue
        out.append(Token(m[0], m.start(), "s", text.find("\n", seen, m.start()) >= 0 if seen >= 0 else True))
        seen = m.end()
    plain(len(text))
    return out


def _indented(found: list[Token], text: str) -> Iterator[Token]:
    """Python's tokens with braces around its blocks."""
    depth, levels, colon = 0, [0], False
    for t in found:
        if t.fresh and not depth:
            indent = t.start - text.rfind("\n", 0, t.start) - 1
            if colon and indent > levels[-1]:
                levels.append(indent)
                yield Token("{", t.start, "b", False)
            while indent < levels[-1]:
                levels.pop()
                yield Token("}", t.start, "b", False)
        depth = max(0, depth + (t.text in "([{") - (t.text in ")]}")) if t.kind == "o" else depth
        colon = t.text == ":" and not depth
        yield t
    for _ in levels[1:]:
        yield Token("}", len(text), "b", False)


def _ended(found: list[Token], lang: str) -> Iterator[Token]:
    """Ruby's and Elixir's tokens with braces in place of ``do``, what opens a block, and ``end``."""
    pending, last, head = False, None, None
    for k, t in enumerate(found):
        if t.fresh or last is not None and last.text == ";":
            if pending:
                yield Token("{", t.start, "b", False)
                pending = False
            head = t.text
        word = t.text if t.kind == "w" and (last is None or last.text not in (".", "&.", ":")) else ""
        colon = k + 1 < len(found) and found[k + 1].text == ":" and found[k + 1].start == t.stop
        if word == "end" and not colon:
            yield Token("}", t.stop, "b", False)
        elif word == "do" and not colon:
            pending = False
            yield Token("{", t.start, "b", False)
        elif word == "then" and pending:
            pending = False
            yield Token("{", t.start, "b", False)
        else:
            yield t
            if word in _OPENERS[lang] and not colon and (word == "fn" or word == head or last is not None and last.text in ("=", "private", "public")):
                pending = word != "fn"
                if word == "fn":
                    yield Token("{", t.stop, "b", False)
        last = t


def grouped(text: str, lang: str) -> Group:
    """The text as one block of nested groups; brackets that are missing are supplied."""
    found: list[Token] | Iterator[Token] = tokens(text, lang)
    found = _indented(found, text) if lang == "python" else _ended(found, lang) if lang in _ENDS else found
    root = Group("{", 0, True)
    open_ = [root]
    for t in found:
        if t.kind in "ob" and t.text in ("(", "[", "{"):
            g = Group(t.text, t.start, t.fresh, t.kind == "b")
            open_[-1].items.append(g)
            open_.append(g)
        elif t.kind in "ob" and t.text in _CLOSE:
            k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].open == _CLOSE[t.text]), 0)
            for g in reversed(open_[k:] if k else ()):
                g.height = 1 + max((x.height for x in g.items if isinstance(x, Group)), default=0)
                g.stop = t.stop if t.kind == "o" or lang in _ENDS else (g.items[-1].stop if g.items else t.start)
            del open_[k or len(open_) :]
        else:
            open_[-1].items.append(t)
    for g in reversed(open_):
        g.height = 1 + max((x.height for x in g.items if isinstance(x, Group)), default=0)
        g.stop = len(text)
    return root


class _Parser:
    """Nodes (kind, start, stop, name, code) of a text, in no order."""

    def __init__(self, lang: str):
        self.lang, self.nodes = lang, []
        self.todo: list[Group] = []  # blocks that are still to be read: no recursion into them

    def put(self, kind: str, start: int, stop: int, name: str = "", text: str = "") -> None:
        self.nodes.append((kind, start, stop, name, text))

    def run(self, root: Group) -> list[tuple]:
        self.todo.append(root)
        while self.todo:
            group = self.todo.pop()
            for part in self._statements(group.items):
                self._statement(part)
        return self.nodes

    def _statements(self, items: list) -> Iterator[list]:
        """A block's items cut into statements: at semicolons, after blocks, and where a line neither ends nor begins in the midst of an expression."""
        part: list = []
        for k, x in enumerate(items):
            if part:
                before = part[-1]
                goes_on = x.kind == "o" and x.text not in ("@", "~", "*", "&", "!", "-", "+", "#") or isinstance(x, Group) and x.open in "([" and self.lang in ("js", "java", "cpp", "csharp") or before.kind == "o" and before.text not in (")", "?", "!", "++", "--") or x.text in _FOLLOWS or before.text in ("in", "of", "new", "return", "await", "=", "and", "or", "not", "is")
                if self.lang in ("java", "cpp", "csharp") and not (isinstance(before, Group) and before.open == "{"):
                    goes_on = True
                after_block = isinstance(before, Group) and before.open == "{" and not (x.kind == "o" and x.text in (".", "?.", ",", ")", "?", "as", "||", "&&", "??", "|>", "=>", "=") or isinstance(x, Group) or x.text in _FOLLOWS or x.text == "while" and part[0].text in ("do", "repeat")) and (self.lang not in ("js", "golang", "rust", "swift") or x.fresh or part[0].text in HEADS)
                if self.lang == "python" and isinstance(before, Group) and before.open == "{" and before.items and x.text not in _FOLLOWS and x.fresh:
                    after_block = True
                if after_block or x.fresh and not goes_on:
                    yield part
                    part = []
            if x.kind == "o" and x.text == ";":
                if self.lang == "golang" and part and part[0].text in ("if", "for", "switch", "select") and not any(isinstance(y, Group) and y.open == "{" for y in part):
                    part.append(x)
                    continue
                if part:
                    yield part
                part = []
            else:
                part.append(x)
        if part:
            yield part

    def _head(self, part: list) -> tuple[int, str]:
        """Position and kind of the word that says what a statement is."""
        k = 0
        while k < len(part) - 1 and (part[k].text in _MODIFIERS and part[k].kind == "w" or isinstance(part[k], Group) and part[k].open == "(" and k and part[k - 1].text == "pub" or part[k].text == "@"):
            k += 1 + (part[k].text == "@")
        k = min(k, len(part) - 1)
        after = part[k + 1] if k + 1 < len(part) else None
        named = after is not None and after.kind == "o" and after.text in ("=", ".", ",", ":=", "(")
        if isinstance(after, Group) and part[k].text in ("func", "function", "fn"):  # a function without a name, unless a receiver and a name follow
            named = not (k + 3 < len(part) and part[k + 2].kind == "w" and isinstance(part[k + 3], Group) and part[k + 3].open == "(")
        return k, HEADS.get(part[k].text, "") if part[k].kind == "w" and not named else ""

    def _statement(self, part: list) -> None:
        k, kind = self._head(part)
        start, stop = part[0].start, part[-1].stop
        blocks = [n for n, x in enumerate(part) if isinstance(x, Group) and x.open == "{"]
        first = blocks[0] if blocks else len(part)
        if not kind and self.lang in ("java", "cpp", "csharp", "js") and blocks and any(isinstance(x, Group) and x.open == "(" for x in part[1:first]) and not any(x.kind == "o" and x.text in ("=", "=>", "?", "return") or x.text in ("new", "return") for x in part[:first]):
            kind = "function"
        header = code(part[:first])
        self.put(kind or "statement", start, stop, self._name(part, k, kind), header if kind else code(part))
        if kind and any(x.text == "async" for x in part[:k]):
            self.put("async", start, stop, "", header)
        if kind in ("if", "loop", "switch") and k + 1 < first:
            inside = part[k + 1 : first - (part[first - 1].text == ":" and first > k + 2)]
            self.put("condition", inside[0].start, inside[-1].stop, "", code(inside[0].items if len(inside) == 1 and isinstance(inside[0], Group) else inside))
        at = 0
        for n in blocks:  # parts of a chain: else, catch, finally
            words = [m for m in range(at, n) if part[m].kind == "w" and part[m].text in _FOLLOWS]
            if words and n != first:
                self.put(HEADS[part[words[0]].text], part[words[0]].start, part[n].stop, "", code(part[words[0] : n]))
            at = n + 1
        if kind != "function" and any(x.kind == "o" and _ASSIGN.fullmatch(x.text) for x in part):
            n = next(n for n, x in enumerate(part) if x.kind == "o" and _ASSIGN.fullmatch(x.text))
            left = part[next((m for m in range(n) if part[m].kind == "w" and part[m].text not in _KEYWORDS and part[m].text not in _MODIFIERS), 0) : n]
            self.put("assignment", start, stop, _plain(left), code(part).translate(MARKED))
        self._expression(part, kind in ("function", "class"))

    def _name(self, part: list, k: int, kind: str) -> str:
        if kind not in ("function", "class"):
            return ""
        words = [x.text for x in part[k + (part[k].text in HEADS) :] if x.kind == "w" and x.text not in _KEYWORDS]
        if part[k].text in HEADS and HEADS[part[k].text] == kind:
            return words[0] if words else ""
        before = next((n for n, x in enumerate(part) if isinstance(x, Group) and x.open == "("), 0)
        return part[before - 1].text if before else ""

    def _expression(self, part: list, declares: bool = False) -> None:
        """Calls, objects, closures and what waits, in one run of items; what is in groups comes after."""
        chain = wait = made = None
        inner: list[tuple[list, bool]] = [(part, declares)]
        while inner:
            part, declares = inner.pop()
            chain = wait = made = None
            self._runs(part)
            for k, x in enumerate(part):
                before = part[k - 1] if k else None
                joined = before is not None and before.kind == "o" and before.text in _JOINS and chain is not None
                if isinstance(x, Group):
                    if x.open == "{":
                        self._block(part, k)
                    elif x.items:
                        inner.append((x.items, False))
                    if chain is not None and x.open in "([" and (not x.fresh or self.lang != "golang"):
                        if x.open == "(" and not declares:
                            self.put("call", part[chain].start, x.stop, _plain(part[chain:k]), call_code(part[chain : k + 1]))
                            if made is not None:
                                self.put("new", part[made].start, x.stop, _plain(part[made + 1 : k]), call_code(part[made : k + 1]))
                                made = None
                        declares = declares and x.open != "("
                    elif chain is None or x.open == "{":
                        chain = None if x.open == "{" else k
                elif x.kind == "w" and (x.text not in _KEYWORDS or joined):
                    if not joined:
                        chain = k
                    elif x.text == "await":
                        self.put("await", part[chain].start, x.stop, "", code(part[chain : k + 1]))
                elif x.kind in "ns":
                    chain = k
                elif x.kind == "o" and (x.text in _JOINS or x.text in ("!", "?") and before is not None and before.stop == x.start and chain is not None):
                    pass
                else:
                    chain = None
                    if x.text in ("=>", "->") and k and self.lang in ("js", "java", "csharp", "swift") or x.text == "lambda":
                        self._closure(part, k)
                    elif x.text in ("|", "||") and self.lang == "rust" and (before is None or before.text == "move" or before.kind == "o" and before.text in ("=", "(", ",", "=>")):
                        self._closure(part, k)
                if wait is not None and chain is None and k > wait + 1:
                    self.put("await", part[wait].start, part[k - 1].stop, "", code(part[wait:k]))
                    wait = None
                if x.kind == "w" and x.text == "await" and not joined:
                    wait = k
                elif x.kind == "w" and x.text == "new":
                    made = k
            if wait is not None and len(part) > wait + 1:
                self.put("await", part[wait].start, part[-1].stop, "", code(part[wait:]))

    def _runs(self, part: list) -> None:
        """Conjunctions and choices by ``?``: each from what stands in front of it to the next comma or the end."""
        first, found = 0, {}
        for k, x in enumerate([*part, None]):
            if x is None or x.kind == "o" and (x.text in (",", ";", "=>") or _ASSIGN.fullmatch(x.text)) or x.kind == "w" and x.text in _KEYWORDS and x.text not in ("and", "or", "not", "is", "in", "new", "await", "of"):
                for kind, at in found.items():
                    if k - 1 > at:
                        self.put(kind, part[first].start, part[k - 1].stop, "", code(part[first:at] if kind == "ternary" else part[first:k]))
                first, found = k + 1, {}
            elif x.text in ("&&", "and"):
                found.setdefault("and", k)
            elif x.kind == "o" and x.text == "?" and self.lang not in ("python", "rust", "golang", "elixir") and k > first and (part[k - 1].stop < x.start or isinstance(part[k - 1], Group)):
                found.setdefault("ternary", k)

    def _closure(self, part: list, k: int) -> None:
        """A function without a name, from its parameters to the end of its body."""
        first = k
        if part[k].text in ("=>", "->"):
            first = max(0, k - 1)
            if first and part[first - 1].text == "async":
                first -= 1
        end = next((n for n in range(k + 1, len(part)) if part[n].kind == "o" and part[n].text in (",", ";") or isinstance(part[n], Group) and part[n].open == "{"), len(part))
        stop = part[end].stop if end < len(part) and isinstance(part[end], Group) else part[min(end, len(part)) - 1].stop
        self.put("closure", part[first].start, stop, "", code(part[first : k + 1]))

    def _block(self, part: list, k: int) -> None:
        """A block is a body, a closure or an object; its statements are read later."""
        group, before = part[k], part[k - 1] if k else None
        head = part[max(0, k - 8) : k]
        kind = "block"
        if not group.made and (before is None or before.text == "return" or before.kind == "o" and before.text in ("=", ",", ":", "?", "(", "[", "&&", "||", "??", "+")):
            kind = "closure" if self.lang == "swift" else "object"
        elif self.lang in ("golang", "js") and isinstance(before, Group) and (first := next((n for n in range(k - 1, -1, -1) if part[n].text in ("func", "function")), -1)) >= 0 and (any(x.text not in _MODIFIERS for x in part[:first]) or isinstance(part[first + 1], Group) and not (part[first + 2].kind == "w" and part[first + 3] is not group)):
            self.put("closure", part[first].start, group.stop, "", code(part[first:k]))
        elif self.lang == "cpp" and any(isinstance(x, Group) and x.open == "[" for x in head) and any(x.text in ("=", ",", "return") for x in head[:1]):
            kind = "closure"
        elif self.lang in ("swift", "ruby") and part[0].text not in HEADS and isinstance(before, (Group, Token)) or self.lang in _ENDS and before is not None and before.text == "fn":
            kind = "closure"
        if before is not None and before.text in ("async", "move") and any(x.text == "async" for x in head):
            self.put("async", next(x for x in reversed(head) if x.text == "async").start, group.stop)
        if before is not None and before.text == "unsafe":
            self.put("unsafe", before.start, group.stop)
        self.put(kind, group.start, group.stop, "", group.inner())
        self.todo.append(group)


def parse(text: str, lang: str) -> list[tuple]:
    """``(pre, post, parent, scope, kind, name, s_line, s_col, e_line, e_col, code, leaves)`` of each node, the file itself first.

    Any string has nodes: what is no code of the language gives statements. ``code`` is the tokens with blanks between;
    of what has blocks it is the part in front of them. Nodes that cover the same text lie in each other in the order
    statement, assignment, expression.
    """
    order = {"assignment": 1, "condition": 1, "ternary": 2, "and": 3, "await": 4, "new": 5, "call": 6}
    found = [(0, -len(text) - 1, -1, "file", "", "")] + [(start, -stop, order.get(kind, 0), kind, name, text_) for kind, start, stop, name, text_ in _Parser(lang).run(grouped(text, lang))]
    found.sort(key=lambda x: x[:3])
    lines, clock, open_ = Lines(text), 0, []
    rows: list[list] = []
    for start, minus, _, kind, name, text_ in found:
        while open_ and rows[open_[-1]][-1] <= start:
            clock += 1
            rows[open_.pop()][1] = clock
        clock += 1
        stop = min(-minus, rows[open_[-1]][-1]) if open_ else -minus  # a node never reaches beyond the one around it
        around = rows[open_[-1]] if open_ else None
        scope = (around[0] if around[4] in ("function", "closure", "file") else around[3]) if around else None
        rows.append([clock, 0, around[0] if around else None, scope, kind, name, *lines.at(start), *lines.at(max(start, min(stop, len(text)) - 1)), text_, False, stop])
        open_.append(len(rows) - 1)
    while open_:
        clock += 1
        rows[open_.pop()][1] = clock
    _mark_leaving(rows)
    return [tuple(x[:-1]) for x in rows]


#: Calls that do not come back; fixed values.
_STOPS = re.compile(r"(?:^|\.)(?:exit|abort|panic!|fatalError|preconditionFailure|todo!|unreachable!|unimplemented!|_exit|Fatal|Fatalf|Exit)$")


def _mark_leaving(rows: list[list]) -> None:
    """Set ``leaves``, from the innermost nodes outwards: a block leaves if one of its statements does, a branching one if all its branches do and one is always taken."""
    by = {row[0]: row for row in rows}
    blocks: dict[int, list[bool]] = {}
    other: set[int] = set()
    for row in reversed(rows):
        kind, parent = row[4], row[2]
        inside = blocks.pop(row[0], [])
        if kind in ("return", "throw") or kind == "statement" and re.match(r"(?:break|continue)\b", row[10]):
            row[11] = True
        elif kind in ("block", "else", "catch", "statement", "with"):
            row[11] = any(inside)
        elif kind == "if":
            row[11] = row[0] in other and bool(inside) and all(inside)
        elif kind == "try":
            row[11] = bool(inside) and all(inside)
        elif kind == "call":
            row[11] = bool(_STOPS.search(row[5]))
        if parent is None:
            continue
        around = by[parent][4]
        if kind == "else" and around == "if" and not re.match(r"(?:else if|elif|elsif)\b", row[10]):
            other.add(parent)
        if around in ("if", "try"):
            if kind in ("block", "else", "catch"):
                blocks.setdefault(parent, []).append(row[11])
        elif row[11] and around not in ("closure", "loop", "switch", "function"):
            blocks.setdefault(parent, []).append(True)


def syntax_nodes(files: DataFrame) -> DataFrame:
    """NODES of ``files(path, lang, text)``, each file read alone; null texts have none."""

    def nodes(path: str, lang: str, text: str | None) -> Iterator[tuple]:
        return ((path, lang, *node) for node in (parse(text, lang) if isinstance(text, str) else ()))

    return by_file(files, ["path", "lang", "text"], nodes, NODES, {"parent": "Int32", "scope": "Int32"})

"""Regular expressions in source texts that can take exponential time, told from their structure.

A backtracking matcher is exponential where a loop can read one text in two ways. Each pattern becomes an automaton with a state for each of its
characters (Glushkov's), whose edges are counted: a loop's edge that is there twice, or two different states that one text leads to from one
state and back (a path of the product automaton), is such a loop. Patterns are found on the JVM, and each distinct one is judged once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import step

_parser = re._parser  # the standard library's own reading of a pattern
_OTHER = 1 << 128  # all characters beyond ASCII are alike
_EVERY = (1 << 129) - 1
#: A repetition that may go on as long as this is a loop.
MANY = 16
#: Where patterns stand in a line, with the pattern in group 1, by language; fixed values.
PLACES = {
    "python": r"""\bre\.(?:compile|match|search|fullmatch|sub|subn|split|findall|finditer)\(\s*[rR]?(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)')""",
    "js": r"""(?:\bRegExp\(\s*(?:"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)')|(?:^|[=(,:\[!&|?{};\s])/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[*\s])(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*)/[a-z]*)""",
    "java": r"""\b(?:Pattern\.compile|matches|replaceAll|replaceFirst|split)\(\s*"((?:\\.|[^"\\])*)\"""",
    "csharp": r"""\bRegex(?:\.\w+)?\([^"]*@?"((?:\\.|[^"\\])*)\"""",
    "ruby": r"""(?:=~\s*|\(|=\s*)/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])+)/""",
}
#: What a text has in which one may stand.
HINTS = {"python": r"\bre\.", "js": r"RegExp|(?m)(?:^|[=(,:\[!&|?{};])\s*/[^/*\s]", "java": r"Pattern|matches\(|replaceAll|replaceFirst|split\(", "csharp": r"Regex", "ruby": r"[=(~]\s*/"}
_CATEGORIES = {"digit": "0123456789", "space": " \t\n\r\f\v", "word": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


def _bit(code: int) -> int:
    return 1 << code if code < 128 else _OTHER


def _category(name: str) -> int:
    kind = name.lower().rpartition("_")[2]
    found = sum(_bit(ord(c)) for c in _CATEGORIES.get(kind, "")) | (_OTHER if kind == "word" else 0)
    return _EVERY & ~found | _OTHER if "NOT" in name else found


def _class(items: list) -> int:
    found, negated = 0, False
    for op, value in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            found |= _bit(value)
        elif name == "RANGE":
            low, high = value
            found |= sum(1 << c for c in range(low, min(high, 127) + 1)) | (_OTHER if high > 127 else 0)
        elif name == "CATEGORY":
            found |= _category(str(value))
    return (_EVERY & ~found) | _OTHER if negated else found


class _Positions:
    """The characters of a pattern as states, and how often each may follow another."""

    def __init__(self) -> None:
        self.sets: list[int] = []
        self.follow: Counter[tuple[int, int]] = Counter()

    def one(self, found: int) -> tuple[bool, list[int], list[int]]:
        self.sets.append(found)
        return False, [len(self.sets) - 1], [len(self.sets) - 1]

    def sequence(self, items: Iterator) -> tuple[bool, list[int], list[int]]:
        empty, first, last = True, [], []
        for item in items:
            e, f, la = self.item(*item)
            for p in last:
                for q in f:
                    self.follow[p, q] += 1
            first = first + f if empty else first
            last = last + la if e else la
            empty = empty and e
        return empty, first, last

    def item(self, op: object, value: object) -> tuple[bool, list[int], list[int]]:
        name = str(op)
        if name == "LITERAL":
            return self.one(_bit(value))
        if name == "NOT_LITERAL":
            return self.one(_EVERY & ~_bit(value) | _OTHER)
        if name == "ANY":
            return self.one(_EVERY & ~_bit(10))
        if name == "IN":
            return self.one(_class(value))
        if name == "BRANCH":
            parts = [self.sequence(x) for x in value[1]]
            return any(e for e, _, _ in parts), [p for _, f, _ in parts for p in f], [p for _, _, la in parts for p in la]
        if name == "SUBPATTERN":
            return self.sequence(value[3])
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            e, f, la = self.sequence(body)
            if int(high) >= MANY:
                for p in la:
                    for q in f:
                        self.follow[p, q] += 1
            return e or low == 0, f, la
        return True, [], []  # anchors and look-arounds read nothing; possessive and atomic parts do not go back


def _components(n: int, edges: dict[int, list[int]]) -> list[int]:
    """The strongly connected component of each node, by Tarjan's algorithm without recursion."""
    index, low, of, stack, on, count = [-1] * n, [0] * n, [-1] * n, [], [False] * n, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, iter(edges.get(root, ())))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            node, rest = work[-1]
            step = next((q for q in rest if index[q] < 0 or on[q]), None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    while True:
                        q = stack.pop()
                        on[q] = False
                        of[q] = node
                        if q == node:
                            break
            elif index[step] < 0:
                index[step] = low[step] = count
                count += 1
                stack.append(step)
                on[step] = True
                work.append((step, iter(edges.get(step, ()))))
            else:
                low[node] = min(low[node], index[step])
    return of


def ambiguous(pattern: str | None) -> bool | None:
    """Whether a loop of the pattern can read one text in two ways; None for what is no pattern."""
    try:
        tree = _parser.parse(pattern) if isinstance(pattern, str) else None
    except (re.error, OverflowError, RecursionError, ValueError):
        return None
    if tree is None:
        return None
    states = _Positions()
    try:
        states.sequence(tree)
    except RecursionError:
        return None
    edges: dict[int, list[int]] = {}
    for p, q in states.follow:
        edges.setdefault(p, []).append(q)
    of = _components(len(states.sets), edges)
    inside = {(p, q): n for (p, q), n in states.follow.items() if of[p] == of[q]}
    if any(n > 1 for n in inside.values()):
        return True
    within: dict[int, list[int]] = {}
    for p, q in inside:
        within.setdefault(p, []).append(q)

    def reached(ways: dict[int, list[int]], forward: bool) -> set[tuple[int, int]]:
        seen = {(p, p) for p in ways}
        todo = list(seen)
        while todo:
            p, r = todo.pop()
            for q in ways.get(p, ()):
                for s in ways.get(r, ()):
                    # Going forward, a step reads a character of the states that it enters; going back, of those that it leaves.
                    if (states.sets[q] & states.sets[s] if forward else states.sets[p] & states.sets[r]) and (q, s) not in seen:
                        seen.add((q, s))
                        todo.append((q, s))
        return seen

    back: dict[int, list[int]] = {}
    for p, q in inside:
        back.setdefault(q, []).append(p)
    return any(p != r for p, r in reached(within, True) & reached(back, False))


def pattern_literals(lines: DataFrame) -> DataFrame:
    """``(path, lang, line_no, pattern)`` of the regular expressions written in ``lines(path, lang, line_no, line)``."""
    every = []
    for lang, place in PLACES.items():
        groups = re.compile(place).groups
        every.append(F.when(F.col("lang") == lang, F.array_compact(F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(place), F.lit(k)) for k in range(1, groups + 1)])))))
    found = lines.where(F.col("lang").isin(*PLACES) & F.col("line").rlike(r"\bre\.|RegExp|/|Pattern|matches|replace|split|Regex")).select("path", "lang", "line_no", F.explode(F.array_distinct(F.coalesce(*every))).alias("raw")).where("raw <> ''")
    doubled = F.col("lang").isin("java", "csharp") | (F.col("lang") == "js") & F.col("raw").contains("\\\\")
    return found.select("path", "lang", "line_no", F.when(doubled, F.replace("raw", F.lit("\\\\"), F.lit("\\"))).otherwise(F.col("raw")).alias("pattern"))


def with_patterns(files: DataFrame) -> DataFrame:
    """Files of ``files(path, lang, text)`` in which a pattern may be written."""
    return files.where(reduce(lambda a, b: a | b, [(F.col("lang") == lang) & F.col("text").rlike(hint) for lang, hint in HINTS.items()]))


def exponential_patterns(lines: DataFrame) -> DataFrame:
    """``(path, lang, line_no, pattern)`` of those that a backtracking matcher may take exponential time for; each distinct one is judged once."""
    found = step(pattern_literals(lines))  # read twice

    @F.pandas_udf("boolean")
    def judged(patterns: pd.Series) -> pd.Series:
        return pd.Series([bool(ambiguous(x)) for x in patterns])

    bad = found.select("pattern").distinct().where(judged("pattern"))
    return found.join(bad, "pattern", "left_semi").select("path", "lang", "line_no", "pattern")

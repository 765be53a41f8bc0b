"""Functions over whole source texts that columns cannot express: masking, block regions, structural matches."""

from __future__ import annotations

import ast
import json
import plistlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MATCHES, REGIONS
from ..sources.steps import bound_batches, by_file

_C_LIKE = r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
#: What is blanked in each language: comments and literals; fixed values.
MASKS = {
    "js": _C_LIKE + r"|`(?:\\.|[^`\\])*`?",
    "golang": _C_LIKE + r"|`[^`]*`?",
    "rust": r"""//[^\n]*|/\*.*?(?:\*/|\Z)|r(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"?|'(?:\\.[^']*|[^'\\\n])'""",
    "java": r'"""(?:\\.|[^\\])*?"""|' + _C_LIKE,
    "swift": r'"""(?:\\.|[^\\])*?"""|' + _C_LIKE,
    "csharp": r'@"(?:[^"]|"")*"|' + _C_LIKE,
    "cpp": _C_LIKE,
    "python": r'''[rRbBfFuU]{0,2}("""|\'\'\')(?:\\.|[^\\])*?(?:\1|\Z)|[rRbBfFuU]{0,2}"(?:\\.|[^"\\\n])*"?|[rRbBfFuU]{0,2}'(?:\\.|[^'\\\n])*'?|#[^\n]*''',
    "ruby": r'''"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|#(?!\{)[^\n]*''',
    "elixir": r'''"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\])*"?|#(?!\{)[^\n]*''',
}
_COMPILED = {lang: re.compile(p, re.S) for lang, p in MASKS.items()}
_BLANK = re.compile(r"[^\n]")


def masked(text: str | None, lang: str | None) -> str | None:
    """The text with comments and literals blanked; line breaks and offsets stay."""
    if text is None or lang not in _COMPILED:
        return text
    return _COMPILED[lang].sub(lambda m: _BLANK.sub(" ", m[0]), text)


def mask_column(text: str = "text", lang: str = "lang"):
    """``masked`` as a column, in Arrow batches."""

    if (spark := SparkSession.getActiveSession()) is not None:
        bound_batches(spark)

    @F.pandas_udf("string")
    def apply(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([masked(t if isinstance(t, str) else None, x) for t, x in zip(texts, langs, strict=True)], dtype=object)

    return apply(F.col(text), F.col(lang))


class Lines:
    """Line and column, both from 1, of offsets in a text."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> tuple[int, int]:
        n = bisect_right(self.starts, offset)
        return n, offset - self.starts[n - 1] + 1


_HEADER = re.compile(r"[;{}]")
#: Kinds of blocks by what stands in front of them, first match first; fixed values.
KINDS = (
    ("test", r"#\[(cfg\(test\)|test)\]"), ("async", r"\basync\b"), ("closure", r"(\|[^|]*\||=>|\bfunc\s*\([^)]*\)[^=]*)\s*$"), ("loop", r"^\s*('\w+\s*:\s*)?(for|while|loop|foreach|do|repeat)\b"), ("drop", r"\bimpl\b.*\bDrop\s+for\b"),
    ("guard", r"^\s*guard\b"), ("if", r"\bif\b"), ("else", r"^\s*else\b"), ("try", r"^\s*(try|do)\b"), ("catch", r"\bcatch\b"), ("function", r"\b(fn|func|function|def)\b|\)\s*(const|throws[\w\s,]*)?\s*$"),
)
_KINDS = tuple((k, re.compile(p, re.S)) for k, p in KINDS)


def brace_regions(text: str, lang: str) -> list[tuple]:
    """(kind, s_line, s_col, e_line, e_col, header) of each block in braces; an open block ends with the text."""
    plain, lines, open_, out = masked(text, lang), Lines(text), [], []
    last = 0
    for m in _HEADER.finditer(plain):
        if m[0] == "{":
            header = plain[last : m.start()]
            open_.append((m.start(), header))
        elif m[0] == "}" and open_:
            out.append((*open_.pop(), m.start()))
        last = m.end()
    out += [(a, h, max(a, len(text) - 1)) for a, h in open_]
    found = []
    for a, header, b in sorted(out):
        kind = next((k for k, p in _KINDS if p.search(header)), "block")
        found.append((kind, *lines.at(a), *lines.at(b), " ".join(header.split())))
    return found


def python_regions(text: str) -> list[tuple]:
    """The same for Python's compound statements; nothing for what does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.If: "if", ast.Try: "try", ast.ExceptHandler: "catch", ast.FunctionDef: "function", ast.AsyncFunctionDef: "async", ast.Lambda: "closure", ast.With: "with", ast.AsyncWith: "with", ast.ClassDef: "class"}
    lines = text.splitlines()
    return sorted((kinds[type(n)], n.lineno, n.col_offset + 1, n.end_lineno, n.end_col_offset, lines[n.lineno - 1].strip()) for n in ast.walk(tree) if type(n) in kinds)


def regions(files: DataFrame) -> DataFrame:
    """REGIONS of ``files(path, lang, text)``: blocks with their kind and header. Each file is read alone."""

    def blocks(path: str, lang: str, text: str | None) -> list[tuple]:
        return [(path, *r) for r in (python_regions(text) if lang == "python" else brace_regions(text, lang))] if isinstance(text, str) else []

    return by_file(files, ["path", "lang", "text"], blocks, REGIONS)


def _statement_spans(text: str, lang: str) -> Iterator[tuple[int, int]]:
    """First and last line of each statement over several lines: Python's by its syntax, others' by open parentheses and brackets."""
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        yield from ((n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, ast.stmt) and not hasattr(n, "body") and n.end_lineno > n.lineno)
        return
    depth, first = 0, 0
    for n, line in enumerate(masked(text, lang).split("\n"), 1):
        if depth == 0:
            first = n
        depth = max(0, depth + line.count("(") + line.count("[") - line.count(")") - line.count("]"))
        if depth == 0 and n > first:
            yield first, n


def statements(files: DataFrame) -> DataFrame:
    """``(path, s_line, e_line)`` of the statements of ``files(path, lang, text)`` that go over several lines."""

    def spans(path: str, lang: str, text: str | None) -> Iterator[tuple]:
        return ((path, *span) for span in (_statement_spans(text, lang) if isinstance(text, str) else ()))

    return by_file(files, ["path", "lang", "text"], spans, "path string, s_line int, e_line int")


def regex_matches(files: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """MATCHES of ``patterns`` (rule_id: language, pattern) in the masked texts; named groups are the captures.

    Code and captures are taken from the text itself, so literals show.
    """

    compiled = {k: (lang, re.compile(p, re.M)) for k, (lang, p) in patterns.items()}

    def found(path: str, lang: str, text: str | None) -> Iterator[tuple]:
        if not isinstance(text, str):
            return
        plain, lines = masked(text, lang), Lines(text)
        for rule, (of, pattern) in compiled.items():
            if of != lang:
                continue
            for m in pattern.finditer(plain):
                captures = {k: dict(zip(("text", "s_line", "s_col"), (text[m.start(k) : m.end(k)], *lines.at(m.start(k))), strict=True)) for k, v in m.groupdict().items() if v is not None}
                yield rule, path, *lines.at(m.start()), *lines.at(max(m.start(), m.end() - 1)), text[m.start() : m.end()], captures

    # Texts of other languages do not leave the JVM.
    return by_file(files.where(F.col("lang").isin(*sorted({lang for lang, _ in patterns.values()}))), ["path", "lang", "text"], found, MATCHES)


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def python_matches(files: DataFrame, depth: int = 4) -> DataFrame:
    """MATCHES over Python's syntax: attribute chains of ``depth`` or more, divisions, identity with literals, comparisons with None, bare handlers, handlers that pass, returns in finally, mutated loops, unguarded json.loads."""

    def found(path: str, text: str | None) -> Iterator[tuple]:
        return ((rule, path, *where) for rule, *where in (_python_rows(text, depth) if isinstance(text, str) else ()))

    return by_file(files.where("lang = 'python'"), ["path", "text"], found, MATCHES)


def _python_rows(text: str, depth: int) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return

    raw = [x.encode() for x in re.split(r"\r\n|\n|\r", text)]  # split once: offsets of the syntax tree are bytes of a line

    def segment(node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return raw[first][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        return b"\n".join([raw[first][node.col_offset :], *raw[first + 1 : last], raw[last][: node.end_col_offset]]).decode("utf-8", "replace")

    def row(rule: str, node: ast.AST, **captures: ast.AST) -> tuple:
        found = {k: {"text": segment(v), "s_line": v.lineno, "s_col": v.col_offset + 1} for k, v in captures.items()}
        return (rule, node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset, segment(node), found)

    inner: set[int] = set()
    guarded: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute):
            chain, n, at = node, 1, node.value
            while isinstance(at, ast.Attribute):
                inner.add(id(at))
                n, at = n + 1, at.value
            if n >= depth and id(chain) not in inner:
                yield row("py.deep_access", node, BASE=at)
        elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Div, ast.FloorDiv)):
            yield row("py.division", node, R=node.right)
        elif isinstance(node, ast.Compare):
            for op, side in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, (ast.Is, ast.IsNot)) and isinstance(side, ast.Constant) and side.value is not None and side.value is not True and side.value is not False and side.value is not Ellipsis:
                    yield row("py.is_literal", node, R=side)
                if isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(side, ast.Constant) and side.value is None:
                    yield row("py.eq_none", node, R=side)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            guarded |= {id(x) for s in node.body for x in ast.walk(s)} if node.handlers else set()
            for handler in node.handlers:
                if handler.type is None:
                    yield row("py.bare_except", handler)
                if all(isinstance(s, ast.Pass) for s in handler.body):
                    yield row("py.except_pass", handler)
            for s in node.finalbody:
                if isinstance(s, (ast.Return, ast.Break, ast.Continue)):
                    yield row("py.finally_exit", s)
        elif isinstance(node, ast.For):
            over = _dotted(node.iter)
            for x in (x for s in node.body for x in ast.walk(s)) if over else ():
                if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("append", "remove", "pop", "insert", "clear", "extend", "add", "discard") and _dotted(x.func.value) == over:
                    yield row("py.mutated_loop", x)
        elif isinstance(node, ast.Call) and _dotted(node.func) == "json.loads" and id(node) not in guarded:
            yield row("py.json_unguarded", node)


def ingest_matches(lines: DataFrame, value: str = "value") -> DataFrame:
    """MATCHES from JSON text, one match a line: bad lines are skipped, 0-based positions count from 1."""
    from ..schemas import MATCH_JSON

    one = lambda p, k: F.coalesce(p["line"], p["row"]) + 1 if k == "line" else p["column"] + 1
    j = lines.select(F.from_json(value, MATCH_JSON, {"mode": "PERMISSIVE"}).alias("j")).where("j IS NOT NULL AND coalesce(j.file, j.path) IS NOT NULL").select("j.*")
    captures = F.map_from_entries(F.transform(F.map_entries(F.coalesce(F.col("metaVariables.single"), F.create_map().cast("map<string,struct<text:string,range:struct<start:struct<line:int,row:int,column:int>,end:struct<line:int,row:int,column:int>>>>"))), lambda e: F.struct(e["key"], F.struct(e["value"]["text"].alias("text"), one(e["value"]["range"]["start"], "line").alias("s_line"), one(e["value"]["range"]["start"], "column").alias("s_col")).alias("value"))))
    s, e = F.col("range.start"), F.col("range.end")
    return j.select(F.coalesce("ruleId", "rule_id").alias("rule_id"), F.coalesce("file", "path").alias("path"), one(s, "line").alias("s_line"), one(s, "column").alias("s_col"), one(e, "line").alias("e_line"), one(e, "column").alias("e_col"), F.coalesce("text", "lines").alias("code"), captures.alias("captures"))


def plist_settings(files: DataFrame) -> DataFrame:
    """``(path, key, value)`` of property lists: nested keys joined by dots, values as JSON; unreadable files give nothing."""

    def flat(prefix: str, value) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from flat(f"{prefix}.{k}" if prefix else str(k), v)
        else:
            yield prefix, json.dumps(value, default=str)

    def settings(path: str, text: str | None) -> list[tuple]:
        try:
            return [(path, *x) for x in flat("", plistlib.loads((text or "").encode()))]
        except Exception:  # noqa: BLE001  plistlib raises what its parsers raise
            return []

    return by_file(files.where(F.lower("path").rlike(r"\.(plist|entitlements|xcprivacy)$")), ["path", "text"], settings, "path string, key string, value string")

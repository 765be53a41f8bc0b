"""Named resources that are never released, asynchronous calls nobody waits for."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.source import Lines, masked
from ..sources.steps import by_file

ISSUES = "path string, lang string, line_no int, kind string, name string, message string"

#: (kind, acquisition with the group name, release of that name; {n} stands for it), by language; fixed values.
RESOURCES: dict[str, list[tuple[str, str, str]]] = {
    "golang": [("file", r"\b(?P<name>\w+)\s*,\s*\w+\s*:?=\s*os\.(?:Open|Create|OpenFile)\(", r"\b{n}\.Close\("), ("context", r"\w+\s*,\s*(?P<name>\w+)\s*:?=\s*context\.With(?:Cancel|Timeout|Deadline)\(", r"\b{n}\s*\("), ("ticker", r"\b(?P<name>\w+)\s*:?=\s*time\.NewTicker\(", r"\b{n}\.Stop\("), ("timer", r"\b(?P<name>\w+)\s*:?=\s*time\.NewTimer\(", r"\b{n}\.Stop\("), ("database", r"\b(?P<name>\w+)\s*,\s*\w+\s*:?=\s*sql\.Open\(", r"\b{n}\.Close\("), ("listener", r"\b(?P<name>\w+)\s*,\s*\w+\s*:?=\s*net\.Listen\(", r"\b{n}\.Close\("), ("mutex", r"\b(?P<name>[\w.]+)\.R?Lock\(\)", r"\b{n}\.R?Unlock\(\)")],
    "java": [("stream", r"\b(?P<name>\w+)\s*=\s*new\s+\w*(?:Stream|Reader|Writer|Scanner|Socket)\(", r"\b{n}\.close\(|try\s*\([^)]*\b{n}\b"), ("connection", r"\b(?P<name>\w+)\s*=\s*\w+\.(?:getConnection|openConnection|prepareStatement|createStatement)\(", r"\b{n}\.close\(|try\s*\([^)]*\b{n}\b"), ("executor", r"\b(?P<name>\w+)\s*=\s*Executors\.new\w+\(", r"\b{n}\.(?:shutdown|shutdownNow|close)\(")],
    "cpp": [("thread", r"\bstd::thread\s+(?P<name>\w+)\s*[({]", r"\b{n}\.(?:join|detach)\("), ("memory", r"\b(?P<name>\w+)\s*=\s*(?:\([^)]*\)\s*|static_cast<[^>]*>\()?(?:malloc|calloc|realloc)\(", r"\bfree\s*\(\s*{n}\b"), ("file", r"\b(?P<name>\w+)\s*=\s*fopen\(", r"\bfclose\s*\(\s*{n}\b")],
    "csharp": [("disposable", r"^(?!.*\busing\b).*?\b(?P<name>\w+)\s*=\s*new\s+(?:CancellationTokenSource|\w*Stream(?:Reader|Writer)?|HttpClient|HttpRequestMessage|Timer|SemaphoreSlim)\(", r"\b{n}\??\.(?:Dispose|DisposeAsync|Close)\(|using\s*\(\s*{n}\b|return\s+{n}\b"), ("task", r"^\s*(?P<name>_)\s*=\s*(?:Task\.Run|\w+Async)\(", r"(?!)")],
    "ruby": [("file", r"\b(?P<name>\w+)\s*=\s*File\.(?:open|new)\((?!.*(?:\bdo\b|\{\s*\|))", r"\b{n}\.close\b"), ("thread", r"\b(?P<name>\w+)\s*=\s*Thread\.new\b", r"\b{n}\.(?:join|value)\b"), ("session", r"\b(?P<name>\w+)\s*=\s*Net::HTTP\.start\((?!.*\bdo\b)", r"\b{n}\.finish\b")],
    "swift": [("timer", r"\b(?P<name>\w+)\s*=\s*Timer\.scheduledTimer\(", r"\b{n}\??\.invalidate\("), ("task", r"\b(?P<name>\w+)\s*=\s*Task\s*\{", r"\b{n}\??\.(?:cancel|value|result)\b"), ("handle", r"\b(?P<name>\w+)\s*=\s*(?:try\??\s+)?FileHandle\(", r"\b{n}\??\.close\("), ("observer", r"\b(?P<name>\w+)\s*=\s*\w+(?:\.\w+)*\.addObserver\(", r"\.removeObserver\(\s*{n}\b")],
    "js": [("interval", r"\b(?P<name>\w+)\s*=\s*setInterval\(", r"\bclearInterval\s*\(\s*(?:this\.)?{n}\b"), ("observer", r"\b(?P<name>\w+)\s*=\s*new\s+(?:Mutation|Intersection|Resize)Observer\(", r"\b{n}\.disconnect\("), ("socket", r"\b(?P<name>\w+)\s*=\s*new\s+WebSocket\(", r"\b{n}\.close\(")],
    "rust": [("thread", r"\blet\s+(?:mut\s+)?(?P<name>\w+)\s*=\s*(?:std::)?thread::spawn\(", r"\b{n}\.join\("), ("task", r"\blet\s+(?:mut\s+)?(?P<name>\w+)\s*=\s*tokio::spawn\(", r"\b{n}\.(?:await|abort)|\bawait\s+{n}\b|join!\([^)]*\b{n}\b|\({n}\b")],
    "elixir": [("file", r"\{:ok,\s*(?P<name>\w+)\}\s*=\s*File\.open\(", r"File\.close\s*\(\s*{n}\b"), ("task", r"\b(?P<name>\w+)\s*=\s*Task\.async\(", r"Task\.(?:await|yield|shutdown)\w*\s*\(\s*{n}\b|{n}\s*\|>\s*Task\.")],
}


def unreleased(text: str, lang: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, name, message) of acquisitions whose name is not released behind them, in order."""
    if lang == "python":
        return _python_unreleased(text)
    plain, lines, out = masked(text, lang), Lines(text), []
    for kind, acquire, release in RESOURCES.get(lang, ()):
        for m in re.finditer(acquire, plain, re.M):
            name = m["name"]
            if not re.search(release.replace("{n}", re.escape(name)), plain[m.end() :]):
                out.append((lines.at(m.start("name"))[0], kind, name, f"{kind} {name} is not released"))
    return sorted(out)


_PY_OPEN = {"open": "file", "io.open": "file", "socket.socket": "socket", "subprocess.Popen": "process", "asyncio.create_task": "task", "asyncio.ensure_future": "task"}
_PY_CLOSE = {"file": {"close"}, "socket": {"close", "detach"}, "process": {"wait", "communicate", "terminate", "kill"}, "task": {"cancel", "result", "add_done_callback"}}


def _python_unreleased(text: str) -> list[tuple[int, str, str, str]]:
    """The same for Python by its syntax: imports may be renamed; with, await, return, yield, calls and attributes take a resource over; a release ends the latest open one of its name, looked for outwards."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    renamed: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            renamed |= {a.asname: a.name for a in node.names if a.asname}
        elif isinstance(node, ast.ImportFrom) and node.module:
            renamed |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}

    def called(node: ast.AST) -> str | None:
        if not isinstance(node, ast.Call):
            return None
        parts, at = [], node.func
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
        if not isinstance(at, ast.Name):
            return None
        return _PY_OPEN.get(".".join([renamed.get(at.id, at.id), *reversed(parts)]))

    issues: list[tuple[int, str, str, str]] = []

    class Scope:
        def __init__(self, outer: Scope | None):
            self.outer, self.open = outer, []

        def release(self, name: str, method: str | None) -> None:
            for k in range(len(self.open) - 1, -1, -1):
                n, kind, _ = self.open[k]
                if n == name and (method is None or method in _PY_CLOSE[kind]):
                    del self.open[k]
                    return
            if self.outer is not None:
                self.outer.release(name, method)

    def handed_over(scope: Scope, node: ast.AST | None) -> None:
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, ast.Name):
                scope.release(x.id, None)

    def visit(node: ast.AST, scope: Scope) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            inner = Scope(scope)
            for s in node.body if isinstance(node.body, list) else [node.body]:
                visit(s, inner)
            issues.extend((line, kind, name, f"{kind} {name} is not released") for name, kind, line in inner.open)
            return
        if isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                handed_over(scope, item.context_expr)
            for s in node.body:
                visit(s, scope)
            return
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and (kind := called(node.value)) is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            scope.open.extend((t.id, kind, node.lineno) for t in targets if isinstance(t, ast.Name))
            return
        if isinstance(node, ast.Expr) and (kind := called(node.value)) is not None:
            issues.append((node.lineno, kind, "_", f"{kind} is not kept"))
            return
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            scope.release(node.func.value.id, node.func.attr)
        if isinstance(node, ast.Call):
            for a in [*node.args, *(k.value for k in node.keywords)]:
                if isinstance(a, (ast.Name, ast.List, ast.Tuple, ast.Starred)):
                    handed_over(scope, a)
            if called(node) is None and isinstance(node.func, ast.Attribute) and (kind := called(node.func.value)) is not None and node.func.attr not in _PY_CLOSE[kind]:
                issues.append((node.lineno, kind, "_", f"{kind} is not kept"))
        if isinstance(node, (ast.Return, ast.Yield, ast.YieldFrom, ast.Await)):
            handed_over(scope, node.value)
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Name) and any(not isinstance(t, ast.Name) for t in node.targets):
            handed_over(scope, node.value)
        for child in ast.iter_child_nodes(node):
            visit(child, scope)

    top = Scope(None)
    for s in tree.body:
        visit(s, top)
    issues.extend((line, kind, name, f"{kind} {name} is not released") for name, kind, line in top.open)
    return sorted(set(issues))


#: Asynchronous calls whose result is dropped at the start of a statement; fixed values.
DROPPED = {
    "csharp": r"^\s*(?!await\b|return\b|var\b)(?:[\w]+\.)*(?P<name>\w+Async)\s*\([^;]*\)\s*;",
    "js": r"^\s*(?!await\b|return\b|void\b)(?P<name>fetch|axios\.\w+)\s*\([^;]*\)\s*;?\s*$",
    "rust": r"^\s*(?P<name>tokio::spawn)\s*\(",
    "elixir": r"^\s*(?P<name>Task\.async)\s*\(",
    "java": r"^\s*(?P<name>CompletableFuture\.(?:run|supply)Async)\s*\([^;]*\)\s*;",
    "swift": r"^\s*(?P<name>Task)\s*\{",
    "golang": r"^\s*(?P<name>go)\s+func\s*\(",
    "cpp": r"^\s*(?P<name>std::async)\s*\(",
    "ruby": r"^[ \t]*(?P<name>Thread\.(?:new|start|fork))\b(?![\s\S]*(?:\.|&:)(?:join|value)\b)",
}


def dropped_tasks(text: str, lang: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, name, message) of asynchronous work that is started and dropped."""
    if lang not in DROPPED:
        return []
    plain, lines = masked(text, lang), Lines(text)
    return [(lines.at(m.start("name"))[0], "dropped", m["name"], f"the result of {m['name']} is dropped") for m in re.finditer(DROPPED[lang], plain, re.M)]


def issues(files: DataFrame, checks: tuple = (unreleased, dropped_tasks)) -> DataFrame:
    """``(path, lang, line_no, kind, name, message)`` of all checks, file by file."""

    def checked(path: str, lang: str, text: str | None) -> Iterator[tuple]:
        return ((path, lang, *x) for check in checks if isinstance(text, str) for x in check(text, lang))

    return by_file(files, ["path", "lang", "text"], checked, ISSUES)


_HOOK = re.compile(r"\b(use(?:Effect|Callback|Memo|LayoutEffect))\s*\(\s*(?:async\s*)?\(?([^)=]*)\)?\s*=>")
_IDENTIFIER = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*")
#: Names that are no dependencies; fixed values.
_NOT_DEPENDENCIES = frozenset("const let var function return if else for while new await async true false null undefined this typeof in of try catch finally throw switch case break continue default class extends console window document Math JSON Object Array String Number Boolean Promise Date Error Map Set setTimeout clearTimeout setInterval clearInterval fetch parseInt parseFloat".split())


def hooks(files: DataFrame) -> DataFrame:
    """``(path, line_no, hook, used, local, declared)`` of hooks with a list of dependencies, for ``dependency_gaps``."""

    def found(path: str, lang: str, text: str) -> Iterator[tuple]:
        plain, lines = masked(text, lang), Lines(text)
        for m in _HOOK.finditer(plain):
            depth, end = 0, m.end()
            while end < len(plain) and not (depth == 0 and plain[end] in ",)"):
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(plain[end], 0)
                end += 1
            deps = re.match(r",\s*\[([^\]]*)\]", plain[end:])
            if deps is None:
                continue
            body = plain[m.end() : end]
            keys = {k for k in re.findall(r"([A-Za-z_$][\w$]*)\s*:", body)}
            local = {x for d in re.findall(r"\b(?:const|let|var|function)\s+([^=;(]+)", body) for x in _IDENTIFIER.findall(d)} | set(_IDENTIFIER.findall(m[2])) | {x for a in re.findall(r"\(([^()]*)\)\s*=>", body) for x in _IDENTIFIER.findall(a)} | set(re.findall(r"([A-Za-z_$][\w$]*)\s*=>", body))
            used = {x for x in _IDENTIFIER.findall(body) if x not in _NOT_DEPENDENCIES and x not in keys and not re.fullmatch(r"set[A-Z]\w*|dispatch", x)}
            declared = {x.strip().split(".")[0] for x in deps[1].split(",") if x.strip()}
            yield path, lines.at(m.start())[0], m[1], sorted(used), sorted(local), sorted(declared)

    some = files.where((F.col("lang") == "js") & F.col("text").rlike(r"\buse(?:Effect|Callback|Memo|LayoutEffect)\s*\("))
    return by_file(some, ["path", "lang", "text"], found, "path string, line_no int, hook string, used array<string>, local array<string>, declared array<string>")

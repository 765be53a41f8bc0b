"""Where values go in Python programs: definitions and uses as rows, and what they carry as a fixpoint over these.

Each file is parsed once. Every binding of a name is a node (parameters, ``for``, ``with``, ``:=`` and what several branches join into
as well), every call that a rule watches is another, and a use is an edge from the binding that is in force there. Nodes
carry bits: a rule's bit for data of a request that this rule has no check for, and two bits for texts made at run time or of
unknown parts. An edge keeps the bits that no check on the way takes off. Checks count if they dominate the use: a
branch that is only entered after one, or a statement behind a branch that leaves without one. The bits then
spread over all files at once in joins of the newest rows with the edges, until nothing is new.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SUPPRESSION_MARKERS
from ..functions.source import _dotted
from ..functions.text import LINE_BREAK
from ..schemas import FLOW
from ..sources.steps import by_file, step
from .flow import SOURCES


@dataclass(frozen=True)
class Family:
    """Calls that may not get request data: dotted or last names, by position or name of the argument (None: any); ``safe`` is what checks a value."""

    name: str
    calls: frozenset[str]
    position: int | None
    arguments: frozenset[str]
    safe: str
    title: str
    source: str = SOURCES["python"]


def _family(name: str, calls: str, position: int | None, arguments: str, safe: str, title: str, source: str = SOURCES["python"]) -> Family:
    return Family(name, frozenset(calls.split()), position, frozenset(arguments.split()), safe, title, source)


#: Names of libraries' functions; fixed values.
FAMILIES = (
    _family("redirect", "redirect HttpResponseRedirect HttpResponsePermanentRedirect RedirectResponse", 0, "url location redirect_to", r"(?i)url_has_allowed_host|safe_(url|redirect)|allowed_(host|url|redirect)|validate_(url|redirect)|netloc", "Request data says where a client is sent"),
    _family("outbound", "urlopen requests.get requests.post requests.put requests.head requests.request httpx.get httpx.post httpx.stream aiohttp.request", None, "url", r"(?i)allowed_(host|url|domain)|validate_(url|host)|(safe|public|allowed)_(url|host)|netloc|hostname", "Request data names the host of a request"),
    _family("header", "headers.add headers.set headers.setdefault headers.extend set_cookie add_header", None, "value", r"(?i)quote\(|sanitize|strip_newlines|\breplace\(", "Request data is a response's header"),
    _family("template", "render_template_string Template from_string Markup mark_safe", 0, "source template", r"(?i)\bescape\(|bleach|sanitize", "Request data is a template"),
    _family("mass", "create update filter_by get_or_create setattr", None, "", r"(?i)allowed_|whitelist|validated_data|is_valid\(|model_validate|\bpick\(", "Request data sets fields by name"),
    _family("sql", "execute executemany executescript raw read_sql", 0, "sql query statement", r"(?i)\bint\(|quote_ident|sql\.Identifier|allowed_", "Request data is a part of SQL"),
    _family("command", "os.system os.popen subprocess.run subprocess.call subprocess.check_call subprocess.check_output subprocess.Popen subprocess.getoutput Popen", 0, "args cmd command", r"(?i)shlex\.quote|allowed_", "Request data is a part of a command"),
    _family("path", "open send_file send_from_directory os.remove os.unlink os.open shutil.rmtree shutil.copy Path", None, "path filename file", r"(?i)secure_filename|safe_join|basename\(|commonpath|is_relative_to|allowed_", "Request data is a part of a path"),
    _family("load", "pickle.loads pickle.load yaml.load marshal.loads dill.loads jsonpickle.decode shelve.open", 0, "data stream", r"(?i)compare_digest|verify_signature|safe_load|SafeLoader", "Request data is loaded as objects"),
    _family("eval", "eval exec compile __import__ import_module", 0, "source name", r"(?i)literal_eval|allowed_", "Request data is run"),
    _family("host", "send_mail send_message send_email EmailMessage EmailMultiAlternatives Message", None, "", r"(?i)allowed_hosts|trusted_hosts|validate_host", "A request's host is part of a message", r"\brequest\.(host\b|host_url|url_root|base_url|get_host\(\)|build_absolute_uri)|X-Forwarded-Host"),
)
RUNTIME, UNKNOWN = 1 << 30, 1 << 29
_ALL = (1 << len(FAMILIES)) - 1
_SAFE = [re.compile(f.safe) for f in FAMILIES]
_ANY_SAFE = re.compile("|".join(f"(?:{f.safe.removeprefix('(?i)')})" for f in FAMILIES), re.I)
_SOURCE = [(re.compile(p), sum(1 << k for k, f in enumerate(FAMILIES) if f.source == p)) for p in dict.fromkeys(f.source for f in FAMILIES)]
_BY_CALL: dict[str, list[int]] = {}
for _k, _f in enumerate(FAMILIES):
    for _call in _f.calls:
        _BY_CALL.setdefault(_call, []).append(_k)
_TRUSTED = re.compile(r"(?i)allow|trusted|valid|permitted|safe|known|whitelist")
_RAISES = re.compile(r"(?i)^(validate|check|ensure|require|assert|verify)_?")
_LEAVES = frozenset("abort exit sys.exit os._exit".split())
_SQL = re.compile(r"(?is)\b(select\b.+\bfrom|insert\s+into|update\b.+\bset|delete\s+from)\b")
_EXECUTES = frozenset("execute executemany executescript raw read_sql read_sql_query".split())
FACTS = "path string, id int, src int, keep long, bits long, want long, rule_id string, name string, line_no int, code string"
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


#: Nodes that name an operator or how a name is used; nothing is below them.
_WORDLESS = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def _below(node: ast.AST) -> list[ast.AST]:
    """A node's children in order without the wordless ones: a loop over fields, since a program's expressions are read several times."""
    out: list[ast.AST] = []
    for field in node._fields:
        x = getattr(node, field, None)
        if isinstance(x, list):
            out.extend(y for y in x if isinstance(y, ast.AST) and not isinstance(y, _WORDLESS))
        elif isinstance(x, ast.AST) and not isinstance(x, _WORDLESS):
            out.append(x)
    return out


def _walk(node: ast.AST) -> list[ast.AST]:
    """A node and all below it but the wordless ones, level by level."""
    out = [node]
    for x in out:
        if not isinstance(x, (ast.Name, ast.Constant)):
            out += _below(x)
    return out


class _State:
    """What holds at a point: the node in force of each name, and the rules that a name is checked for; of a branch, what it changes."""

    __slots__ = ("names", "checked", "up")

    def __init__(self, names: dict[str, int | None], up: _State | None = None):
        self.names, self.checked, self.up = names, {}, up

    def branch(self, checked: dict[str, int] | None = None) -> _State:
        out = _State({}, self)
        for name, bits in (checked or {}).items():
            out.checked[name] = bits | self.checks_of(name)
        return out

    def node_of(self, name: str) -> int | None:
        at: _State | None = self
        while at is not None:
            if name in at.names:
                return at.names[name]
            at = at.up
        return None

    def checks_of(self, name: str) -> int:
        at: _State | None = self
        while at is not None:
            if name in at.checked:
                return at.checked[name]
            at = at.up
        return 0


class _Reader:
    """Nodes and edges of one program."""

    def __init__(self, text: str, tree: ast.AST):
        self.lines = re.split(LINE_BREAK, text)
        self.plain = text.isascii()
        self.raw = self.lines if self.plain else [x.encode() for x in self.lines]
        self.nodes: list[list] = []  # bits, want, rule, name, line
        self.edges: dict[tuple[int, int], int] = {}
        self.values: dict[int, ast.AST] = {}
        self.outer: list[dict[str, int]] = []
        self.later: list[tuple[ast.AST, list[dict[str, int]]]] = []
        self.scope(tree.body, {}, [])
        while self.later:
            node, outer = self.later.pop()
            a = node.args
            names = {x.arg: self.node(x.arg, node.lineno, RUNTIME) for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x}
            self.scope(node.body if isinstance(node.body, list) else [ast.Expr(node.body)], names, outer)

    def scope(self, body: list[ast.stmt], names: dict[str, int], outer: list[dict[str, int]]) -> None:
        """Read a function's or the file's statements; those of functions in it follow, when all its names are known."""
        self.outer = outer
        state = _State(names)
        before = len(self.later)
        self.block(body, state)
        self.later[before:] = [(n, [*outer, state.names]) for n, _ in self.later[before:]]

    def node(self, name: str, line: int, bits: int = 0, want: int = 0, rule: str = "") -> int:
        self.nodes.append([bits, want, rule, name, line])
        return len(self.nodes) - 1

    def edge(self, src: int, dst: int, keep: int = _ALL | RUNTIME | UNKNOWN) -> None:
        if src != dst:
            self.edges[src, dst] = self.edges.get((src, dst), 0) | keep

    def segment(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            found = self.raw[first][node.col_offset : node.end_col_offset]
        else:
            found = ("\n" if self.plain else b"\n").join([self.raw[first][node.col_offset :], *self.raw[first + 1 : last], self.raw[last][: node.end_col_offset]])
        return found if self.plain else found.decode("utf-8", "replace")

    def lookup(self, name: str, state: _State) -> int | None:
        if (found := state.node_of(name)) is not None:
            return found
        return next((names[name] for names in reversed(self.outer) if names.get(name) is not None), None)

    # --- Values

    def level(self, node: ast.AST, state: _State) -> int:
        """Whether parts of a text are made at run time or unknown, apart from what its names carry."""
        bits, todo = 0, [node]
        while todo:
            x = todo.pop()
            if isinstance(x, ast.Name):
                bits |= 0 if self.lookup(x.id, state) is not None else UNKNOWN
            elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("format", "join"):
                todo += [x.func.value, *x.args, *(k.value for k in x.keywords)]
            elif isinstance(x, (ast.Call, ast.Attribute, ast.Subscript, ast.Await)):
                return RUNTIME
            else:
                todo += [y for y in ast.iter_child_nodes(x) if isinstance(y, ast.expr)]
        return bits

    def carry(self, node: ast.AST, into: int, state: _State, texts: bool = True) -> None:
        """Bits of an expression, and edges from what it reads, go into a node."""
        text = self.segment(node)
        clean = reduce(lambda bits, k: bits | 1 << k, (k for k, p in enumerate(_SAFE) if p.search(text)), 0) if _ANY_SAFE.search(text) else 0
        for pattern, bits in _SOURCE:
            if (m := pattern.search(text)) and bits & ~clean:
                self.nodes[into][0] |= bits & ~clean
                self.nodes[into].append(m[0].strip(" (")) if len(self.nodes[into]) == 5 else None
        if texts:
            self.nodes[into][0] |= self.level(node, state)
        for x in _walk(node):
            name = x.id if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) else _dotted(x) if isinstance(x, ast.Attribute) else ""
            if name and (src := self.lookup(name, state)) is not None:
                self.edge(src, into, (_ALL & ~clean & ~state.checks_of(name)) | RUNTIME | UNKNOWN)

    def bind(self, target: ast.AST, value: ast.AST | None, state: _State) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            same = isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) and not any(isinstance(x, ast.Starred) for x in (*target.elts, *value.elts))
            for k, part in enumerate(target.elts):
                self.bind(part, value.elts[k] if same else value, state)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, value, state)
        elif isinstance(target, ast.Subscript):
            if _dotted(target.value).rpartition(".")[2] == "headers" and value is not None:
                self.watched(FAMILIES[2], "headers[]", value, target.lineno, state)
            if (held := self.lookup(_dotted(target.value), state)) is not None and value is not None:
                self.carry(value, held, state, texts=False)
        elif name := _dotted(target):
            new = self.node(name, target.lineno)
            if value is not None:
                self.carry(value, new, state)
                self.values[new] = value
            state.names[name] = new
            state.checked[name] = 0

    def watched(self, family: Family, called: str, value: ast.AST, line: int, state: _State) -> None:
        self.carry(value, self.node(called, line, 0, 1 << FAMILIES.index(family), f"python.ordered.{family.name}"), state, texts=False)

    def expression(self, node: ast.AST | None, state: _State) -> None:
        """Bindings and watched calls inside an expression, from left to right."""
        if node is None:
            return
        todo = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.Name, ast.Constant)):
                continue
            if isinstance(x, ast.Lambda):
                self.later.append((x, []))
                continue
            if isinstance(x, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
                for g in x.generators:
                    self.bind(g.target, g.iter, state)
            elif isinstance(x, ast.NamedExpr):
                self.bind(x.target, x.value, state)
            elif isinstance(x, ast.Call):
                self.call(x, state)
            todo.extend(reversed(_below(x)))

    def call(self, node: ast.Call, state: _State) -> None:
        called = _dotted(node.func) or getattr(node.func, "attr", "")
        last = called.rpartition(".")[2]
        tail = ".".join(called.split(".")[-2:])
        for k in dict.fromkeys(k for name in (called, tail, last) for k in _BY_CALL.get(name, ())):
            f = FAMILIES[k]
            if f.name == "mass":
                given = [w.value for w in node.keywords if w.arg is None] + (node.args[1:2] if last == "setattr" else [])
            elif f.position is None:
                given = [*node.args, *(w.value for w in node.keywords if w.arg in f.arguments or not f.arguments)]
            else:
                given = node.args[f.position : f.position + 1] or [w.value for w in node.keywords if w.arg in f.arguments]
            if given:
                self.watched(f, called, given[0] if len(given) == 1 else ast.copy_location(ast.Tuple(given, ast.Load()), node), node.lineno, state)
        if last in _EXECUTES and node.args:
            given = node.args[0]
            if isinstance(given, ast.Name) and (held := self.lookup(given.id, state)) is not None:
                given = self.values.get(held, given)
            if _put_together(given) and _SQL.search(" ".join(x.value for x in ast.walk(given) if isinstance(x, ast.Constant) and isinstance(x.value, str)) + " "):
                self.carry(given, self.node(called, node.lineno, 0, RUNTIME | UNKNOWN, "python.sql_text"), state)

    # --- Conditions

    def checks(self, test: ast.AST) -> tuple[dict[str, int], dict[str, int]]:
        """What names are checked for if a condition holds, and if it does not."""
        if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            return self.checks(test.operand)[::-1]
        if isinstance(test, ast.BoolOp):
            each = [self.checks(x) for x in test.values]
            side = int(isinstance(test.op, ast.Or))
            both: dict[str, int] = {}
            for found in each:
                for name, bits in found[side].items():
                    both[name] = both.get(name, 0) | bits
            return (both, {})[:: -1 if side else 1]
        text, bits, swap = self.segment(test), 0, False
        if isinstance(test, ast.Compare) and len(test.ops) == 1:
            swap = isinstance(test.ops[0], (ast.NotIn, ast.NotEq, ast.IsNot))
            if isinstance(test.ops[0], (ast.In, ast.NotIn)) and (isinstance(test.comparators[0], (ast.Set, ast.Tuple, ast.List)) or _TRUSTED.search(self.segment(test.comparators[0]))):
                bits = _ALL
        bits |= sum(1 << k for k, p in enumerate(_SAFE) if p.search(text)) if _ANY_SAFE.search(text) else 0
        found = {x.id: bits for x in ast.walk(test) if bits and isinstance(x, ast.Name)}
        return ({}, found) if swap else (found, {})

    # --- Statements

    def merge(self, state: _State, ends: list[_State]) -> None:
        """Go on behind branches of ``state``: a name that they leave with different nodes gets one that all of these lead to."""
        for name in dict.fromkeys(n for e in ends for n in e.names):
            found = {e.names[name] if name in e.names else self.lookup(name, state) for e in ends} - {None}
            if len(found) > 1:
                new = self.node(name, 0)
                for src in sorted(found):
                    self.edge(src, new)
                found = {new}
            state.names[name] = found.pop() if found else None
        for name in dict.fromkeys(n for e in ends for n in e.checked):
            state.checked[name] = reduce(lambda bits, e: bits & e.checks_of(name), ends, _ALL)

    def block(self, body: list[ast.stmt], state: _State) -> bool:
        """Read statements in order; whether they always leave."""
        return any([self.statement(x, state) for x in body])

    def branches(self, state: _State, parts: list[tuple[list[ast.stmt], dict[str, int]]]) -> bool:
        ends = []
        for body, checked in parts:
            end = state.branch(checked)
            if not self.block(body, end):
                ends.append(end)
        if ends:
            self.merge(state, ends)
        return not ends

    def statement(self, st: ast.stmt, state: _State) -> bool:
        if isinstance(st, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for x in (*st.decorator_list, *st.args.defaults, *filter(None, st.args.kw_defaults)):
                self.expression(x, state)
            self.later.append((st, []))
            state.names[st.name] = self.node(st.name, st.lineno, UNKNOWN)
        elif isinstance(st, ast.ClassDef):
            for x in (*st.decorator_list, *st.bases, *(k.value for k in st.keywords)):
                self.expression(x, state)
            self.block(st.body, state.branch())
            state.names[st.name] = self.node(st.name, st.lineno, UNKNOWN)
        elif isinstance(st, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            self.expression(st.value, state)
            if isinstance(st, ast.AugAssign):
                both = ast.copy_location(ast.BinOp(ast.copy_location(ast.Name(st.target.id, ast.Load()), st.target), st.op, st.value), st) if isinstance(st.target, ast.Name) else st.value
                self.bind(st.target, both, state)
            elif st.value is not None:
                for target in st.targets if isinstance(st, ast.Assign) else [st.target]:
                    self.bind(target, st.value, state)
        elif isinstance(st, ast.If):
            parts, failed, rest = [], {}, st
            while True:  # a chain of elif is as long as it likes
                self.expression(rest.test, state)
                yes, no = self.checks(rest.test)
                parts.append((rest.body, failed | yes))
                failed = failed | no
                if len(rest.orelse) != 1 or not isinstance(rest.orelse[0], ast.If):
                    return self.branches(state, [*parts, (rest.orelse, failed)])
                rest = rest.orelse[0]
        elif isinstance(st, (ast.For, ast.AsyncFor, ast.While)):
            self.loop(st, state)
        elif isinstance(st, (ast.Try, ast.TryStar)):
            tried = state.branch()
            ends = [] if self.block(st.body, tried) or self.block(st.orelse, tried) else [tried]
            for h in st.handlers:
                end = state.branch()
                if h.name:
                    end.names[h.name] = self.node(h.name, h.lineno, UNKNOWN)
                if not self.block(h.body, end):
                    ends.append(end)
            if ends:
                self.merge(state, ends)
            return self.block(st.finalbody, state) or not ends
        elif isinstance(st, (ast.With, ast.AsyncWith)):
            for item in st.items:
                self.expression(item.context_expr, state)
                if item.optional_vars is not None:
                    self.bind(item.optional_vars, item.context_expr, state)
            return self.block(st.body, state)
        elif isinstance(st, ast.Match):
            self.expression(st.subject, state)
            parts = []
            for case in st.cases:
                for x in ast.walk(case.pattern):
                    if isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name:
                        self.bind(ast.copy_location(ast.Name(x.name, ast.Store()), x), st.subject, state)
                parts.append((case.body, {}))
            return self.branches(state, [*parts, ([], {})])
        elif isinstance(st, ast.Assert):
            self.expression(st.test, state)
            for name, bits in self.checks(st.test)[0].items():
                state.checked[name] = state.checks_of(name) | bits
        elif isinstance(st, ast.Delete):
            for target in st.targets:
                state.names[_dotted(target)] = None
        elif isinstance(st, (ast.Import, ast.ImportFrom)):
            for alias in st.names:
                state.names[(alias.asname or alias.name).partition(".")[0]] = self.node(alias.name, st.lineno, UNKNOWN)
        else:
            for x in ast.iter_child_nodes(st):
                if isinstance(x, ast.expr):
                    self.expression(x, state)
            if isinstance(st, ast.Expr) and isinstance(st.value, ast.Call):
                called = _dotted(st.value.func)
                if called in _LEAVES:
                    return True
                if _RAISES.match(called.rpartition(".")[2]):  # it raises unless the value passes
                    for name, bits in self.checks(st.value)[0].items():
                        state.checked[name] = state.checks_of(name) | bits
            return isinstance(st, (ast.Return, ast.Raise, ast.Continue, ast.Break))
        return False

    def loop(self, st: ast.For | ast.AsyncFor | ast.While, state: _State) -> None:
        """A name that the body binds has one node at the loop's head, which what was before and the body's end lead to."""
        inside = {x.id for s in st.body for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        heads = {}
        for name in sorted(inside):
            heads[name] = self.node(name, 0)
            if (src := self.lookup(name, state)) is not None:
                self.edge(src, heads[name])
            state.names[name] = heads[name]
            state.checked[name] = 0
        if isinstance(st, ast.While):
            self.expression(st.test, state)
            end = state.branch(self.checks(st.test)[0])
        else:
            self.expression(st.iter, state)
            self.bind(st.target, st.iter, state)
            end = state.branch()
        self.block(st.body, end)
        for name, head in heads.items():
            if (src := end.node_of(name)) is not None:
                self.edge(src, head)
        self.block(st.orelse, state)


def _put_together(node: ast.AST) -> bool:
    """Whether a text is made of parts: by an f-string, ``%``, ``+`` or format()."""
    if isinstance(node, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in node.values)
    return isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mod, ast.Add)) or isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format"


def program_facts(text: str | None, markers: tuple[str, ...] = SUPPRESSION_MARKERS) -> list[tuple]:
    """FACTS of one program without its path: nodes (src null) and edges that lead to a watched call; none for what does not parse."""
    try:
        tree = ast.parse(text) if isinstance(text, str) else None
        read = _Reader(text, tree) if tree is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    if read is None:
        return []
    into: dict[int, list[int]] = {}
    for src, dst in read.edges:
        into.setdefault(dst, []).append(src)
    needed: set[int] = set()
    todo = [k for k, n in enumerate(read.nodes) if n[1] and not any(m in x.lower() for x in read.lines[max(0, n[4] - 2) : n[4]] for m in markers)]
    while todo:  # only what can reach a watched call is a row
        k = todo.pop()
        if k not in needed:
            needed.add(k)
            todo += into.get(k, ())
    out = [(k, None, None, bits, want, rule, name if want or not source else f"{source[0]}\n{name}", line, read.lines[line - 1].strip() if want else None) for k, (bits, want, rule, name, line, *source) in enumerate(read.nodes) if k in needed]
    out = [(*row[:6], f"{read.nodes[row[0]][5]}\n{row[6]}" if row[4] and len(read.nodes[row[0]]) > 5 else row[6], *row[7:]) for row in out]
    return out + [(dst, src, keep, None, None, None, None, None, None) for (src, dst), keep in read.edges.items() if dst in needed]


def dataflow_facts(files: DataFrame, markers: tuple[str, ...] = SUPPRESSION_MARKERS) -> DataFrame:
    """FACTS of the Python files of ``files(path, lang, text)``; texts without a source and an executed text are let go on the JVM."""

    def facts(path: str, text: str) -> Iterator[tuple]:
        return ((path, *fact) for fact in program_facts(text, markers))

    some = "|".join([*(f"(?:{p.pattern})" for p, _ in _SOURCE), r"\b(?:" + "|".join(sorted(_EXECUTES)) + r")\s*\("])
    types = {"src": "Int32", "keep": "Int64", "bits": "Int64", "want": "Int64", "line_no": "Int32"}
    return by_file(files.where((F.col("lang") == "python") & F.col("text").rlike(some)), ["path", "text"], facts, FACTS, types)


def spread_bits(facts: DataFrame, steps: int = 5) -> DataFrame:
    """``(path, id, bits, trail)``: what each node carries in the end, by semi-naive rounds.

    A round joins what is new with the edges of its file and keeps bits that a node did not have; there are as many
    rounds as the longest chain of bindings that brings something new. A trail keeps its last ``steps`` names.
    """
    edges = facts.where("src IS NOT NULL").select("path", F.col("src").alias("id"), F.col("id").alias("dst"), "keep")
    names = facts.where("src IS NULL").select("path", F.col("id").alias("dst"), F.col("name").alias("called"))
    new = step(facts.where("src IS NULL AND bits <> 0").select("path", "id", "bits", F.split("name", "\n").alias("trail")))
    known = new
    while not new.isEmpty():
        moved = new.join(edges, ["path", "id"]).select("path", "dst", F.col("bits").bitwiseAND(F.col("keep")).alias("bits"), "trail").where("bits <> 0")
        met = moved.groupBy("path", "dst").agg(F.bit_or("bits").alias("bits"), F.min(F.struct(F.size("trail").alias("n"), F.col("trail").alias("trail"))).alias("t"))
        had = known.groupBy("path", F.col("id").alias("dst")).agg(F.bit_or("bits").alias("had"))
        fresh = met.join(had, ["path", "dst"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))).where("bits <> 0")
        last = F.element_at(F.split("called", "\n"), -1)
        trail = F.when(F.element_at("t.trail", -1) == last, F.col("t.trail")).otherwise(F.concat("t.trail", F.array(last)))
        new = step(fresh.join(names, ["path", "dst"]).select("path", F.col("dst").alias("id"), "bits", F.slice(trail, -F.least(F.lit(steps), F.size(trail)), steps).alias("trail")))
        known = known.unionByName(new)
    return known.groupBy("path", "id").agg(F.bit_or("bits").alias("bits"), F.min(F.struct(F.size("trail").alias("n"), F.col("trail").alias("trail")))["trail"].alias("trail"))


def python_flows(files: DataFrame, markers: tuple[str, ...] = SUPPRESSION_MARKERS) -> DataFrame:
    """FLOW rows of watched calls that request data reaches unchecked, and of SQL texts made of run-time or unknown parts.

    Rules are python.ordered.<family>, python.sql_text.tainted and python.sql_text.unknown. Names hold in their function
    and those inside it, a new binding replaces an old one, calls are not followed into functions. A marker
    on the call's line or the one before lets it off.
    """
    facts = step(dataflow_facts(files, markers))
    calls = facts.where("src IS NULL AND want <> 0").drop("bits")
    found = calls.join(spread_bits(facts), ["path", "id"]).where(F.col("bits").bitwiseAND(F.col("want")) != 0)
    grade = F.when(F.col("bits").bitwiseAND(F.lit(RUNTIME)) != 0, ".tainted").otherwise(".unknown")
    rule = F.when(F.col("rule_id") == "python.sql_text", F.concat("rule_id", grade)).otherwise(F.col("rule_id"))
    return found.select(rule.alias("rule_id"), "path", "line_no", "code", "trail").select(*FLOW.names)

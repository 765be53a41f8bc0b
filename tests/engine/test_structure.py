import random
import subprocess

import pytest

from pyspark.sql import functions as F

from textloom.config import ScanConfig
from textloom.operators import prune as P
from textloom.functions.syntax import parse
from textloom.functions.text import explode_lines
from textloom.operators.ambiguity import _parser, _Positions, ambiguous
from textloom.operators.dataflow import program_facts, python_flows
from textloom.operators.structural import axis_counts, parents
from textloom.plans.catalogue import Rule
from textloom.plans.scan import scan
from textloom.plans.userrules import pattern_test, read_syntax_rules, syntax_rule, syntax_rule_matches
from textloom.sources import sinks, tree
from textloom.sources.versions import ignore_pattern, ignore_rules, since_merge_base, version_ignored

FILES = "path string, lang string, text string"


def git(root, *words):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *words], capture_output=True, text=True, check=True).stdout


def test_ignore_rules_agree_with_git(spark, tmp_path):
    listed = {".gitignore": "*.log\n!keep.log\nbuild/\n/top.txt\nsrc/*.tmp\n**/deep/x\na/**/z\nfoo/**\n\\#h\nq?[ab]\nt[!c]\n# note\nout/\n!out/in.txt\n", "src/.gitignore": "!b.log\n/only\n*.py\n!sub/k.py\n"}
    names = ["a.log", "keep.log", "b.log", "top.txt", "x", "z", "k.py", "only", "#h", "qxa", "qxc", "tb", "tc", "in.txt", "u.tmp"]
    folders = ["", "src", "src/sub", "build", "a", "a/b", "a/b/c", "deep", "m/deep", "foo", "foo/bar", "out", "src/out", "src/build/k"]
    paths = [f"{d}/{n}".lstrip("/") for d in folders for n in names] + list(listed)
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(listed.get(p, "x"))
    git(tmp_path, "init", "-q")
    want = set(git(tmp_path, "-c", "core.quotePath=false", "ls-files", "-o", "-i", "--exclude-standard").splitlines())
    random.seed(1)
    random.shuffle(paths)
    files = spark.createDataFrame([(p, listed.get(p, "x")) for p in paths], "path string, text string")
    assert {r.path for r in version_ignored(files, ignore_rules(files)).collect()} == want
    none = spark.createDataFrame([(".gitignore", None)], "path string, text string")
    assert version_ignored(files, ignore_rules(none)).count() == 0
    assert ignore_pattern("# x") is None and ignore_pattern("/") is None and ignore_pattern("") is None


def test_changes_since_the_merge_base(spark, tmp_path):
    assert since_merge_base(spark, str(tmp_path)) is None
    git(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("a")
    git(tmp_path, "add", ".")
    git(tmp_path, "commit", "-qm", "a")
    assert since_merge_base(spark, str(tmp_path)) is None
    (tmp_path / "b.py").write_text("b")
    (tmp_path / "a.py").unlink()
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "b")
    changed = since_merge_base(spark, str(tmp_path))
    files = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "path string")
    assert [r.path for r in P.changed_or_all(files, changed).collect()] == ["b.py"]


def test_definitions_and_uses(spark):
    assert program_facts(None) == [] and program_facts("def (") == [] and program_facts("") == []
    empty = spark.createDataFrame([], FILES)
    assert python_flows(empty).count() == 0
    programs = {
        "walrus": "(n := request.args['n'])\nx += n\nredirect(x)\n", "chain": "a = g()\nb = a\nc = b\nx.execute(f'SELECT q FROM {c}')\n", "cycle": "a = b\nb = a\nx.execute(f'SELECT q FROM {a}')\n",
        "branch": "if a:\n    u = request.args['u']\nelse:\n    u = '/'\nredirect(u)\n", "left": "u = request.args['u']\nif u not in ALLOWED:\n    raise ValueError\nredirect(u)\n", "kept": "u = request.args['u']\nif u not in ALLOWED:\n    log(u)\nredirect(u)\n",
        "or": "u = request.args['u']\nif not u or not is_safe_url(u):\n    abort(400)\nredirect(u)\n", "other": "u = request.args['u']\nv = '/'\nif is_safe_url(v):\n    redirect(u)\n", "rebound": "u = request.args['u']\nif is_safe_url(u):\n    u = request.args['v']\n    redirect(u)\n",
        "try": "try:\n    u = request.args['u']\nexcept KeyError:\n    u = '/'\nredirect(u)\n", "raises": "u = request.args['u']\nvalidate_url(u)\nredirect(u)\n", "ternary": "u = request.args['u']\nredirect(u if u else '/')\n", "scope": "def f():\n    u = request.args['u']\ndef g(u):\n    redirect(u)\n",
        "outer": "def f():\n    redirect(u)\nu = request.args['u']\n", "inner": "def f(u):\n    u = request.args['u']\n    def g():\n        return redirect(u)\n    return g\n", "match": "match request.args:\n    case {'u': u}:\n        redirect(u)\n", "comp": "[redirect(u) for u in request.args]\n", "lambda": "u = request.args['u']\nf = lambda: redirect(u)\n",
        "deleted": "u = request.args['u']\ndel u\nredirect(u)\n", "utf": "ä = request.args['ü']  # é\nredirect(ä)\n", "self": "self.u = request.args['u']\nredirect(self.u)\n", "item": "d = {}\nd['u'] = request.args['u']\nredirect(d['u'])\n", "elif": "u = request.args['u']\nif a:\n    pass\n" + "elif b:\n    pass\n" * 700 + "redirect(u)\n",
    }
    found = {(r.path, r.rule_id.removeprefix("python."), r.line_no) for r in python_flows(spark.createDataFrame([(k, "python", t) for k, t in programs.items()], FILES)).collect()}
    hit = {"walrus": 3, "branch": 5, "kept": 4, "other": 4, "rebound": 4, "try": 5, "ternary": 2, "outer": 2, "inner": 4, "match": 3, "comp": 1, "lambda": 2, "utf": 2, "self": 2, "item": 3}
    assert found == {(k, "ordered.redirect", n) for k, n in hit.items()} | {("chain", "sql_text.tainted", 4), ("cycle", "sql_text.unknown", 3)} | ({("elif", "ordered.redirect", 1404)} & found)
    rows = spark.createDataFrame([("a.py", "python", None), ("a.js", "js", "redirect(request.args)")], FILES)
    assert python_flows(rows).count() == 0


def test_facts_take_linear_time():
    import time

    def took(n):
        texts = ["q = request.args['q']\n" + "".join(f"v{k} = v{k - 1} + q\n" for k in range(n)) + "redirect(v5)\n", "q = request.args['q']\n" + "".join(f"if a{k}:\n    v{k} = q\n" for k in range(n)) + "redirect(v5)\n"]
        began = time.process_time()
        assert all(program_facts(t) for t in texts)
        return time.process_time() - began

    took(500)
    assert took(8000) < 8 * took(2000)


def test_numbers_of_nodes_nest_whatever_the_text():
    rng = random.Random(4)
    bits = ["if", "(", ")", "{", "}", "[", "]", ";", "\n", "x", "=>", "await ", "new ", ".", "f(", "'", '"', "//", "#", "end", "do", "fn", "|", "=", ",", ":", "  ", "def f():\n  ", "return", "else", "catch", "ä", "`", "1.5"]
    for k in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        lang = rng.choice(["js", "python", "golang", "rust", "ruby", "elixir", "java", "swift", "cpp", "csharp", "cobol"])
        nodes = parse(text, lang)
        by = {n[0]: n for n in nodes}
        assert sorted(x for n in nodes for x in n[:2]) == list(range(1, 2 * len(nodes) + 1)), text
        for pre, post, parent, *_ in nodes[1:]:
            assert by[parent][0] < pre < post < by[parent][1]
    deep = "f(" * 3000 + "{" * 3000
    assert len(parse(deep, "js")) > 3000


def test_counts_along_axes_match_all_pairs(spark):
    rng = random.Random(9)
    nodes, questions = [], []
    for path in ("a", "b"):
        clock = 0

        def grow(depth):
            nonlocal clock
            clock += 1
            pre = clock
            for _ in range(rng.randrange(4) if depth < 5 else 0):
                grow(depth + 1)
            clock += 1
            for label in (0, 1):
                if rng.random() < 0.5:
                    nodes.append((path, label, pre, clock))
                if rng.random() < 0.5:
                    questions.append((path, label, pre, clock, rng.randrange(3)))

        for _ in range(6):
            grow(0)
    schema = "path string, label int, pre int, post int"
    got = axis_counts(spark.createDataFrame(questions, schema + ", rule int"), spark.createDataFrame(nodes, schema), ["rule", "pre"]).collect()
    want = {(p, la, r, pre, sum(x[:2] == (p, la) and x[2] < pre and x[3] > post for x in nodes), sum(x[:2] == (p, la) and x[2] > pre and x[3] < post for x in nodes)) for p, la, pre, post, r in questions}
    assert {(r.path, r.label, r.rule, r.pre, r.n_around, r.n_within) for r in got} == want and len(got) == len(want)
    tree = spark.createDataFrame([("a", 1, None, "file", "", ""), ("a", 2, 1, "call", "f", "f ( )")], "path string, pre int, parent int, kind string, name string, code string")
    assert [(r.pre, r.parent_kind) for r in parents(tree).orderBy("pre").collect()] == [(1, None), (2, "file")]


def test_user_rules_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("id: own.b\nlanguage: go\nseverity: hint\nrule:\n  regex: 'panic\\('\n  inside: {kind: for_statement}\n---\nid: own.a\nlanguage: py\nmessage: no\nrule:\n  all:\n    - pattern: f($A, $B)\n    - not: {has: {pattern: ok}}\n")
    (tmp_path / "notes.txt").write_text("id: x")
    own = read_syntax_rules(spark, str(tmp_path))
    assert [(r.rule.rule_id, r.rule.lang, r.rule.tiers) for r in own] == [("own.a", "python", ((0, "warning"),)), ("own.b", "golang", ((0, "info"),))]
    files = spark.createDataFrame([("a.py", "python", "f(1,  g(2))\nf( 'x', y )  # noqa\nf(ok, 1)\nef(1, 2)\nf(1)\n"), ("a.go", "golang", "for {\n panic(1)\n}\npanic(2)\n")], FILES)
    assert sorted((r.rule_id, r.s_line) for r in syntax_rule_matches(files, own).collect()) == [("own.a", 1), ("own.a", 2), ("own.b", 2)]
    found = scan(files.drop("lang"), ScanConfig(rule_globs=("own.*",)), own=own)
    assert {(r.rule_id, r.n, r.severity) for r in found.findings.collect()} == {("own.a", 1, "warning"), ("own.b", 1, "info")}
    for broken in ({"id": "x"}, {"id": "x", "language": "js", "rule": {"kind": "y"}}, {"id": "x", "language": "js", "rule": {"not": {"pattern": "f"}}}, {"id": "x", "language": "js", "rule": {"pattern": "f", "follows": {"kind": "if"}}}, {"id": "x", "language": "js", "rule": {"pattern": "f", "inside": {"kind": "?"}}}, {"id": "x", "language": "js", "rule": {"inside": {"kind": "loop"}}}, {"id": "x", "language": "js", "severity": "?", "rule": {"regex": "f"}}):
        with pytest.raises(ValueError):
            syntax_rule(broken)
    assert pattern_test("new Date($$$)", "js").kinds == ("new",) and pattern_test("$A == $A", "js").pattern.count("<A>") == 2


def test_targets_limits_and_module_reports(spark, tmp_path):
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "b.py").write_text("eval(x)\n")
    (tmp_path / "a.py").write_text("eval(x)\n")
    (tmp_path / ".gitignore").write_text("a.py\n")
    files = tree.read_targets(spark, [str(tmp_path), str(tmp_path / "dist" / "b.py")])
    assert sorted(r.path for r in files.collect()) == [f"{tmp_path}/a.py", f"{tmp_path}/dist/b.py"]
    got = scan(tree.read_tree(spark, str(tmp_path)), ScanConfig(only=("python",), respect_ignore_files=True, allow_empty=True))
    assert got.totals.first()["files"] == 0
    (tmp_path / "big.py").write_text("x" * (3 << 20))
    with pytest.raises(Exception, match="the limit is 1"):
        tree.read_tree(spark, str(tmp_path), ScanConfig(max_project_mb=1)).collect()
    own = [Rule("own.e", "python", 1, "line", "eval", "", ((0, "critical"),), "e", "")]
    result = scan(spark.createDataFrame([("a.py", "eval(1)"), ("b.js", "x")], "path string, text string"), ScanConfig(rule_globs=("own.*",)), own)
    reports = {r.language: r.value for r in sinks.module_reports(result.findings, result.summary, "now").collect()}
    assert '"count":1' in reports["python"] and '"findings":[]' in reports["js"]


def test_language_excludes(spark):
    rows = spark.createDataFrame([("Pods/a.swift", 1), ("Pods/a.py", 1), ("cmake-build-x/a.c", 1), ("deps.ex", 1), ("deps/a.ex", 1)], "path string, n_bytes long")
    assert sorted(r.path for r in P.prune(rows, ScanConfig()).collect()) == ["Pods/a.py", "deps.ex"]
    assert P.prune(rows, ScanConfig(excluded={})).count() == 5


def test_reports_in_every_format(spark):
    from textloom.config import FORMATS

    own = [Rule(f"own.e{k}", "python", 1, "line", "eval", "", ((0, "critical"),), "e", "") for k in (1, 2)]
    files = spark.createDataFrame([("a.py", "eval(1)")], "path string, text string")
    for kind in FORMATS:
        result = scan(files, ScanConfig(format=kind, rule_globs=("own.*",), max_details=1), own)
        rows = [r.value for r in result.report("p", "now").collect()]
        assert rows and all(isinstance(x, str) for x in rows), kind
        if kind == "text":
            assert "1 further findings are not shown" in rows[0]
        elif kind in ("json", "jsonl", "sarif", "compact"):
            assert any("own.e2" in x for x in rows), kind


def test_ambiguous_patterns():
    for p in (r"(a+)+$", r"(a*)*", r"(a|aa)+$", r"(ab|a|b)*$", r"(\w+\s*)+:", r"(\d+,?)+$", r"(.*)*x", r"([a-z]+)*\d", r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(x+x+)+y"):
        assert ambiguous(p), p
    for p in (r"a+b+", r"(ab+)+", r"\w+@\w+\.com", r"(a|b)*c", r"^\d{3}-\d{4}$", r"(\w+,)+", r"(?:[a-z]+-)*[a-z]+", r"x*y*z*", r"(?>a+)+b", r"(foo|bar)+", "", r"(a{1,3}b)+"):
        assert ambiguous(p) is False, p
    assert ambiguous("(") is None and ambiguous(None) is None and ambiguous("a" * 5000) is False and ambiguous("(" * 3000) is None


def test_ambiguity_is_what_a_matcher_runs_into():
    """Over small random patterns, a loop is ambiguous if counting its readings of a text grows without bound."""
    rng = random.Random(2)

    def make(depth):
        k = rng.randrange(6)
        if depth == 0 or k < 2:
            return rng.choice("ab")
        if k == 2:
            return f"(?:{make(depth - 1)}|{make(depth - 1)})"
        if k == 3:
            return f"{make(depth - 1)}{make(depth - 1)}"
        return f"(?:{make(depth - 1)}){rng.choice('+*')}" if k == 4 else f"(?:{make(depth - 1)})?"

    def readings(states, first, last, text):
        """How many ways the automaton reads a text from a first state on."""
        now = {p: 1 for p in first if states.sets[p] >> ord(text[0]) & 1}
        for c in text[1:]:
            new = {}
            for (p, q), n in states.follow.items():
                if p in now and states.sets[q] >> ord(c) & 1:
                    new[q] = new.get(q, 0) + n * now[p]
            now = new
        return sum(now.values())

    for _ in range(150):
        pattern = f"(?:{make(3)})+"
        states = _Positions()
        _, first, last = states.sequence(_parser.parse(pattern))
        texts = ["".join(rng.choice(x) for _ in range(60)) for x in ("a", "b", "ab")] + ["ab" * 30, "aab" * 20, "abb" * 20]
        most = max(readings(states, first, last, t) for t in texts)
        if most > 2**20:
            assert ambiguous(pattern), pattern
        elif not ambiguous(pattern):
            assert most <= 60**4, pattern


def test_trees_are_listed_by_tasks(spark, tmp_path):
    for k, name in enumerate(("a.py", "x/b.py", "x/y/z/c.js", "x/y/_d.py", ".h/e.py", "node_modules/f.js", "x/notes.txt", "x/requirements.txt")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * k)
    (tmp_path / "empty").mkdir()
    listed = tree.listed_tree(spark, str(tmp_path))
    want = {(r.path, r.n_bytes, r.text) for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert {(r.path, r.n_bytes, r.text) for r in tree.read_listed(listed, str(tmp_path)).collect()} == want and len(want) == 6


def test_sarif_in_parts(spark, tmp_path):
    import json

    own = [Rule(f"own.e{k}", "python", 1, "line", "eval", "", ((0, "critical"),), "e", "") for k in (1, 2)]
    result = scan(spark.createDataFrame([(f"d{k}.py", "eval(1)\neval(2)\n") for k in range(20)], "path string, text string"), ScanConfig(rule_globs=("own.*",)), own)
    sinks.write_sarif(result.occurrences, result.findings, str(tmp_path / "s"), per_file=7)
    (log,) = (json.loads(p.read_text()) for p in (tmp_path / "s" / "log").glob("part-*"))
    (run,) = log["runs"]
    assert run["tool"]["driver"]["name"] == "textloom-python"
    got = []
    for ref in run["externalPropertyFileReferences"]["results"]:
        part = json.loads((tmp_path / "s" / ref["location"]["uri"]).read_text())
        assert part["guid"] == ref["guid"] and len(part["results"]) == ref["itemCount"] <= 7
        got += [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["ruleId"]) for r in part["results"]]
    assert len(got) == 80 and len(set(got)) == 40


def test_resources_by_scope(spark):
    from textloom.operators.control import scoped_open

    rng = random.Random(6)
    scopes = [("p", 0, None)] + [("p", k, rng.randrange(k)) for k in range(1, 12)]
    up = {s: u for _, s, u in scopes}
    events = [("p", rng.randrange(12), rng.choice("xyz"), off, rng.random() < 0.5) for off in range(300)]
    depth = lambda s: 0 if up[s] is None else 1 + depth(up[s])
    left = {}
    moved = sorted(events, key=lambda e: e[3])
    for d in range(max(map(depth, up)), -1, -1):
        rest = []
        for p, s, name, off, opens in sorted(moved, key=lambda e: e[3]):
            if depth(s) != d:
                rest.append((p, s, name, off, opens))
            elif opens:
                left.setdefault((s, name), []).append(off)
            elif left.get((s, name)):
                left[s, name].pop()
            elif up[s] is not None:
                rest.append((p, up[s], name, off, opens))
        moved = rest
    want = {(s, name, off) for (s, name), offs in left.items() for off in offs}
    got = scoped_open(spark.createDataFrame(events, "path string, scope int, name string, off int, opens boolean"), spark.createDataFrame(scopes, "path string, scope int, up int"))
    assert {(r.scope, r.name, r.off) for r in got.collect()} == want


def test_texts_go_to_python_in_small_batches(spark):
    from textloom.functions.source import regions, statements
    from textloom.functions.syntax import syntax_nodes
    from textloom.operators.flow import flows
    from textloom.sources.steps import ARROW_ROWS, by_file

    def sized(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    text = "if (a.b) {\n  eval(req.query.a,\n    1);\n}\n"
    files = spark.range(0, 3000, 1, 1).selectExpr("concat(id, '.js') AS path", "'js' AS lang").withColumn("text", F.lit(text))
    for stage in (syntax_nodes, regions, statements, flows):
        for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
            spark.conf.unset(key)
        rows = stage(files)
        sizes = [r["n"] for r in rows.mapInArrow(sized, "n long").collect()]
        assert sum(sizes) == rows.count() >= 3000 and max(sizes) <= ARROW_ROWS
    many = by_file(spark.range(0, 3, 1, 1), ["id"], lambda k: ((k, x) for x in range(5001)), "id long, x int")
    assert many.distinct().count() == many.count() == 3 * 5001


def test_reports_do_not_read_texts_again(spark):
    from textloom.plans import checks, queries

    found, sums, _ = checks._sums(spark, "/root/testdata/sf0.001")
    every, _ = queries._occurred(spark, "/root/testdata/sf0.001")
    for frame in (found, sums, every):
        assert "parquet" not in frame._jdf.queryExecution().analyzed().toString()


def test_texts_that_matches_hold():
    from textloom.functions.text import literal_of, texts_of
    from textloom.plans.checks import _of_kind

    assert texts_of(r"(?i)\b\w*(pass|Secret)\w*\s*[:=]") == {"pass", "secret"}
    assert texts_of(r"(ab)?cde|fgh+") == {"cde", "fg"} or texts_of(r"(ab)?cde|fgh+") == {"cde", "fgh"}
    assert not texts_of(r"a|bcd") and not texts_of(r"(?:abc)*x") and not texts_of(r"[a[bc]]def]") and not texts_of(r"(?=abc)\w")
    loose = [r for r in _of_kind("line") if r.ignore_case or not literal_of(r.pattern)]
    assert sum(bool(texts_of(r.pattern)) for r in loose) > 100


def test_joined_files_are_made_once(spark):
    """where ignore rules and test modules take joins, a text is made for the one file that is written, not again for each kind of rule."""
    texts = {
        ".gitignore": "old/\n", "old/a.py": "redirect(request.args['n'])\n", "tests/b.py": "redirect(request.args['n'])\n", "src/lib.rs": "#[cfg(test)]\nmod t;\nuse old;\n", "src/t.rs": "fn f() {}\n",
        "src/a.py": "u = request.args['n']\nredirect(\n    u)\nredirect(\n    u,  # noqa\n    302)\n# NOQA\nredirect(u)\nredirect(u)\nc.execute('SELECT a FROM ' + b)\n#[cfg(test)]\nredirect(  # noqa\n    u)\n", "src/a.jsx": "useEffect(() => { load(id); }, [id, other]);\n",
    }
    made = spark.sparkContext.accumulator(0)

    def text(path):
        made.add(path == "src/a.py")
        return texts[path]

    files = spark.createDataFrame([(p,) for p in texts], "path string").withColumn("text", F.udf(text, "string")("path"))
    found = scan(files, ScanConfig(rule_globs=("js.hooks.*", "python.ordered.*", "python.sql_text.*"), respect_ignore_files=True, exclude_tests=True, statement_suppression=True))
    redirects = [("src/a.py", "python.ordered.redirect", n, hidden) for n, hidden in ((2, False), (4, True), (8, True), (9, False), (12, False))]
    assert sorted((r.path, r.rule_id, r.line_no, r.suppressed) for r in found.occurrences.collect()) == [("src/a.jsx", "js.hooks.missing", 1, False), ("src/a.jsx", "js.hooks.unused", 1, False), *redirects, ("src/a.py", "python.sql_text.unknown", 10, False)]
    assert sorted(r.path for r in found.files.collect()) == ["src/a.jsx", "src/a.py", "src/lib.rs"]
    assert made.value == 1


def test_texts_end_before_their_tests(spark):
    texts = ["fn a()\n#[cfg(test)]\nmod tests {\n}", "x\r\ny\n", "mod tests\nx", "", "x\n  mod tests;\n", "\n\n#[cfg(test)]"]
    files = spark.createDataFrame([(str(k), "rust", t) for k, t in enumerate(texts)], FILES)
    for previous in (False, True):
        got = explode_lines(files, previous=previous, until=P.TEST_MARKER)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.before_tests(explode_lines(files, previous=previous)).collect())) and got.count() == 6


def test_languages_leave_out_their_own_directories(spark):
    names = ["a.py", ".tox/a.py", "out/a.py", "out/a.js", "x/bazel-q/a.go", "x/bazel-q/a.py", "x/bazel-q", "a/.tox/b/c.PY", "node_modules/a.py", "a/dist", "q/dist/a.rs", "n.dist/a.rs", "noext", ".js", "a.b.rs", "tmp/d.rb", "tmp/d.rs", "./a.py", "//a.py", "cmake-build-1/a.c"]
    kept = P.prune(spark.createDataFrame([(n,) for n in names], "path string"), ScanConfig())
    assert sorted((r.path, r.ext, r.lang) for r in kept.collect()) == sorted([("a.py", "py", "python"), ("out/a.py", "py", "python"), ("x/bazel-q/a.py", "py", "python"), ("n.dist/a.rs", "rs", "rust"), (".js", "js", "js"), ("a.b.rs", "rs", "rust"), ("tmp/d.rs", "rs", "rust"), ("./a.py", "py", "python"), ("//a.py", "py", "python")])

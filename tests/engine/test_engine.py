import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textloom.config import PACKS, ScanConfig, languages
from textloom.functions.source import brace_regions, ingest_matches, masked, plist_settings, python_matches, python_regions, regex_matches, regions
from textloom.functions.text import explode_lines, glob_regex, ignored, java_regex, line_of, match_record, matches, number_literal, without_ansi
from textloom.operators import aggregate as A
from textloom.operators import correlate as C
from textloom.operators import lines as L
from textloom.operators import prune as P
from textloom.operators.flow import FlowSpec, flow_specs, flows, trace
from textloom.operators.lifecycle import dropped_tasks, hooks, unreleased
from textloom.plans.catalogue import Rule, rules, variants
from textloom.plans.scan import scan
from textloom.sources import sinks, tree


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


FILES = "path string, lang string, text string"


def test_lines_are_numbered_and_breaks_end_them(spark):
    got = explode_lines(frame(spark, [("a", "js", "x\r\ny\rz\n"), ("b", "js", "\n\nq"), ("c", "js", ""), ("d", "js", None)], FILES)).orderBy("path", "line_no").collect()
    assert [(r["path"], r["line_no"], r["line"]) for r in got] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, ""), ("b", 2, ""), ("b", 3, "q")]


def test_text_functions(spark):
    one = spark.range(1)
    assert java_regex("a[[:space:]]b[^[:alnum:]_]") == r"a[\s]b[^A-Za-z0-9_]"
    r = one.select(matches(F.lit("a == None"), "==[[:space:]]*None").alias("a"), matches(F.lit("TODOs todo"), "todo", word=True).alias("b"), matches(F.lit("TODO"), "todo", ignore_case=True).alias("c"), matches(F.lit("TODOs"), "todo", True, True).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (True, True, True, False)
    r = one.select(match_record(F.lit("C:/x:y.js:12:let a: b")).alias("m"), match_record(F.lit("none")).alias("n"), without_ansi(F.lit("\x1b[31mred\x1b[0m")).alias("p")).first()
    assert tuple(r.m) == ("C:/x:y.js", 12, "let a: b") and r.n is None and r.p == "red"
    values = {"0": 0, "0x1F": 31, "0b101": 5, "0o17": 15, "1_000": 1000, "2.5": 2.5, "1e3": 1000, "x": None, "": None}
    got = frame(spark, [(k,) for k in values], "t string").select("t", number_literal(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == values
    assert one.select(line_of(F.lit("a\nbé\nc"), F.lit(4)).alias("n")).first().n == 2
    import fnmatch, re

    for glob in ("*.js", "a?c", "[ab]*", "[!a]x", "dist", "a.b", "x[", "**/y"):
        for name in ("a.js", "abc", "bx", "dist", "a.b", "axb", "x[", "z/y", "ax"):
            assert bool(re.fullmatch(glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


def test_ignores_and_languages(spark):
    paths = ["src/a.js", "node_modules/x/b.js", "lib/dist/c.py", "dist.py", "pkg/.venv/d.py", "Gemfile", "a/b.RS", "noext"]
    df = frame(spark, [(p,) for p in paths], "path string")
    assert sorted(r.path for r in df.where(ignored(F.col("path"), ScanConfig().ignores)).collect()) == ["lib/dist/c.py", "node_modules/x/b.js", "pkg/.venv/d.py"]
    kept = P.prune(df, ScanConfig(only=("javascript", "python", "rs")))
    assert sorted((r.path, r.lang) for r in kept.collect()) == [("a/b.RS", "rust"), ("dist.py", "python"), ("src/a.js", "js")]
    assert {r.lang: r.n_files for r in P.detected_languages(df).collect()} == {"js": 2, "python": 3, "ruby": 1, "rust": 1}
    assert languages(["js", "py", "go", "js"], only=["golang", "python"], exclude=["go"]) == ["python"]
    big = frame(spark, [(f"gen/{k}.js", 10) for k in range(201)] + [("src/a.js", 3 << 20)], "path string, n_bytes long")
    assert [tuple(r) for r in P.suggested_ignores(big, ScanConfig()).collect()] == [("gen", 201)]
    with pytest.raises(ValueError):
        P.guard_size(big, ScanConfig(max_project_mb=2))
    assert sorted(r.path for r in P.targets(df, frame(spark, [("node_modules/x/b.js",)], "path string"), ScanConfig(only=("js",))).collect()) == ["node_modules/x/b.js", "src/a.js"]
    assert P.changed_or_all(df, None).count() == 8 and P.changed_only(df, df.limit(0)).count() == 0 and P.without(df, df).count() == 0
    with pytest.raises(ValueError):
        tree.guard_root("/")


def test_test_code_is_left_out(spark):
    lines = explode_lines(frame(spark, [("a.rs", "rust", "fn a()\n#[cfg(test)]\nmod tests {\n}"), ("b.rs", "rust", "x\ny")], FILES))
    assert sorted((r.path, r.line_no) for r in P.before_tests(lines).collect()) == [("a.rs", 1), ("b.rs", 1), ("b.rs", 2)]
    edges = frame(spark, [("lib", "t", True), ("t", "helper", False), ("lib", "core", False), ("t", "core", False), ("helper", "deep", False)], "src string, dst string, gated boolean")
    assert sorted(r.path for r in P.test_only_modules(edges).collect()) == ["deep", "helper", "t"]


def test_every_line_rule_is_found_in_one_pass_and_in_one_aggregation(spark):
    chosen = [r for r in rules() if r.kind == "line" and r.lang in ("python", "js")]
    text = "import os\nx = eval(a)\npassword = 'hunter2hunter2'\nif a == None: pass\n# TODO and todo\nhashlib.md5(b)\n"
    lines = L.mark_suppressed(explode_lines(frame(spark, [("a.py", "python", text), ("b.js", "js", "a == NaN\nconsole.log(password)\n"), ("c.txt", "text", text)], FILES)))
    found = L.occurrences(lines, chosen)
    one = {(r.lang, r.rule_id): r.n for r in A.counts(found).collect()}
    assert one[("python", "python.eval")] == 1 and one[("js", "js.nan_equality")] == 1 and one[("js", "js.log_secrets")] == 1 and one[("python", "python.debt")] == 1
    assert all(k[0] in ("python", "js") for k in one)
    two = {(r.lang, r.rule_id): r.n for r in L.one_pass_counts(lines, chosen).collect()}
    assert {k: n for k, n in two.items() if n} == one


#: A line that each of these rules must find, and one that it must not.
PAIRS = [
    ("python.shell", "subprocess.run(x, shell=True)", "subprocess.run([x])"),
    ("python.deserialise", "yaml.load(f)", "yaml.load(f, Loader=SafeLoader)"),
    ("python.mutable_default", "def f(a, b=[]):", "def f(a, b=None):"),
    ("python.wildcard_import", "from x import *", "from x import y"),
    ("python.bare_except", "    except:", "    except ValueError:"),
    ("python.no_encoding", "f = open(p)", "f = open(p, encoding='utf-8')"),
    ("js.loose_equality", "if (a == b) {", "if (a === b) {"),
    ("js.html", "el.innerHTML = x;", "el.innerHTML = DOMPurify.sanitize(x);"),
    ("js.tls_off", "rejectUnauthorized: false", "rejectUnauthorized: true"),
    ("js.parse_int", "parseInt(x)", "parseInt(x, 10)"),
    ("golang.tls_off", "InsecureSkipVerify: true", "InsecureSkipVerify: false"),
    ("golang.ignored_error", "_ = f(x)", "for _, v := range f(x) {"),
    ("golang.unlimited_body", "b, err := io.ReadAll(r.Body)", "b, err := io.ReadAll(io.LimitReader(r.Body, 9))"),
    ("rust.force", "x.unwrap()", "// x.unwrap()"),
    ("rust.unsafe", "unsafe { f() }", "let unsafe_name = 1;"),
    ("rust.tls_off", "danger_accept_invalid_certs(true)", "danger_accept_invalid_certs(false)"),
    ("java.weak_hash", 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    ("java.string_identity", 'if (s == "x")', 's.equals("x")'),
    ("java.sql", 'q = "SELECT * FROM t WHERE a=" + a;', 'q = "SELECT 1";'),
    ("ruby.bare_except", "rescue Exception => e", "rescue ArgumentError => e"),
    ("ruby.tls_off", "http.verify_mode = OpenSSL::SSL::VERIFY_NONE", "VERIFY_PEER"),
    ("ruby.shell", 'system("ls #{x}")', 'system("ls", x)'),
    ("swift.force", "let a = b!.c", "if a != b {"),
    ("swift.main_thread", "DispatchQueue.main.sync { }", "DispatchQueue.main.async { }"),
    ("csharp.async_void", "public async void Go()", "public async Task Go()"),
    ("csharp.deserialise", "new BinaryFormatter()", "new JsonFormatter()"),
    ("elixir.atoms", "String.to_atom(x)", "String.to_existing_atom(x)"),
    ("elixir.deserialise", ":erlang.binary_to_term(x)", ":erlang.binary_to_term(x, [:safe])"),
    ("cpp.raw_memory", "strcpy(a, b);", "strncpy(a, b, 3);"),
    ("cpp.wildcard_import", "using namespace std;", "using std::string;"),
    ("cpp.macro", "#define SQ(x) x*x", "#define SQ(x) ((x)*(x))"),
]


def test_rules_find_and_leave(spark):
    by = {r.rule_id: r for r in rules()}
    rows = [(f"{rule}|{k}", by[rule].lang, line) for rule, *pair in PAIRS for k, line in enumerate(pair)]
    found = {(r.path, r.rule_id) for r in L.occurrences(explode_lines(frame(spark, rows, FILES)), [by[p[0]] for p in PAIRS]).collect()}
    for rule, *_ in PAIRS:
        assert (f"{rule}|0", rule) in found and (f"{rule}|1", rule) not in found, rule


def test_catalogue_is_sound():
    found = rules()
    assert len({r.rule_id for r in found}) == len(found) and {s for r in found for _, s in r.tiers} <= set(A.RANKS)
    assert {r.lang for r in rules(ScanConfig(pack="resource-lifecycle"))} <= set(PACKS["resource-lifecycle"])
    assert all(r.category != 7 for r in rules(ScanConfig(skip_categories={"": (7,)})))
    assert {r.category for r in rules(ScanConfig(only=("python",), only_categories={"python": (6,)}))} == {6}
    assert {r.rule_id for r in rules(ScanConfig(rule_globs=("*.eval",), disabled_globs=("ruby.*",)))} == {"js.eval", "python.eval", "elixir.eval", "java.eval"}
    assert [v.rule_id for v in variants(found[0], {"ts": "-ts", "tsx": "-tsx"})] == [found[0].rule_id + "-ts", found[0].rule_id + "-tsx"]
    assert not any(".debug" in r.rule_id for r in rules(ScanConfig(profile="loose")))


def test_suppression(spark):
    lines = explode_lines(frame(spark, [("a", "js", "x // NOQA\ny\nz\nscan:ignore"), ("b", "js", "w")], FILES))
    hidden = lambda **k: [r.line for r in L.mark_suppressed(lines, **k).where("suppressed").orderBy("path", "line_no").collect()]
    assert hidden() == ["x // NOQA", "y", "scan:ignore"]
    assert hidden(previous_line=False) == ["x // NOQA", "scan:ignore"]
    assert hidden(markers=("scan:ignore",), ignore_case=False) == ["scan:ignore"]
    occ = frame(spark, [("a", 2), ("a", 3), ("b", 1)], "path string, line_no int")
    spans = frame(spark, [("a", 2, 3), ("b", 1, 1)], "path string, s_line int, e_line int")
    assert sorted(tuple(r) for r in L.suppressed_statements(occ, spans, lines).collect()) == [("b", 1)]


def test_balances_missing_partners_and_ratios(spark):
    files = [("a.py", "python", "f = open(x)\ng = open(y)\nf.close()\n"), ("b.py", "python", "with open(x) as f:\n"), ("c.java", "java", "Executors.newFixedThreadPool(1)\n"), ("d.java", "java", "Executors.newFixedThreadPool(1)\npool.shutdown()\n"), ("e.js", "js", "setTimeout(f)\nsetTimeout(g)\nclearTimeout(t)\n")]
    lines = explode_lines(frame(spark, files, FILES))
    assert [(r.path, r.rule_id, r.acquired, r.released, r.n) for r in L.balances(lines, [r for r in rules() if r.rule_id == "python.balance.unclosed_file"]).collect()] == [("a.py", "python.balance.unclosed_file", 2, 1, 1)]
    assert [(r.path, r.rule_id) for r in L.lacking(lines, rules()).collect()] == [("c.java", "java.file_without.executor_without_shutdown")]
    assert [(r.rule_id, r.n) for r in L.ratios(lines, rules()).collect()] == [("js.ratio.timers_cleared", 1)]


def test_windows_over_lines(spark):
    text = "def f():\n    return 1\n    x = 2\n\n    raise E(\n    a)\nelse:\n"
    lines = explode_lines(frame(spark, [("a.py", "python", text)], FILES))
    assert [r.line_no for r in L.unreachable(lines).collect()] == [3]
    got = lines.select("line_no", L.context_has(lines, r"\breturn\b", 1, 0).alias("h")).where("h").collect()
    assert sorted(r.line_no for r in got) == [2, 3]
    d = L.debt_markers(explode_lines(frame(spark, [("a", "js", "TODO fixme\nNOTE\nHACK")], FILES))).first()
    assert (d.todo, d.fixme, d.hack, d.xxx, d.note, d.total) == (1, 1, 1, 0, 1, 3)


def test_findings_tiers_samples_and_sums(spark):
    tiers = ((20, "warning"), (10, "info"))
    chosen = [Rule(f"r{k}", "js", 1 + k // 2, "line", "x", "", tiers, "t", "d") for k in range(4)]
    occ = frame(spark, [("js", 1, f"r{k}", f"p{n:02}", n, "c", False) for k, m in ((0, 21), (1, 20), (2, 10)) for n in range(m)] + [("js", 1, "r2", "p", 1, "c", True)], "lang string, category int, rule_id string, path string, line_no int, code string, suppressed boolean")
    found = A.findings(spark, A.counts(occ), chosen, A.samples(occ, 2))
    assert sorted((r.rule_id, r.severity, r.n, [s.line for s in r.samples]) for r in found.collect()) == [("r0", "warning", 21, [0, 1]), ("r1", "info", 20, [0, 1]), ("r2", "good", 10, [0, 1]), ("r3", "good", 0, [])]
    sums = A.summary(found, frame(spark, [("js", "a"), ("js", "a"), ("go", "b")], "lang string, path string"))
    assert sorted(tuple(r) for r in sums.collect()) == [("go", 1, 0, 0, 0), ("js", 1, 0, 21, 20)]
    assert tuple(A.totals(sums).first()) == (2, 0, 21, 20)
    cats = frame(spark, [("js", 1), ("js", 2), ("js", 3)], "lang string, category int")
    assert sorted((r.category, r.critical, r.warning, r.info, r.total) for r in A.matrix(found, cats).collect()) == [(1, 0, 21, 20, 41), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    assert [r.rule_id for r in A.worst_first(found).collect()] == ["r0", "r1", "r2", "r3"]
    assert {(r.lang, r.severity, r.n) for r in A.subtotals(found).collect()} == {("js", "warning", 21), ("js", "info", 20), ("js", None, 41), (None, None, 41)}
    assert A.at_least(found, "warning").count() == 1
    diff = A.difference(A.totals(sums), frame(spark, [("5", "x")], "critical string, warning string"), [], ["critical"]).first()
    assert (diff.critical, diff.critical_baseline, diff.critical_delta) == (0, 5, -5)
    metrics = frame(spark, [("js", 1, {"a": "1", "b": "2"}), ("js", 2, {"a": "3"})], "lang string, seq int, payload map<string,string>")
    assert A.merged_metrics(metrics).first().payload == {"a": "3", "b": "2"}
    assert [A.exit_code(*x) for x in ((0, 0, 1, True), (1, 0, 1, False), (0, 1, 1, False), (0, 1, 1, True), (0, 0, 0, False))] == [0, 1, 0, 1, 3]
    assert [r.s for r in frame(spark, [(x,) for x in ("Error", "medium", "hint", "?")], "x string").select(A.normal_severity(F.col("x")).alias("s")).collect()] == ["critical", "warning", "info", "info"]


def test_masking_keeps_offsets():
    for lang, text in (("js", "a /* x { */ 'b{' `c\n{` // d\ne{}"), ("python", 'x = """a\n#"""  # c\ny = \'#\' + f"z"'), ("rust", 'let a = r#"{"#; // x\nlet l: &\'a str = \'{\';'), ("golang", "`{\n`//{\n{}"), ("ruby", "x = '#{' # {\n")):
        out = masked(text, lang)
        assert len(out) == len(text) and [k for k, c in enumerate(text) if c == "\n"] == [k for k, c in enumerate(out) if c == "\n"]
        assert out.count("{") == out.count("}")


def test_regions_matches_and_containment(spark):
    rust = "async fn f() {\n    std::thread::sleep(d);\n    spawn(move || {\n        std::thread::sleep(d);\n    });\n}\nfn g() {\n    std::thread::sleep(d);\n}\n"
    assert [r[0] for r in brace_regions(rust, "rust")] == ["async", "closure", "function"]
    assert {r[0] for r in python_regions("async def f():\n  for x in y:\n    pass\ntry:\n  pass\nexcept E:\n  pass\n")} == {"async", "loop", "try", "catch"}
    files = frame(spark, [("a.rs", "rust", rust)], FILES)
    found = regex_matches(files, {"sleep": ("rust", r"thread::(?P<F>sleep)\(")})
    assert sorted(r.s_line for r in found.collect()) == [2, 4, 8] and found.first().captures["F"].text == "sleep"
    assert [r.s_line for r in C.in_context(found, regions(files), ["async"], ["closure"]).collect()] == [2]
    assert [r.s_line for r in C.outside(found, regions(files).where("kind = 'async'")).collect()] == [8]
    explained = C.outside(found, regions(files))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in explained and "NestedLoop" not in explained
    guards = frame(spark, [("p", "and", *range(4), *range(4, 8), *range(8, 12)), ("p", "membership", *range(4), *range(4, 8), *range(8, 12)), ("p", "plain", *range(4), *range(4, 8), *range(8, 12))], "path string, form string, " + ", ".join(f"{a}_{b} int" for a in ("cond", "body", "whole") for b in ("s_line", "s_col", "e_line", "e_col")))
    assert [r.s_line for r in C.guard_regions(guards).collect()] == [0, 8, 4]


def test_python_syntax(spark):
    text = "import json\nx = a.b.c.d.e\ny = 1 / n\nz = 1 / 2\nif x is 'a': pass\nfor i in xs:\n    xs.append(i)\ntry:\n    json.loads(s)\nexcept:\n    pass\njson.loads(t)\ndef f():\n    try: pass\n    finally:\n        return 1\n"
    found = python_matches(frame(spark, [("a.py", "python", text), ("bad.py", "python", "def (")], FILES))
    got = sorted((r.rule_id, r.s_line) for r in found.collect())
    assert got == [("py.bare_except", 10), ("py.deep_access", 2), ("py.division", 3), ("py.division", 4), ("py.except_pass", 10), ("py.finally_exit", 16), ("py.is_literal", 5), ("py.json_unguarded", 12), ("py.mutated_loop", 7)]
    assert [r.s_line for r in C.risky_divisions(found.where("rule_id = 'py.division'")).collect()] == [3]


def test_resources_as_relations(spark):
    ev = [("p", "f", 1, True), ("p", "f", 2, True), ("p", "f", 3, False), ("p", "g", 1, False), ("p", "g", 2, True), ("q", "f", 5, True), ("q", "f", 6, False), ("q", "f", 7, False), ("q", "f", 8, True)]
    df = frame(spark, ev, "path string, name string, off int, opens boolean")
    assert sorted(tuple(r) for r in C.latest_open(df).collect()) == [("p", "f", 1), ("p", "g", 2), ("q", "f", 8)]
    a, r = df.where("opens"), df.where("NOT opens")
    assert sorted((x.path, x.name, x.off) for x in C.without_partner(a, r).collect()) == [("p", "g", 2), ("q", "f", 8)]
    left = frame(spark, [("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = frame(spark, [("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, at int, v string")
    assert sorted((x.k, x.at, x.v or "") for x in C.as_of(left, right, ["k"], "at", "v").collect()) == [("a", 1, ""), ("a", 5, "y"), ("b", 9, "")]
    assert sorted((x.k, x.at, x.v or "") for x in C.as_of(left, right, ["k"], "at", "v", latest=False).collect()) == [("a", 1, "x"), ("a", 5, "y"), ("b", 9, "")]
    files = frame(spark, [("a.jsx", "js", "useEffect(() => { const z = 1; load(id, z); setX(z); }, [id, other]);")], FILES)
    assert [(list(x.missing), list(x.unused)) for x in C.dependency_gaps(hooks(files)).collect()] == [(["load"], ["other"])]
    links = C.with_permalinks(frame(spark, [("a", 3), ("b", 4)], "path string, line_no int"), "https://x/blob/1/", frame(spark, [("a",)], "path string"))
    assert sorted((x.path, x.url) for x in links.collect()) == [("a", "https://x/blob/1/a#L3"), ("b", None)]


FLOWS = [
    ("python", "sql", "q = request.args['q']\ncursor.execute('SELECT ' + q)\n", "q = request.args['q']\ncursor.execute('SELECT ?', (q,))\n"),
    ("python", "path", "name = request.args.get('f')\nopen(name)\n", "name = secure_filename(request.args.get('f'))\nopen(name)\n"),
    ("python", "redirect", "u = request.args['next']\nv = u\nredirect(v)\n", "u = request.args['next']\nif urlparse(u).netloc in allowed:\n    redirect(u)\n"),
    ("python", "command", "subprocess.run(\n    'ls ' + request.args['d'],\n    shell=True)\n", "subprocess.run('ls ' + shlex.quote(request.args['d']))\n"),
    ("golang", "outbound", "u := r.FormValue(\"u\")\nhttp.Get(u)\n", "u := \"https://fixed\"\nhttp.Get(u)\nr.FormValue(\"u\")\n"),
    ("js", "regex", "const p = req.query.p;\nnew RegExp(p);\n", "const p = escapeRegExp(req.query.p);\nnew RegExp(p);\n"),
    ("js", "markup", "const a = req.body.a;\nel.innerHTML = a;\n", "const a = req.body.a;\nel.textContent = a; el.innerHTML = 'x';\n"),
    ("java", "header", "String v = request.getParameter(\"v\");\nresponse.setHeader(\"X\", v);\n", "String v = \"a\";\nresponse.setHeader(\"X\", v);\nrequest.getParameter(\"v\");\n"),
    ("ruby", "redirect", "u = params[:u]\nredirect_to u\n", "u = params[:u]\nredirect_to root_path\n"),
    ("csharp", "sql", "var q = Request.Query[\"q\"];\ndb.FromSqlRaw(\"select \" + q);\n", "var q = Request.Query[\"q\"];\ndb.FromSqlRaw(\"select 1\");\n"),
    ("elixir", "path", "p = conn.params\nFile.read(p)\n", "p = conn.params\np = \"fixed\"\nFile.read(p)\n"),
    ("rust", "command", "let a = std::env::args();\nCommand::new(a);\n", "let a = std::env::args();\nCommand::new(\"ls\");\n"),
    ("cpp", "command", "auto c = req.get_param_value(\"c\");\nsystem(c);\n", "auto c = req.get_param_value(\"c\");\nsystem(\"ls\");\n"),
    ("swift", "outbound", "let u = req.query\nURL(string: u)\n", "let u = req.query\nURL(string: \"x\")\n"),
]


@pytest.mark.parametrize(("lang", "family", "bad", "good"), FLOWS)
def test_flows(lang, family, bad, good):
    spec = next(s for s in flow_specs() if s.rule_id == f"{lang}.flow.{family}")
    assert trace(bad, spec), (lang, family)
    assert not trace(good, spec), (lang, family)
    assert not trace(bad.replace("\n", " // scan:ignore\n"), spec)


def test_flow_rounds_and_trails(spark):
    spec = FlowSpec("x", "python", 7, "critical", r"\bsource\b", r"\bsink\s*\(", r"\bclean\s*\(", passes=5, path=3)
    chain = "sink(e)\ne = d\nd = c\nc = b\nb = a\na = source\nsink(clean(a))\nsink('a')\n"
    got = trace(chain, spec)
    assert [(n, t) for n, _, t in got] == [(1, ["d", "e", "sink"])]
    files = frame(spark, [("a.py", "python", chain), ("b.py", "python", None), ("c.js", "js", chain)], FILES)
    assert [(r.path, r.line_no) for r in flows(files, [spec]).collect()] == [("a.py", 1)]


def test_lifecycles_narrowing_and_dropped_work():
    py = "import io as q\nf = open(a)\ng = q.open(b)\ng.close()\nwith open(c) as h:\n    pass\ndef k():\n    r = open(d)\n    return r\ndef m():\n    p = open(e)\n    p.read()\nopen(z).read()\n"
    assert [(x[0], x[1]) for x in unreleased(py, "python")] == [(2, "file"), (11, "file"), (13, "file")]
    assert [x[2] for x in unreleased("f, err := os.Open(a)\ng, err := os.Open(b)\ndefer g.Close()\n", "golang")] == ["f"]
    assert [x[2] for x in unreleased('std::thread t(f);\nstd::thread u(f);\nu.join();\nchar* p = (char*)malloc(3);\n', "cpp")] == ["t", "p"]
    assert [x[2] for x in unreleased("var a = new FileStream(x);\nusing var b = new FileStream(y);\n", "csharp")] == ["a"]
    assert [x[0] for x in dropped_tasks("SaveAsync(x);\nawait SaveAsync(y);\nvar t = SaveAsync(z);\n", "csharp")] == [1]


def test_tree_source(spark, tmp_path):
    for name, text in {"__init__.py": "x=1", ".hidden.js": "a", "pkg/a.py": "é\n", "node_modules/x.js": "b", "README.md": "c", "requirements.txt": "flask\n", "bad.rb": None, "big.py": "x" * 2000}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"\xff\xfe" if text is None else text.encode())
    got = {r.path: (r.lang, r.n_bytes, r.text) for r in tree.read_tree(spark, str(tmp_path), ScanConfig(max_file_bytes=1000)).collect()}
    assert sorted(got) == [".hidden.js", "__init__.py", "bad.rb", "pkg/a.py", "requirements.txt"]
    assert got["pkg/a.py"] == ("python", 3, "é\n") and got["bad.rb"][2] == "\ufffd\ufffd"
    (tmp_path / ".ignore").write_text("# c\n./dist/\n\n*.min.js\ndist\n")
    assert tree.read_ignores(spark, str(tmp_path / ".ignore")) == ["dist", "*.min.js"]
    status = frame(spark, [("M\ta.py",), ("D\tb.py",), ("R100\tc.py\td.py",)], "value string")
    assert sorted(r.path for r in tree.changed_paths(status).collect()) == ["a.py", "d.py"]
    assert sorted(r.path for r in tree.listed_paths(spark, "a, b,,a").collect()) == ["a", "b"]


def test_foreign_inputs(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"totals": {"critical": 3, "warning": "x"}, "scanners": []}))
    assert tuple(tree.read_baseline(spark, str(tmp_path / "b.json")).first()) == (0, 3, 0, 0)
    assert tuple(tree.read_baseline(spark, str(tmp_path / "none.json")).first()) == (0, 0, 0, 0)
    (tmp_path / "r.txt").write_text("Critical: 1\nTotals\nFiles: 9\nCritical: 4\nWarning: 5\nInfo: 6\n")
    assert tuple(tree.read_text_baseline(spark, str(tmp_path / "r.txt")).first()) == (9, 4, 5, 6)
    one = {"ruleId": "r", "file": "a", "lines": "x", "range": {"start": {"line": 0, "column": 2}, "end": {"row": 1, "column": 0}}, "metaVariables": {"single": {"A": {"text": "q", "range": {"start": {"line": 0, "column": 2}, "end": {"line": 0, "column": 3}}}}}}
    m = ingest_matches(frame(spark, [(json.dumps(one),), ("broken",), ("{}",)], "value string")).collect()
    assert [(r.rule_id, r.s_line, r.s_col, r.e_line, r.e_col, r.captures["A"].text, r.captures["A"].s_col) for r in m] == [("r", 1, 3, 2, 1, "q", 3)]
    plist = '<?xml version="1.0"?><plist version="1.0"><dict><key>A</key><dict><key>B</key><true/></dict></dict></plist>'
    files = frame(spark, [("Info.plist", plist), ("bad.plist", "<"), ("x.ipynb", json.dumps({"cells": [{"cell_type": "code", "outputs": [{"a": 1}]}, {"cell_type": "markdown"}]})), ("a.sarif", json.dumps({"runs": [{"results": [{"level": "error"}, {}, {"level": "note"}]}]})), ("b.sarif", "no")], "path string, text string")
    assert [tuple(r) for r in plist_settings(files).collect()] == [("Info.plist", "A.B", "true")]
    assert [tuple(r) for r in tree.notebook_outputs(files).collect()] == [("x.ipynb", 2, 1)]
    assert [tuple(r) for r in tree.sarif_counts(files.where("path LIKE '%sarif'")).collect()] == [("a.sarif", 0, 1, 1, 1)]


def test_scan_and_reports(spark, tmp_path):
    bad = "import os\nq = request.args['q']\ncursor.execute('SELECT ' + q)\nf = open(q)\nos.system(q)  # noqa\n\nx = eval(q)\n"
    files = frame(spark, [("a.py", bad), ("b.js", "if (a == NaN) {}\n"), ("requirements.txt", "flask\nx==1\n"), ("node_modules/c.js", "eval(x)")], "path string, text string")
    result = scan(files, ScanConfig())
    found = {r.rule_id: r for r in result.findings.collect()}
    for rule, n in (("python.eval", 1), ("python.flow.sql", 1), ("python.flow.path", 1), ("python.shell", 0), ("python.flow.command", 0), ("js.nan_equality", 1), ("js.eval", 0), ("python.balance.unclosed_file", 1), ("python.lifecycle.named", 1), ("python.unpinned", 1)):
        assert found[rule].n == n, rule
    t = result.totals.first()
    assert t.files == 2 and t.critical >= 5 and result.exit_code() == 1
    assert found["python.eval"].samples[0].file == "a.py" and found["python.eval"].samples[0].line == 7
    lines = sinks.jsonl(result.findings, result.summary, result.totals)
    sinks.write_jsonl(lines, str(tmp_path / "j"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert [r["type"] for r in rows][-1] == "totals" and rows[0]["severity"] == "critical" and len({r["type"] for r in rows}) == 3
    assert sinks.jsonl(result.findings, result.summary, result.totals, True).count() == 3
    report = json.loads(sinks.combined(result.findings, result.summary, result.totals, "p", "now").first().value)
    assert report["totals"]["files"] == 2 and {s["language"] for s in report["scanners"]} == {"python", "js"} and report["scanners"][0]["findings"]
    sarif = [json.loads(r.value) for r in sinks.sarif(result.occurrences, result.findings, "a", "repo", "rev").collect()]
    assert all(r["message"]["text"] and r["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for s in sarif for r in s["runs"][0]["results"])
    both = json.loads(sinks.merged_sarif(frame(spark, [(json.dumps(s),) for s in sarif] + [("x",)], "value string")).first().value)
    assert len(both["runs"]) == 2
    delta = A.difference(result.totals, frame(spark, [(1, 0, 0, 0)], "files long, critical long, warning long, info long"), [], ["files", "critical", "warning", "info"])
    shared = json.loads(sinks.shareable(sinks.combined(result.findings, result.summary, result.totals, "p", "now"), delta, "now", {"repository": "r", "commit": None}, "base.json").first().value)
    assert shared["comparison"]["delta"]["files"] == 1 and shared["git"]["repository"] == "r" and shared["project"] == "p"
    assert "further findings are not shown" in sinks.text(result.findings, result.summary, result.totals, "p", 1)
    assert "Combined totals" in sinks.text(result.findings, result.summary, result.totals, "p") and "<table>" in sinks.html(result.summary, delta, "p<") and "totals:" in sinks.toon(result.findings, result.totals)
    cats = result.findings.select("lang", "category").distinct()
    assert sinks.markdown(A.matrix(result.findings, cats)).startswith("| lang |")


@pytest.mark.parametrize("change", [lambda t: t.replace("\n", "\r\n"), lambda t: "\n\n" + t, lambda t: t + "# a harmless remark\n"])
def test_harmless_changes_leave_the_counts(spark, change):
    text = "import os\nq = request.args['q']\ncursor.execute('SELECT ' + q)\nf = open(q)\nx = eval(q)\nTODO = 1\n"
    count = lambda t: {r.rule_id: r.n for r in scan(frame(spark, [("a.py", t)], "path string, text string"), ScanConfig(only=("python",))).findings.collect()}
    assert count(change(text)) == count(text)


def test_empty_scan(spark):
    result = scan(frame(spark, [], "path string, text string"), ScanConfig(only=("js",)))
    assert tuple(result.totals.first()) == (0, 0, 0, 0) and result.exit_code() == 3 and replace(result, config=ScanConfig(allow_empty=True)).exit_code() == 0 and result.findings.where("n > 0").count() == 0


def test_user_rules(spark, tmp_path):
    from textloom.plans.catalogue import read_rules, rules_frame

    (tmp_path / "own.json").write_text('{"rule_id": "own.foo", "lang": "js", "pattern": "foo\\\\(", "tiers": [{"min_n": 1, "severity": "critical"}]}\n{"lang": "js"}\n')
    own = read_rules(spark, str(tmp_path))
    assert [(r.rule_id, r.pattern, r.tiers, r.category) for r in own] == [("own.foo", "foo\\(", ((1, "critical"),), 0)]
    files = frame(spark, [("a.js", "foo(1)\nfoo(2)\n")], "path string, text string")
    found = scan(files, ScanConfig(only=("js",), rule_globs=("own.*",)), own).findings.collect()
    assert [(r.rule_id, r.severity, r.n) for r in found] == [("own.foo", "critical", 2)]
    assert rules_frame(spark, own).first().kind == "line"


def test_families_have_an_implementation(spark):
    from textloom.plans.scan import all_rules

    ids = {r.rule_id for r in all_rules(ScanConfig())}
    assert {x for x in ids if x.endswith(".narrowing")} == {f"{x}.narrowing" for x in ("java", "js", "csharp", "swift", "rust", "golang", "cpp", "python", "ruby")}
    assert {x for x in ids if x.endswith(".async.dropped")} == {f"{x}.async.dropped" for x in ("csharp", "js", "rust", "elixir", "java", "swift", "golang", "cpp", "ruby", "python")}
    files = [
        ("a.js", "x = a / b;\ny = a / 2; // c / d\nz = a / Math.PI;\nw = p.q.r.s;\nif (p.q.r.s) {\n  v(p.q.r.s);\n}\n"),
        ("a.cpp", "".join(f"int x{k} = a / b{k};\n" for k in range(16)) + "std::async(f);\nauto g = std::async(f);\n"),
        ("a.rs", "let x = a / b;\n"),
        ("a.rb", "x = a / b\ny = a / 10\nz = p.q.r.s\nw = p&.q.r.s.t\nThread.new { f }\n"),
        ("b.rb", "a = 3.times.map do |i|\n  Thread.new do\n    f\n  end\nend\na.each(&:join)\n"),
        ("a.py", "import asyncio\nasync def f():\n    asyncio.create_task(g())\n    t = asyncio.create_task(h())\n    await t\n"),
        ("a.ex", "        case x do\n" * 11),
    ]
    globs = ("*.division", "*.deep_access", "*.deep_nesting", "*.dropped", "*.lifecycle.named")
    found = {r.rule_id: r.n for r in scan(frame(spark, files, "path string, text string"), ScanConfig(rule_globs=globs)).findings.collect()}
    want = {"js.division": 1, "js.deep_access": 1, "cpp.division": 16, "cpp.async.dropped": 1, "rust.division": 1, "ruby.division": 1, "ruby.deep_access": 1, "ruby.async.dropped": 1, "python.async.dropped": 1, "elixir.deep_nesting": 11}
    assert {k: found.get(k) for k in want} == want and not found.get("python.lifecycle.named")

"""Registered queries over version control, modules, statements, origins of values and whole scans, each with its SQL.

What only a parser or git can tell runs over programs made from documents, whose rows the SQL makes from the same documents; the others
take the documents themselves as files of a tree or as programs of one of the ten languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXCLUDED, EXTENSIONS, ScanConfig
from ..functions.source import statements
from ..operators import prune as P
from ..operators.dataflow import python_flows
from ..operators.structural import axis_counts
from ..sources import sinks
from ..sources.steps import scratch_dir
from ..sources.versions import ignore_rules, version_ignored
from .checks import _COUNTED, _PATHS, _corpora, _made, _of_kind, _paths, _programs, _sums, _values
from .queries import _ALL, _SUMMARY, _read
from .scan import scan
from .trees import TREES, tree_rules
from .userrules import syntax_rule, syntax_rule_matches

# --- Flows and origins

_ORDER = [
    ("flow.py", "python", "def f(request):\n    u = request.args['n']\n    v = u\n    return redirect(v)\n"),
    ("freed.py", "python", "u = request.args['n']\nu = safe_url(u)\n" + "\n" * 12 + "redirect(u)\n"),
    ("late.py", "python", "redirect(u)\nu = request.args['n']\n"),
    ("clean.py", "python", "u = request.args['n']\nu = '/'\nredirect(u)\n"),
    ("guard.py", "python", "u = request.args['n']\nif is_safe_url(u):\n    redirect(u)\n"),
    ("far.py", "python", "u = request.args['n']\nis_safe_url(u)\n" + "\n" * 12 + "redirect(u)\n"),
    ("named.py", "python", "redirect(code=302, location=request.args['n'])\nredirect(code=request.args['n'], url='/')\n"),
    ("marked.py", "python", "u = request.args['n']\n# noqa\nredirect(u)\n"),
    ("get.py", "python", "import requests\nq, r = 1, request.args['u']\nrequests.get(r)\nother.get(r)\n"),
    ("broken.py", "python", "redirect(request.args['n']\n"),
]


def ordered_request_flows(spark, sf):
    return python_flows(_programs(spark, sf, _ORDER)).select("path", "rule_id", "line_no", F.array_join("trail", ">").alias("trail"))


#: (family, line of the call, program with the flow, program with a check or without the data), with the document's name as a variable.
_FAMILY = [
    ("redirect", 3, "def f(request):\n    @ = request.args['n']\n    return redirect(@)\n", "def f(request):\n    @ = request.args['n']\n    if not is_safe_url(@):\n        return None\n    return redirect(@)\n"),
    ("outbound", 4, "import requests\nfor @ in request.json:\n    x = @\n    requests.get(x)\n", "import requests\n@ = request.json\nfor x in HOSTS:\n    requests.get(x)\n"),
    ("header", 2, "if @ := request.args.get('a'):\n    resp.headers['X-A'] = @\n", "if @ := request.args.get('a'):\n    resp.headers['X-A'] = sanitize(@)\n"),
    ("template", 3, "a, @ = 1, request.form['t']\nb = a\nrender_template_string(@)\n", "a, @ = request.form['t'], 1\nrender_template_string(@)\nrender_template_string(b)\n"),
    ("mass", 3, "@ = request.get_json()\nb = @\nUser.objects.create(**b)\n", "@ = request.get_json()\nUser.objects.create(name=@)\n"),
    ("sql", 4, "q = 'a'\nif x:\n    q = request.args['@']\nc.execute(q)\n", "q = request.args['@']\nq = 'a'\nc.execute(q)\n"),
    ("command", 3, "with request.files['@'] as f:\n    n = f\n    os.system(n)\n", "with request.files['@'] as f:\n    n = shlex.quote(f)\n    os.system(n)\n"),
    ("path", 3, "@ = '/'\nwhile go():\n    open(@)\n    @ = request.args['p']\n", "@ = '/'\nwhile go():\n    open(@)\n    b = request.args['p']\n"),
    ("load", 4, "@ = request.data\ndef g():\n    x = @\n    return pickle.loads(x)\n", "@ = request.data\ndef g(@):\n    x = @\n    return pickle.loads(x)\n"),
    ("eval", 4, "@ = request.args['e']\nif @ in ALLOWED:\n    pass\neval(@)\n", "@ = request.args['e']\nif @ not in ALLOWED:\n    abort(400)\neval(@)\n"),
    ("host", 2, "@ = f'http://{request.host}/r'\nsend_mail('s', @, 'from')\n", "@ = 'http://' + SITE\nsend_mail('s', @, 'from')\nrequest.host\n"),
]
_SPREAD = [(f"{family}/{k}.py", "python", t) for family, _, bad, good in _FAMILY for k, t in (("bad", bad), ("good", good), ("marked", bad.replace("\n", "  # noqa\n")))]


def dataflow_families(spark, sf):
    """Each family's flows along bindings of all kinds, in programs with a flow, with a check of it, and with marked lines."""
    found = python_flows(_programs(spark, sf, _SPREAD))
    return found.where(F.col("rule_id").startswith("python.ordered")).select("path", "rule_id", "line_no")


_EXECUTED = [
    ("a.py", "python", "def f(c, a):\n    c.execute('SELECT x FROM t WHERE a = %s' % a)\n    c.execute('SELECT x FROM t WHERE a = ?', (a,))\n"),
    ("b.py", "python", "k = 't'\nj = k\nc.execute(f'SELECT x FROM {j}')\nc.execute('SELECT x FROM ' + z)\nq = 'DELETE FROM {}'.format(g())\nc.execute(q)\nc.execute('PRAGMA ' + z)\n"),
    ("d.py", "python", "for x in @():\n    c.execute('SELECT x FROM ' + x)\nfor y in ('a', 'b'):\n    c.execute('SELECT x FROM ' + y)\nwith @() as w:\n    c.execute(f'SELECT x FROM {w}')\n"),
    ("c.py", "python", "async def f(c):\n    c.executemany('UPDATE t SET a = ' + (await g()))\n    c.execute('INSERT INTO t VALUES (' + d['k'] + ')')\n"),
]


def graded_sql_texts(spark, sf):
    return python_flows(_programs(spark, sf, _EXECUTED)).select("path", "rule_id", "line_no")


# --- Statements, modules, settings

_SPANS = [
    ("a.py", "python", "x = f(\n    1,\n    2)\ny = 3\nif x:\n    z = [\n        1]\n"),
    ("a.js", "js", "f(a,\n  '(',\n  b);\ng(c);\nlet d = [\n 1 ];\n"),
]


def statement_lines(spark, sf):
    return statements(_programs(spark, sf, _SPANS))


_MODULES = [
    ("src/lib.rs", "rust", "mod a;\npub mod b;\n#[cfg(test)]\nmod t;\n#[cfg(test)]\n#[path = \"x\"]\nmod u;\n// mod c;\nmod gone;\n"),
    ("src/a.rs", "rust", "pub(crate) mod inner;\n#[cfg(test)]\nmod shared;\n"),
    ("src/a/inner.rs", "rust", "fn f() {}\n"),
    ("src/a/shared.rs", "rust", ""),
    ("src/b/mod.rs", "rust", "mod deep;\n"),
    ("src/b/deep.rs", "rust", ""),
    ("src/t.rs", "rust", "mod helper;\n"),
    ("src/t/helper.rs", "rust", "mod more;\n"),
    ("src/t/helper/more.rs", "rust", ""),
    ("src/u.rs", "rust", ""),
]


def declared_modules(spark, sf):
    return P.module_edges(_programs(spark, sf, _MODULES, each=True))


def modules_for_tests(spark, sf):
    return P.test_only_modules(P.module_edges(_programs(spark, sf, _MODULES, each=True)))


# --- A user's rules

_OWN = [
    {"id": "own.await", "language": "javascript", "severity": "warning", "rule": {"pattern": "await $F($$$)", "inside": {"kind": "for_statement", "stopBy": "end"}, "not": {"has": {"regex": "allowed"}}}},
    {"id": "own.eval", "language": "py", "severity": "error", "rule": {"any": [{"pattern": "eval($X)"}, {"pattern": "exec($X)"}]}},
    {"id": "own.lock", "language": "rust", "severity": "info", "rule": {"all": [{"pattern": "$M.lock().unwrap()"}, {"not": {"inside": {"regex": "fn test"}}}]}},
]
_OWN_FILES = [
    ("a.js", "js", "for (const x of y) {\n  await go(x);\n  await allowed(x);\n}\nawait go(z);\n"),
    ("a.py", "python", "eval(x)\nevaluate(x)\nexec( 'y' )\n# eval(z)\n"),
    ("a.rs", "rust", "fn go() { m.lock().unwrap(); }\nfn test() { m.lock().unwrap(); }\n"),
]


def user_syntax_rules(spark, sf):
    return syntax_rule_matches(_programs(spark, sf, _OWN_FILES), [syntax_rule(d) for d in _OWN]).select("path", "rule_id", "s_line")


#: (language, what a rule says, program, lines where it holds), with the document's name for a variable.
_RELATED = [
    ("js", {"all": [{"pattern": "$P.then($F)"}, {"not": {"inside": {"pattern": "$_.catch($$$)", "stopBy": "end"}}}, {"not": {"inside": {"kind": "try_statement"}}}, {"not": {"inside": {"kind": "return_statement"}}}]}, "@(1).then(a);\n@(2).then(a).catch(b);\ntry {\n  @(3).then(a);\n} catch (e) { }\nfunction f() {\n  return @(4).then(a);\n}\n", [1]),
    ("js", {"pattern": "await $X", "not": {"inside": {"kind": "try_statement"}}}, "async function f() {\n  try {\n    await @(1);\n  } catch (e) { }\n  await @(2);\n}\n", [5]),
    ("js", {"pattern": "JSON.parse($X)", "not": {"inside": {"kind": "try"}}}, "JSON.parse(@);\ntry { JSON.parse(@); } catch (e) { }\n", [1]),
    ("js", {"pattern": "useEffect($$$)", "has": {"pattern": "setInterval($$$)"}, "not": {"has": {"pattern": "clearInterval($$$)"}}}, "useEffect(() => {\n  @ = setInterval(f, 1);\n}, []);\nuseEffect(() => {\n  @ = setInterval(f, 1);\n  return () => clearInterval(@);\n}, []);\n", [1]),
    ("js", {"pattern": "new RegExp($X)", "inside": {"any": [{"kind": "for_statement"}, {"pattern": "$A.map($$$)"}]}}, "for (const a of b) {\n  new RegExp(@);\n}\nnew RegExp(@);\nx.map(y => new RegExp(y));\n", [2, 5]),
    ("python", {"pattern": "open($$$)", "not": {"inside": {"kind": "with_statement"}}}, "x = open(@)\nwith open(@) as h:\n    pass\n", [1]),
    ("python", {"pattern": "json.loads($X)", "not": {"inside": {"kind": "try_statement"}}}, "json.loads(@)\ntry:\n    json.loads(@)\nexcept ValueError:\n    pass\n", [1]),
    ("python", {"pattern": "requests.get($$$)", "not": {"regex": "timeout"}}, "requests.get(@)\nrequests.get(@, timeout=1)\n", [1]),
    ("python", {"pattern": "await $X", "inside": {"kind": "for_statement"}, "not": {"inside": {"pattern": "gather($$$)"}}}, "async def f():\n    for a in @:\n        await a\n        gather(*[await b])\n    await g()\n", [3]),
    ("golang", {"kind": "defer_statement", "inside": {"kind": "for_statement"}, "not": {"inside": {"kind": "func_literal"}}}, "func f() {\n  for _, a := range @ {\n    defer a.Close()\n    func() {\n      defer a.Close()\n    }()\n  }\n}\n", [3]),
    ("golang", {"kind": "function_declaration", "has": {"pattern": "$M.Lock()"}, "not": {"has": {"pattern": "$N.Unlock()"}}}, "func f() {\n  @.Lock()\n}\nfunc g() {\n  @.Lock()\n  defer @.Unlock()\n}\n", [1]),
    ("rust", {"pattern": "$X.unwrap()", "not": {"inside": {"regex": "fn test_"}}}, "fn go() {\n  @.unwrap();\n}\nfn test_it() {\n  @.unwrap();\n}\n", [2]),
    ("rust", {"pattern": "thread::sleep($X)", "inside": {"kind": "async"}, "not": {"inside": {"kind": "closure_expression"}}}, "async fn f() {\n  thread::sleep(@);\n  spawn(|| { thread::sleep(@); });\n}\nfn g() { thread::sleep(@); }\n", [2]),
    ("rust", {"kind": "unsafe_block", "inside": {"regex": "Drop for"}}, "impl Drop for A {\n  fn drop(&mut self) {\n    unsafe { free(self.@) }\n  }\n}\nfn f() { unsafe { free(@) } }\n", [3]),
    ("java", {"pattern": "new FileInputStream($X)", "not": {"inside": {"kind": "try_statement"}}}, "void f() {\n  x = new FileInputStream(@);\n  try (InputStream y = new FileInputStream(@)) { }\n}\n", [2]),
    ("csharp", {"pattern": "new SqlConnection($X)", "not": {"inside": {"kind": "using_statement"}}}, "void F() {\n  var a = new SqlConnection(@);\n  using (var b = new SqlConnection(@)) { }\n}\n", [2]),
    ("cpp", {"kind": "throw_statement", "inside": {"regex": r"~\w+\("}}, "A::~A() {\n  throw @;\n}\nvoid f() {\n  throw @;\n}\n", [2]),
    ("cpp", {"kind": "function_definition", "has": {"pattern": "malloc($X)"}, "not": {"has": {"pattern": "free($X)"}}}, "void f() {\n  p = malloc(@);\n}\nvoid g() {\n  p = malloc(@);\n  free(p);\n}\n", [1]),
    ("ruby", {"pattern": "sleep($X)", "inside": {"kind": "while_statement"}}, "while a\n  sleep(@)\nend\nsleep(@)\n", [2]),
    ("elixir", {"pattern": "String.to_atom($X)", "not": {"inside": {"kind": "if_statement"}}}, "def f(x) do\n  if g(x) do\n    String.to_atom(@)\n  end\n  String.to_atom(@)\nend\n", [5]),
    ("swift", {"pattern": "$X.wait()", "inside": {"kind": "closure"}}, "queue.async {\n  @.wait()\n}\n@.wait()\n", [2]),
    ("js", {"pattern": "f($A, g($B, 1), $$$)"}, "f(@, g(2, 1), 3, 4);\nf(g(2, 1), @);\nh(f(1, g(@, 1)));\nf(@, g(2, 1), { a: [1, 2] });\n", [1, 4]),
    ("python", {"pattern": "$A == $A"}, "if @ == @:\n    pass\nif @ == b:\n    pass\n", [1]),
]
_RELATED_FILES = [(f"r{k}", lang, text) for k, (lang, _, text, _) in enumerate(_RELATED)]


def related_syntax_rules(spark, sf):
    """Rules about what is in and around a node, all in one join of the nodes of all programs."""
    own = [syntax_rule({"id": f"r{k}", "language": lang, "rule": rule}) for k, (lang, rule, _, _) in enumerate(_RELATED)]
    found = syntax_rule_matches(_programs(spark, sf, _RELATED_FILES), own)
    return found.where(F.col("rule_id") == F.element_at(F.split("path", "/"), -1)).select("path", "s_line")


_EXAMPLES = [(f"t{k}", lang, text) for k, (lang, _, _, _, _, text, _) in enumerate(TREES)]


def syntax_catalogue(spark, sf):
    """The catalogue's syntax rules over programs that are their examples."""
    found = syntax_rule_matches(_programs(spark, sf, _EXAMPLES), list(tree_rules()))
    names = F.create_map(*[F.lit(x) for k, (lang, name, *_) in enumerate(TREES) for x in (f"t{k}", f"{lang}.tree.{name}")])
    return found.where(F.col("rule_id") == names[F.element_at(F.split("path", "/"), -1)]).select("path", "rule_id", "s_line")


def axis_totals(spark, sf):
    """Documents as nodes of trees, four levels deep, in the order of their ids: how many are around each and in it."""
    level = F.col("doc_id") % 4
    width = F.pow(F.lit(4), level).cast("long")
    first = F.col("doc_id") - F.col("doc_id") % width
    nodes = _read(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.lit("all").alias("path"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"), (first * 10 + 3 - level).alias("pre"), ((first + width) * 10 - 4 + level).alias("post"), "doc_id")
    return axis_counts(nodes, nodes, ["doc_id"]).select("doc_id", "n_around", "n_within")


# --- Trees

_IGNORED = {".gitignore": "*.md\n!f1*.md\n# none\n/src\n!src/\nx/\n**/b/*.js\n", "a/.gitignore": "/b/*.py\n!*.js\n"}


def ignored_by_version_control(spark, sf):
    """Documents as files of a tree with two ignore files."""
    files = _paths(spark, sf).select("path", "text").unionByName(spark.createDataFrame(list(_IGNORED.items()), "path string, text string"))
    left = P.without(_paths(spark, sf), version_ignored(files, ignore_rules(files)))
    return left.groupBy(F.split("path", "/")[0].alias("top"), P.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def language_excludes(spark, sf):
    """Documents below a directory that one language leaves out, as files of all languages."""
    names = sorted({d for v in EXCLUDED.values() for d in v if "*" not in d})
    folder = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    files = _paths(spark, sf).select("doc_id", F.concat_ws("/", F.lit("p"), folder, F.element_at(F.split("path", "/"), -1)).alias("path"), "n_bytes")
    return P.prune(files, ScanConfig(ignores=())).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


# --- Whole scans


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus of programs under paths with their language's extension."""
    ext = F.element_at(F.create_map(*[F.lit(x) for lang, v in EXTENSIONS.items() for x in (lang, v[0])]), F.col("lang"))
    return _corpora(spark, sf).select(F.concat("path", F.lit("."), ext).alias("path"), "text")


def whole_scan(spark, sf):
    """A scan by all line rules: the findings that the operators give one by one, where warnings of asynchronous checks are lenient."""
    config = ScanConfig(rule_globs=tuple(r.rule_id for r in _of_kind("line")))
    return scan(_named(spark, sf), config).findings.select("lang", "category", "rule_id", "severity", "n")


_PLIST = '<?xml version="1.0"?><plist version="1.0"><dict><key>NSAppTransportSecurity</key><dict><key>NSAllowsArbitraryLoads</key><true/></dict><key>UIFileSharingEnabled</key><false/></dict></plist>'
_SMALL = [
    ("Info.plist", "", _PLIST),
    (".gitignore", "", "old/\n"),
    ("old/a.jsx", "js", "useEffect(() => { load(id); }, []);"),
    ("src/a.jsx", "js", "useEffect(() => { @(id); }, [id, other]);\nuseMemo(() => a, [a]);\n"),
    ("src/a.py", "python", "u = request.args['n']\nredirect(\n    u)\nredirect(\n    u,  # noqa\n    302)\nc.execute('SELECT a FROM ' + b)\n"),
    ("src/lib.rs", "rust", "#[cfg(test)]\nmod t;\nfn f() { x.unwrap(); }\n"),
    ("src/t.rs", "rust", "fn f() { x.unwrap(); }\n"),
    ("tests/b.py", "python", "redirect(request.args['n'])\n"),
]


def small_scan(spark, sf):
    """A scan of trees with ignore rules, settings, hooks, test modules, and markers that hold for whole statements: one tree for each document."""
    config = ScanConfig(rule_globs=("js.hooks.*", "swift.plist.*", "python.ordered.*", "python.sql_text.*"), respect_ignore_files=True, exclude_tests=True, statement_suppression=True)
    found = scan(_programs(spark, sf, _SMALL, each=True).select("path", "text"), config)
    return found.occurrences.select("path", "rule_id", "line_no", "suppressed")


def scanned_languages(spark, sf):
    return scan(_programs(spark, sf, _SMALL, each=True).select("path", "text"), ScanConfig(rule_globs=("none",))).languages


def sarif_parts(spark, sf):
    """A log written in parts: what the files of results hold, by language, and what the log says of them."""
    found = scan(_named(spark, sf), ScanConfig(rule_globs=tuple(r.rule_id for r in _of_kind("line"))))
    spark_dir = scratch_dir(spark, "sarif")
    sinks.write_sarif(found.occurrences, found.findings, spark_dir, per_file=50)
    each = spark.read.text(f"{spark_dir}/results", wholetext=True).select(F.get_json_object("value", "$.properties.language").alias("lang"), F.explode(F.from_json(F.get_json_object("value", "$.results"), "array<struct<ruleId:string>>")).alias("r"))
    log = spark.read.text(f"{spark_dir}/log", wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.runs"), "array<struct<tool:struct<driver:struct<name:string>>,externalPropertyFileReferences:struct<results:array<struct<itemCount:long>>>>>")).alias("x"))
    said = log.select(F.substring_index("x.tool.driver.name", "-", -1).alias("lang"), F.aggregate("x.externalPropertyFileReferences.results", F.lit(0).cast("long"), lambda a, y: a + y["itemCount"]).alias("said"))
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("r.ruleId").alias("rules")).join(said, "lang")


def module_report_counts(spark, sf):
    found, sums, _ = _sums(spark, sf)
    schema = "language string, files bigint, critical bigint, findings array<struct<rule_id:string,count:bigint>>"
    rows = sinks.module_reports(found, sums, "now").select(F.from_json("value", schema).alias("j")).select("j.*")
    return rows.select("language", "files", "critical", F.size("findings").alias("n_findings"), F.aggregate("findings", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ordered_request_flows, dataflow_families, related_syntax_rules, syntax_catalogue, axis_totals, graded_sql_texts, statement_lines, declared_modules, modules_for_tests, user_syntax_rules, ignored_by_version_control, language_excludes, whole_scan, small_scan, scanned_languages, sarif_parts, module_report_counts,
    )
}

_FOLDERS = sorted({d for v in EXCLUDED.values() for d in v if "*" not in d})
SQL: dict[str, str] = {
    "ordered_request_flows": _made(_ORDER, [(path, f"python.ordered.{rule}", n, trail) for rule, path, n, trail in (("redirect", "flow.py", 4, "request.args>u>v>redirect"), ("redirect", "far.py", 15, "request.args>u>redirect"), ("redirect", "named.py", 1, "request.args>redirect"), ("outbound", "get.py", 3, "request.args>r>requests.get"))], "path, rule_id, line_no, trail"),
    "dataflow_families": _made(_SPREAD, [(f"{family}/bad.py", f"python.ordered.{family}", n) for family, n, _, _ in _FAMILY], "path, rule_id, line_no"),
    "related_syntax_rules": _made(_RELATED_FILES, [(f"r{k}", n) for k, (_, _, _, lines) in enumerate(_RELATED) for n in lines], "path, s_line"),
    "syntax_catalogue": _made(_EXAMPLES, [(f"t{k}", f"{lang}.tree.{name}", n) for k, (lang, name, _, _, _, _, lines) in enumerate(TREES) for n in lines], "path, rule_id, s_line"),
    "axis_totals": "WITH x AS (SELECT doc_id, lang IS NOT NULL AND lang = 'en' AS label, doc_id % 4 AS level, (4 ** (doc_id % 4))::BIGINT AS width FROM documents), n AS (SELECT doc_id, label, (doc_id - doc_id % width) * 10 + 3 - level AS pre, (doc_id - doc_id % width + width) * 10 - 4 + level AS post FROM x) SELECT q.doc_id, (SELECT count(*) FROM n m WHERE m.label = q.label AND m.pre < q.pre AND m.post > q.post) AS n_around, (SELECT count(*) FROM n m WHERE m.label = q.label AND m.pre > q.pre AND m.post < q.post) AS n_within FROM n q",
    "graded_sql_texts": _made(_EXECUTED, [(path, f"python.sql_text.{grade}", n) for grade, path, n in (("tainted", "a.py", 2), ("unknown", "b.py", 4), ("tainted", "b.py", 6), ("tainted", "c.py", 2), ("tainted", "c.py", 3), ("tainted", "d.py", 2), ("tainted", "d.py", 6))], "path, rule_id, line_no"),
    "statement_lines": _made(_SPANS, [("a.py", 1, 3), ("a.py", 6, 7), ("a.js", 1, 3), ("a.js", 5, 6)], "path, s_line, e_line"),
    "declared_modules": "SELECT path AS src, regexp_replace(path, '/.*', '/') || dst AS dst, gated FROM (" + _made(_MODULES, [("src/lib.rs", "src/a.rs", False), ("src/lib.rs", "src/b/mod.rs", False), ("src/lib.rs", "src/t.rs", True), ("src/lib.rs", "src/u.rs", True), ("src/a.rs", "src/a/inner.rs", False), ("src/a.rs", "src/a/shared.rs", True), ("src/b/mod.rs", "src/b/deep.rs", False), ("src/t.rs", "src/t/helper.rs", False), ("src/t/helper.rs", "src/t/helper/more.rs", False)], "path, dst, gated", each=True) + ")",
    "modules_for_tests": _made(_MODULES, [(p,) for p in ("src/t.rs", "src/u.rs", "src/a/shared.rs", "src/t/helper.rs", "src/t/helper/more.rs")], "path", each=True),
    "user_syntax_rules": _made(_OWN_FILES, [("a.js", "own.await", 2), ("a.py", "own.eval", 1), ("a.py", "own.eval", 3), ("a.rs", "own.lock", 1)], "path, rule_id, s_line"),
    "ignored_by_version_control": f"WITH {_PATHS}, x AS (SELECT *, split_part(path, '/', 1) AS top, lower(regexp_extract(path, '[^.]*$')) AS ext FROM paths) SELECT top, ext, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM x WHERE top <> 'x' AND path NOT LIKE '.venv/x/%' AND (path NOT LIKE '%.md' OR path LIKE '%/f1%') AND path NOT LIKE 'a/b/%.py' GROUP BY top, ext",
    "language_excludes": f"WITH {_PATHS}, x AS (SELECT p.doc_id, e.lang, ['{"', '".join(_FOLDERS)}'][(doc_id % {len(_FOLDERS)} + 1)::INT] AS folder FROM paths p JOIN exts e ON e.e = lower(regexp_extract(path, '[^.]*$'))), o AS {_values([(lang, d) for lang, v in EXCLUDED.items() for d in v if '*' not in d], 'lang, folder')} SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM x ANTI JOIN o USING (lang, folder) GROUP BY lang",
    "whole_scan": f"{_COUNTED}, graded AS (SELECT lang, category, rule_id, coalesce((SELECT severity FROM tiers t WHERE t.rule_id = c.rule_id AND c.n > t.min_n ORDER BY k LIMIT 1), 'good') AS severity, n FROM counted c) SELECT lang, category, rule_id, CASE WHEN severity = 'warning' AND contains(rule_id, 'async') THEN 'info' ELSE severity END AS severity, n FROM graded",
    "sarif_parts": f"{_COUNTED}, graded AS (SELECT lang, category, rule_id, coalesce((SELECT severity FROM tiers t WHERE t.rule_id = c.rule_id AND c.n > t.min_n ORDER BY k LIMIT 1), 'good') AS severity, n FROM counted c) SELECT lang, sum(n)::BIGINT AS n, count(*) AS rules, sum(n)::BIGINT AS said FROM graded WHERE severity <> 'good' GROUP BY lang",
    "small_scan": _made(_SMALL, [("Info.plist", "swift.plist.any_transport", 0, False), ("src/a.jsx", "js.hooks.missing", 1, False), ("src/a.jsx", "js.hooks.unused", 1, False), ("src/a.py", "python.ordered.redirect", 2, False), ("src/a.py", "python.ordered.redirect", 4, True), ("src/a.py", "python.sql_text.unknown", 7, False)], "path, rule_id, line_no, suppressed", each=True),
    "scanned_languages": "SELECT lang, (n * (SELECT count(*) FROM documents))::BIGINT AS n_files FROM (VALUES ('js', 2), ('python', 2), ('rust', 2)) AS t(lang, n)",
    "module_report_counts": f"{_ALL}, {_SUMMARY} SELECT lang AS language, files, critical, (SELECT count(*) FROM found f WHERE f.lang = s.lang AND severity <> 'good')::INT AS n_findings, critical + warning + info AS n FROM summary s",
}

"""Registered queries over the rule catalogue, over programs made from documents and over reports, each with its SQL.

The catalogue's rules run over two corpora: all documents, each taken as a program of one of the ten languages,
and ``PROGRAMS``, small files in which the rules find something. SQL gets the same patterns, since Java's and
RE2's regular expressions agree on them. What only a parser can tell runs over programs made from documents, a program
for each; the SQL knows what each kind of program holds and makes the rows from the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_IGNORES, EXTENSIONS, MARKERS, SUPPRESSION_MARKERS, ScanConfig, languages
from ..functions.source import ingest_matches, mask_column, plist_settings, python_matches, regex_matches, regions
from ..functions.syntax import syntax_nodes
from ..functions.text import explode_lines, java_regex, line_of, matches, without_ansi
from ..operators import aggregate as A
from ..operators import correlate as C
from ..operators import lines as L
from ..operators import prune as P
from ..operators.flow import FlowSpec, flow_specs, flows
from ..operators.ambiguity import exponential_patterns, with_patterns
from ..operators.control import guard_then_use, guards, held_resources
from ..operators.lifecycle import dropped_tasks, hooks, issues, unreleased
from ..sources import sinks
from ..sources.steps import step
from ..sources.tree import changed_paths, listed_paths, manifest_lines, notebook_outputs, sarif_counts
from .catalogue import Rule, rules, rules_frame, variants
from .queries import _ALL, _HITS, _PLAIN, _SPANS, _SUMMARY, LANGS, RULES, _events, _files, _found, _lines, _marked, _occurred, _read, _spans, _text

CODE = tuple(EXTENSIONS)
_FILE = "path string, lang string, text string"

#: Small files in which rules of the catalogue find something: (path, language, text).
PROGRAMS = [
    ("a.py", "python", "import os\nfrom x import *\nf = open(p)\ng = open(q)\nf.close()\nx = eval(a)\npassword = 'hunter2hunter2'\nhashlib.md5(b)\ny = eval(b)  # noqa\n\ndef f(a, b=[]):\n    subprocess.run(x, shell=True)\n    # TODO later\n"),
    ("b.js", "js", "el.innerHTML = x;\nif (a == b) {\n  console.log(password);\n}\nsetTimeout(f);\nsetTimeout(g);\nclearTimeout(t);\nfetch(u);\nparseInt(x);\nrejectUnauthorized: false\n"),
    ("c.go", "golang", "f, err := os.Open(p)\nt := time.NewTicker(d)\n_ = f(x)\nInsecureSkipVerify: true\nvar wg sync.WaitGroup\nmu.Lock()\ndefer mu.Unlock()\n"),
    ("d.java", "java", "Executors.newFixedThreadPool(1)\nMessageDigest.getInstance(\"MD5\")\nif (s == \"x\") {\n}\nq = \"SELECT * FROM t WHERE a=\" + a;\n"),
    ("e.rs", "rust", "x.unwrap()\nunsafe { f() }\nthread::spawn(f);\ndanger_accept_invalid_certs(true)\n"),
    ("f.rb", "ruby", "rescue Exception => e\nsystem(\"ls #{x}\")\nhttp.verify_mode = OpenSSL::SSL::VERIFY_NONE\n"),
    ("g.cpp", "cpp", "strcpy(a, b);\nusing namespace std;\nchar* p = (char*)malloc(3);\n#define SQ(x) x*x\n"),
    ("h.cs", "csharp", "public async void Go()\nnew BinaryFormatter()\n"),
    ("i.ex", "elixir", "String.to_atom(x)\nFile.open!(p)\n"),
    ("j.swift", "swift", "let a = b!.c\nDispatchQueue.main.sync { }\n"),
]


def _values(rows: Iterable[tuple], names: str) -> str:
    """SQL of a table with the rows written out."""
    show = lambda x: "NULL" if x is None else _text(x) if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(show, r))})" for r in rows) + f") AS t({names}))"


# --- The catalogue over two corpora


def _corpora(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, CODE)), (F.col("doc_id") % 10 + 1).cast("int")).alias("lang"), "text")
    return docs.unionByName(spark.createDataFrame(PROGRAMS, _FILE))


def _code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.mark_suppressed(explode_lines(_corpora(spark, sf), previous=True))


def _of_kind(kind: str) -> list[Rule]:
    return [r for r in rules() if r.kind == kind]


_CODE_LINES = f"""
code AS (
  SELECT 'doc' || doc_id AS path, ['{"', '".join(CODE)}'][(doc_id % 10 + 1)::INT] AS lang, text FROM documents
  UNION ALL SELECT path, lang, text FROM {_values(PROGRAMS, "path, lang, text")}
), code_lines AS (
  SELECT path, lang, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line
  FROM (SELECT path, lang, regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS p FROM code WHERE length(text) > 0)
), code_marked AS (
  SELECT *, here OR coalesce(lag(here) OVER (PARTITION BY path ORDER BY line_no), false) AS suppressed
  FROM (SELECT *, {" OR ".join(f"contains(lower(line), {_text(m)})" for m in SUPPRESSION_MARKERS)} AS here FROM code_lines)
)"""


def _rows_sql(rules_: list[Rule]) -> str:
    """Lines that satisfy each rule."""
    parts = []
    for r in rules_:
        veto = f" AND NOT regexp_matches(line, {_text(r.exclude)})" if r.exclude else ""
        parts.append(f"SELECT {_text(r.rule_id)} AS rule_id, path, line_no, suppressed FROM code_marked WHERE lang = {_text(r.lang)} AND regexp_matches(line, {_text(('(?i)' if r.ignore_case else '') + r.pattern)}){veto}")
    return "code_hits AS (" + " UNION ALL ".join(parts) + ")"


def catalogue_occurrences(spark, sf):
    found = L.occurrences(_code_lines(spark, sf), _of_kind("line"))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"), F.count(F.when(F.col("suppressed"), 1)).alias("hidden"))


def catalogue_findings(spark, sf):
    chosen = _of_kind("line")
    return A.findings(spark, A.counts(L.occurrences(_code_lines(spark, sf), chosen)), chosen).select("lang", "category", "rule_id", "severity", "n")


def catalogue_one_pass(spark, sf):
    return L.one_pass_counts(_code_lines(spark, sf), _of_kind("line"))


def catalogue_balances(spark, sf):
    return L.balances(_code_lines(spark, sf), _of_kind("balance")).select("rule_id", "path", "acquired", "released", "n")


def catalogue_lacking(spark, sf):
    return L.lacking(_code_lines(spark, sf), _of_kind("file_without")).select("rule_id", "path")


def catalogue_ratios(spark, sf):
    return L.ratios(_code_lines(spark, sf), _of_kind("ratio")).select("rule_id", "first", "second", "n")


def catalogue_look_back(spark, sf):
    lines = _code_lines(spark, sf)
    return lines.withColumn("near", L.context_has(lines, r"password|secret|token", 10, 1)).where("near").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def statement_suppression(spark, sf):
    """Pairs of lines are statements; a marker in one, or on the line above it, holds for both lines."""
    lines = _code_lines(spark, sf).drop("suppressed")
    spans = lines.where("line_no % 2 = 1").select("path", F.col("line_no").alias("s_line"), (F.col("line_no") + 1).alias("e_line"))
    left = L.suppressed_statements(lines.where(F.col("line").contains("a")).select("path", "line_no"), spans, lines, ("token", "noqa"))
    return left.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def _pair_sql(kind: str, sums: str, keep: str, group: str = "lang, path", out: str = "path, ") -> str:
    parts = [f"SELECT {_text(r.rule_id)} AS rule_id, {out}a, b FROM (SELECT {group}, {sums.format(a=_text(r.pattern), b=_text(r.exclude))} FROM code_lines WHERE lang = {_text(r.lang)} GROUP BY {group}) WHERE {keep}" for r in _of_kind(kind)]
    return f"WITH {_CODE_LINES}, found AS (" + " UNION ALL ".join(parts) + ")"


_SUMS = "count(*) FILTER (regexp_matches(line, {a})) AS a, count(*) FILTER (regexp_matches(line, {b})) AS b"

# --- Text functions over whole tables


def whole_words(spark, sf):
    line = F.col("line")
    return _lines(spark, sf).groupBy("lang").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("word", matches(line, "de|the", word=True)), ("any_case", matches(line, "TOKEN", ignore_case=True)), ("both", matches(line, "LA|THE", True, True)))])


def posix_classes(spark, sf):
    return _lines(spark, sf).where(F.col("line").rlike(java_regex("[[:digit:]]{4}[^[:alnum:]_]+[[:upper:]]"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def offset_lines(spark, sf):
    half = F.floor(F.length("text") / 2).cast("int")
    return _files(spark, sf).where("text IS NOT NULL").select(F.col("path").cast("long").alias("path"), line_of(F.col("text"), half).alias("line_no"))


def ansi_stripped(spark, sf):
    coloured = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0;1mend\x1b[K"))
    return _read(spark, sf, "documents").select("doc_id", F.sha2(without_ansi(coloured), 256).alias("digest"))


def debt_totals(spark, sf):
    """Debt markers in lines where frequent words stand for them."""
    line = F.replace(F.replace(F.col("line"), F.lit(" the "), F.lit(" TODO ")), F.lit(" la "), F.lit(" fixme "))
    return L.debt_markers(_lines(spark, sf).withColumn("line", line))


def count_time_suppression(spark, sf):
    return L.mark_suppressed(_lines(spark, sf), ("TOKEN", "###"), previous_line=False, ignore_case=False).groupBy("lang").agg(F.count(F.when(F.col("suppressed"), 1)).alias("hidden"))


# --- Counting and severity


def grouped_rule_counts(spark, sf):
    """Several patterns of one rule, added up."""
    groups = spark.createDataFrame([(r.rule_id, "personal" if r.rule_id.split(".")[0] in ("card", "address", "mail") else "style") for r in RULES], "rule_id string, group_id string")
    return A.grouped_counts(A.counts(L.occurrences(_marked(spark, sf), RULES)), groups)


_ASYNC = [Rule(f"async.{r.rule_id}", r.lang, r.category, r.kind, r.pattern, r.exclude, r.tiers, r.title, r.remediation) for r in RULES]


def lenient_severity(spark, sf):
    """Warnings of asynchronous checks are information unless the run is strict."""
    counted = A.counts(L.occurrences(_marked(spark, sf), _ASYNC))
    return A.findings(spark, counted, _ASYNC, strict=False).select("rule_id", "severity", "n")


def foreign_severities(spark, sf):
    names = ["ERROR", "high", " Medium", "note", "hint", "fatal", "unknown", "warn"]
    rows = _read(spark, sf, "events").select(F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("name"))
    return rows.groupBy(A.normal_severity(F.col("name")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def min_severity(spark, sf):
    return A.at_least(_found(spark, sf), "info").select("rule_id", "severity", "n")


def exit_gate(spark, sf):
    """Exit codes of one run under several limits: (name, strict, allowed critical, allowed warnings)."""
    t = A.totals(A.summary(_found(spark, sf), _files(spark, sf))).first()
    runs = [("plain", False, 0, None), ("strict", True, 0, None), ("lenient", False, 10**9, None), ("warned", False, 10**9, 0)]
    rows = [(name, A.exit_code(t["critical"], t["warning"], t["files"], strict, False, c, w)) for name, strict, c, w in runs]
    return spark.createDataFrame([*rows, ("empty", A.exit_code(0, 0, 0, True)), ("empty_allowed", A.exit_code(0, 0, 0, True, True))], "name string, code int")


def merged_reports(spark, sf):
    found = _found(spark, sf)
    both = A.merged([found.select("lang", "rule_id", "n"), found.select("rule_id", "severity")])
    return both.groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows"), F.max("severity").alias("severity"), F.max("n").alias("n"))


# --- Correlation


def guard_region_kinds(spark, sf):
    """Regions that guards protect, by the guard's form."""
    items = _read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    form = F.when(F.col("flag") == "A", "and").when(F.col("flag") == "R", "ternary").otherwise("plain")
    at = lambda name, k: [(F.col("l_linenumber") * m + k).alias(f"{name}_{c}") for m, c in ((1, "s_line"), (2, "s_col"), (3, "e_line"), (4, "e_col"))]
    guards = items.select(F.col("l_orderkey").alias("path"), form.alias("form"), *at("cond", 1), *at("body", 2), *at("whole", 3))
    return C.guard_regions(guards).groupBy("s_line").agg(F.count(F.lit(1)).alias("n"), F.sum("s_col").alias("cols"), F.sum("e_line").alias("ends"), F.sum("e_col").alias("last"))


def context_matches(spark, sf):
    """Matches inside a hot block whose header has a pattern, but in no cold block."""
    found, guards = _spans(spark, sf)
    blocks = guards.select("path", F.when(F.col("s_line") % 2 == 0, "loop").otherwise("async").alias("kind"), "s_line", "s_col", "e_line", "e_col", F.concat(F.lit("for q"), F.col("s_col").cast("string")).alias("header"))
    matches_ = found.select(F.lit("r").alias("rule_id"), "path", "s_line", "s_col", "e_line", "e_col", F.col("s_col").cast("string").alias("code"))
    return C.in_context(matches_, blocks, ["loop"], ["async"], "for q[1-3]").groupBy("s_line").agg(F.count(F.lit(1)).alias("n"), F.sum("s_col").alias("cols"))


_DENOMINATORS = ("0", "2", "n", "1_000", "0x0", "Math.PI", "(k)", "n || 1", "n || 0", "max(1, n)", "max(n, 0)")


def risky_denominators(spark, sf):
    """Divisions by what each customer's number picks from a list."""
    text = F.element_at(F.array(*map(F.lit, _DENOMINATORS)), (F.col("c_custkey") % len(_DENOMINATORS) + 1).cast("int"))
    rows = _read(spark, sf, "customer").select("c_custkey", F.create_map(F.lit("R"), F.struct(text.alias("text"))).alias("captures"))
    return C.risky_divisions(rows).select("c_custkey", F.col("captures")["R"]["text"].alias("text"))


def last_release(spark, sf):
    e = _events(spark, sf)
    return C.without_partner(e.where("event_type = 'click'"), e.where("event_type = 'signup'")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("first"))


def known_permalinks(spark, sf):
    rows = _read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), (F.col("page_id") % 7).cast("int").alias("line_no"))
    known = _read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return C.with_permalinks(rows, "https://host/blob/main", known).select("path", "url")


# --- Pruning and selection


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of all languages, some below directories that are ignored."""
    exts = [e for v in EXTENSIONS.values() for e in v] + ["md", "PY"]
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, exts)), (F.col("doc_id") % len(exts) + 1).cast("int")))
    top = F.element_at(F.array(*map(F.lit, _TOPS)), (F.col("doc_id") % len(_TOPS) + 1).cast("int"))
    return _read(spark, sf, "documents").select("doc_id", F.concat_ws("/", top, name).alias("path"), F.octet_length("text").cast("long").alias("n_bytes"), "text")


_TOPS = ("src", "node_modules", "lib/dist", "a/b", ".venv/x", "tests", "x/benches", "distx")
_EXTS = [(lang, e) for lang, v in EXTENSIONS.items() for e in v]
_PATHS = f"""paths AS (SELECT doc_id, ['{"', '".join(_TOPS)}'][(doc_id % {len(_TOPS)} + 1)::INT] || '/f' || doc_id || '.' || ['{"', '".join([e for _, e in _EXTS] + ["md", "PY"])}'][(doc_id % {len(_EXTS) + 2} + 1)::INT] AS path, strlen(text) AS n_bytes FROM documents),
exts AS (SELECT * FROM (VALUES {", ".join(f"('{lang}', '{e}')" for lang, e in _EXTS)}) AS t(lang, e))"""


def pruned_files(spark, sf):
    """The default ignores, extensions of three languages and a limit of size."""
    return P.prune(_paths(spark, sf), ScanConfig(only=("javascript", "py", "go"), max_file_bytes=4000)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def default_ignores(spark, sf):
    return P.prune(_paths(spark, sf), ScanConfig()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def test_directories(spark, sf):
    return P.outside_test_directories(_paths(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def language_detection(spark, sf):
    names = _paths(spark, sf).select("path").unionByName(spark.createDataFrame([(m,) for v in MARKERS.values() for m in v], "path string"))
    return P.detected_languages(names)


def target_union(spark, sf):
    """Files found in directories and files named, which no ignore touches; each path once."""
    every = _paths(spark, sf).select("path")
    return P.targets(every, every.where("path LIKE 'node_modules/%'"), ScanConfig(only=("python",))).groupBy(F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("n"))


def changes_or_all(spark, sf):
    files = _files(spark, sf).select("path")
    some = P.changed_or_all(files, _read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"))).agg(F.lit("changed").alias("of"), F.count(F.lit(1)).alias("n"))
    return some.unionByName(P.changed_or_all(files, None).agg(F.lit("all").alias("of"), F.count(F.lit(1)).alias("n")))


def diff_statuses(spark, sf):
    """Name-status lines of a version control's difference, one of each document."""
    status = F.element_at(F.array(*map(F.lit, ("M", "A", "D", "R100", "T"))), (F.col("doc_id") % 5 + 1).cast("int"))
    line = F.concat_ws("\t", status, F.concat(F.lit("old"), "doc_id"), F.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("new"), "doc_id")))
    return changed_paths(_read(spark, sf, "documents").select(line.alias("value")))


def project_guard(spark, sf):
    """Whether a scan of all documents stays below each limit."""
    files, out = _files(spark, sf), []
    for most in (0, 1, 10**6):
        try:
            P.guard_size(files, ScanConfig(max_project_mb=most))
            out.append((most, True))
        except ValueError:
            out.append((most, False))
    return spark.createDataFrame(out, "limit_mb int, passes boolean")


def named_paths(spark, sf):
    """A list of paths as a user types it: the nations' names, some twice, with blanks and gaps."""
    names = [r[0] for r in _read(spark, sf, "nation").select("n_name").collect()]
    return listed_paths(spark, " ,".join([*names, "", *names[:5]]))


def chosen_languages(spark, sf):
    """Languages of a scan of all documents as programs, of those a user names, and of those that are not left out."""
    there = [r[0] for r in _corpora(spark, sf).select("lang").distinct().orderBy("lang").collect()]
    cases = [("all", None, None), ("only", ["golang", "typescript", "cobol"], None), ("without", None, ["go", "rb"])]
    return spark.createDataFrame([(n, lang) for n, a, b in cases for lang in languages(there, a, b)], "name string, lang string")


_CONFIGS = {
    "all": (ScanConfig(), "true"),
    "skipped": (ScanConfig(skip_categories={"": (7,), "js": (1,)}), "category <> 7 AND NOT (lang = 'js' AND category = 1)"),
    "limited": (ScanConfig(only=("python", "ruby"), only_categories={"python": (6,), "": (2, 4)}), "lang = 'python' AND category = 6 OR lang = 'ruby' AND category IN (2, 4)"),
    "pack": (ScanConfig(pack="resource-lifecycle"), "lang IN ('java', 'csharp') OR lang IN ('python', 'swift') AND category IN (16, 19) OR lang = 'golang' AND category IN (5, 17)"),
    "globs": (ScanConfig(rule_globs=("*.eval", "js.*"), disabled_globs=("*.debug*",)), "(rule_id LIKE '%.eval' OR rule_id LIKE 'js.%') AND NOT rule_id LIKE '%.debug%'"),
    "loose": (ScanConfig(profile="loose"), "NOT contains(rule_id, '.debt') AND NOT contains(rule_id, '.debug')"),
    "without": (ScanConfig(exclude=("c#", "ex")), "lang NOT IN ('csharp', 'elixir')"),
}


def rule_selection(spark, sf):
    rows = [(name, r.lang) for name, (config, _) in _CONFIGS.items() for r in rules(config)]
    chosen = spark.createDataFrame(rows, "name string, lang string").groupBy("name", "lang").agg(F.count(F.lit(1)).alias("n"))
    return chosen.join(_sizes(spark, sf), "lang")


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many files of a language a scan of the corpus has."""
    return _corpora(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))


def rule_listing(spark, sf):
    return rules_frame(spark, rules()).join(_sizes(spark, sf), "lang").select("n_files", "rule_id", "lang", "category", "kind", F.size("tiers").alias("n_tiers"), F.element_at("tiers", 1)["severity"].alias("worst"))


def rule_variants(spark, sf):
    base = rules()[0]
    made = spark.createDataFrame([(v.rule_id, v.lang) for v in variants(base, {"en": "-en", "de": "-de"})], "rule_id string, lang string")
    return _read(spark, sf, "documents").join(F.broadcast(made), "lang").groupBy("rule_id", "lang").agg(F.count(F.lit(1)).alias("n"))


# --- Programs made from documents

#: What begins a comment; the other languages have two slashes. Fixed values.
_COMMENTS = {"python": "#", "ruby": "#", "elixir": "#", "": ""}


def _programs(spark: SparkSession, sf: str, rows: list[tuple], each: bool = False) -> DataFrame:
    """A program for each document, below a folder of its own: one of ``rows(path, lang, text)`` by its id, or all of them with ``each``.

    ``@`` in a program is the document's name, v and its id; the program begins with up to three lines that hold
    a digest of its text, as many as its length says.
    """
    made = spark.createDataFrame([(k, path, lang, (_COMMENTS.get(lang, "//") + " ") if lang else "", text) for k, (path, lang, text) in enumerate(rows)], "k int, of string, lang string, comment string, body string")
    docs = _read(spark, sf, "documents").select("doc_id", F.coalesce(F.col("n_chars") % 4, F.lit(0)).cast("int").alias("lift"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    found = docs.crossJoin(F.broadcast(made)) if each else docs.withColumn("k", (F.col("doc_id") % len(rows)).cast("int")).join(F.broadcast(made), "k")
    head = F.when(F.col("comment") != "", F.expr("repeat(concat(comment, digest, '\n'), lift)")).otherwise("")
    text = F.concat(head, F.replace("body", F.lit("@"), F.concat(F.lit("v"), F.col("doc_id").cast("string"))))
    return found.select(F.concat(F.lit("d"), "doc_id", F.lit("/"), "of").alias("path"), "lang", text.alias("text"))


def _made(programs: list[tuple], rows: Iterable[tuple], names: str, each: bool = False) -> str:
    """SQL of the rows that the programs give: the first column is the program's path, ``*_line`` and ``line_no`` move with the lines in front, ``@`` is the document's name."""
    of = {path: k for k, (path, _, _) in enumerate(programs)}
    lifts = {k: bool(lang) for k, (_, lang, _) in enumerate(programs)}
    columns = names.split(", ")
    show = lambda c: "'d' || doc_id || '/' || t.path AS path" if c == "path" else f"(t.{c} + CASE WHEN lifts THEN lift ELSE 0 END)::INTEGER AS {c}" if c == "line_no" or c.endswith("_line") else f"t.{c}"
    picked = ", ".join(f"replace(t.{c}, '@', 'v' || doc_id) AS {c}" if c not in ("path",) and not (c == "line_no" or c.endswith("_line")) and any(isinstance(r[n], str) and "@" in r[n] for r in rows) else show(c) for n, c in enumerate(columns))
    table = _values([(of[r[0]], lifts[of[r[0]]], *r) for r in rows], f"k, lifts, {names}")
    join = "" if each else f" AND d.doc_id % {len(programs)} = t.k"
    return f"SELECT {picked} FROM (SELECT doc_id, coalesce(n_chars % 4, 0) AS lift FROM documents) d JOIN {table} t ON true{join}"


_MASKED = [
    ("js", "a /* x { */ 'b{' `c\n{` // d\ne{}", "ae{}"), ("python", 'x = """a\n#"""  # c\ny = \'#\' + f"z"', "x=y=+"), ("golang", "`{\n`//{\n{}", "{}"),
    ("rust", "let a = r#\"{\"#; // x\nlet l: &'a str = '{';", "leta=;letl:&'astr=;"), ("ruby", "x = '#{' # {\n", "x="), ("java", 'String s = "//"; // "\nint i;', "Strings=;inti;"),
]


def masked_code(spark, sf):
    files = _programs(spark, sf, [(lang, lang, text) for lang, text, _ in _MASKED]).withColumn("m", mask_column())
    return files.select("path", F.regexp_replace("m", r"\s", "").alias("code"), (F.length("m") == F.length("text")).alias("same_length"))


_BLOCKS = [
    ("a.rs", "rust", "async fn f() {\n    std::thread::sleep(d);\n    spawn(move || {\n        std::thread::sleep(d);\n    });\n}\nfn g() {\n    std::thread::sleep(d);\n}\n"),
    ("a.py", "python", "async def f():\n  for x in y:\n    pass\ntry:\n  pass\nexcept E:\n  pass\n"),
    ("a.js", "js", "for (const x of y) {\n  if (x) {\n    go('{');\n  }\n}\n"),
]


def block_regions(spark, sf):
    return regions(_programs(spark, sf, _BLOCKS)).select("path", "kind", "s_line", "e_line")


def blocking_calls(spark, sf):
    """Blocking calls in asynchronous code but not in closures, and those outside of any asynchronous block."""
    files = _programs(spark, sf, _BLOCKS)
    found, blocks = regex_matches(files, {"sleep": ("rust", r"thread::(?P<F>sleep)\(")}), regions(files)
    hot = C.in_context(found, blocks, ["async"], ["closure"]).select(F.lit("hot").alias("where"), "path", "s_line")
    return hot.unionByName(C.outside(found, blocks.where("kind = 'async'")).select(F.lit("outside").alias("where"), "path", "s_line"))


_SYNTAX = "import json\nx = a.b.c.d.e\ny = 1 / n\nz = 1 / 2\nif x is 'a': pass\nfor i in xs:\n    xs.append(i)\ntry:\n    json.loads(s)\nexcept:\n    pass\njson.loads(t)\ndef f():\n    try: pass\n    finally:\n        return 1\nif q == None: pass\n"


_PARSED = [("a.py", "python", _SYNTAX), ("bad.py", "python", "def (")]


def syntax_matches(spark, sf):
    return python_matches(_programs(spark, sf, _PARSED)).select("rule_id", "path", "s_line")


#: (language, family, line of the sink, text with the flow, text without it).
_FLOWS = [
    ("python", "sql", 2, "q = request.args['q']\ncursor.execute('SELECT ' + q)\n", "q = request.args['q']\ncursor.execute('SELECT ?', (q,))\n"),
    ("python", "path", 2, "name = request.args.get('f')\nopen(name)\n", "name = secure_filename(request.args.get('f'))\nopen(name)\n"),
    ("python", "redirect", 3, "u = request.args['next']\nv = u\nredirect(v)\n", "u = request.args['next']\nif urlparse(u).netloc in allowed:\n    redirect(u)\n"),
    ("golang", "outbound", 2, 'u := r.FormValue("u")\nhttp.Get(u)\n', 'u := "https://fixed"\nhttp.Get(u)\nr.FormValue("u")\n'),
    ("js", "regex", 2, "const p = req.query.p;\nnew RegExp(p);\n", "const p = escapeRegExp(req.query.p);\nnew RegExp(p);\n"),
    ("js", "markup", 2, "const a = req.body.a;\nel.innerHTML = a;\n", "const a = req.body.a;\nel.textContent = a; el.innerHTML = 'x';\n"),
    ("java", "header", 2, 'String v = request.getParameter("v");\nresponse.setHeader("X", v);\n', 'String v = "a";\nresponse.setHeader("X", v);\nrequest.getParameter("v");\n'),
    ("ruby", "redirect", 2, "u = params[:u]\nredirect_to u\n", "u = params[:u]\nredirect_to root_path\n"),
    ("csharp", "sql", 2, 'var q = Request.Query["q"];\ndb.FromSqlRaw("select " + q);\n', 'var q = Request.Query["q"];\ndb.FromSqlRaw("select 1");\n'),
    ("elixir", "path", 2, "p = conn.params\nFile.read(p)\n", 'p = conn.params\np = "fixed"\nFile.read(p)\n'),
    ("rust", "command", 2, "let a = std::env::args();\nCommand::new(a);\n", 'let a = std::env::args();\nCommand::new("ls");\n'),
    ("cpp", "command", 2, 'auto c = req.get_param_value("c");\nsystem(c);\n', 'auto c = req.get_param_value("c");\nsystem("ls");\n'),
    ("swift", "outbound", 2, "let u = req.query\nURL(string: u)\n", 'let u = req.query\nURL(string: "x")\n'),
]


_FLOWING = [(f"{lang}.flow.{family}/{k}", lang, t) for lang, family, _, bad, good in _FLOWS for k, t in (("bad", bad), ("good", good), ("hidden", bad.replace("\n", "  scan:ignore\n")))]


def request_flows(spark, sf):
    """Flows of each family's own file; the file without a flow and one whose lines are marked give nothing."""
    found = flows(_programs(spark, sf, _FLOWING), flow_specs())
    return found.where(F.col("rule_id") == F.split("path", "/")[1]).select("path", "line_no")


_CHAINS = [("a.py", "python", "sink(e)\ne = d\nd = c\nc = b\nb = a\na = source\nsink(clean(a))\nsink('a')\n"), ("b.js", "js", "sink(source)\n")]


def flow_rounds(spark, sf):
    """Names bound below their use, over several rounds; the trail keeps its last three steps."""
    spec = FlowSpec("x", "python", 7, "critical", r"\bsource\b", r"\bsink\s*\(", r"\bclean\s*\(", passes=5, path=3)
    return flows(_programs(spark, sf, _CHAINS), [spec]).select("path", "line_no", F.array_join("trail", ">").alias("trail"))


_RESOURCES = [
    ("a.py", "python", "import io as q\nf = open(a)\ng = q.open(b)\ng.close()\nwith open(c) as h:\n    pass\ndef k():\n    r = open(d)\n    return r\ndef m():\n    p = open(e)\n    p.read()\nopen(z).read()\n"),
    ("a.go", "golang", "f, err := os.Open(a)\ng, err := os.Open(b)\ndefer g.Close()\n"),
    ("a.cpp", "cpp", "std::thread t(f);\nstd::thread u(f);\nu.join();\nchar* p = (char*)malloc(3);\n"),
    ("a.cs", "csharp", "var a = new FileStream(x);\nusing var b = new FileStream(y);\n"),
]


def unreleased_resources(spark, sf):
    return issues(_programs(spark, sf, _RESOURCES), (unreleased,)).select("path", "line_no", "kind")


_GUARDS = [
    ("use.java", "java", "if (a == null) {\n log();\n}\na.go();\n"), ("leaves.java", "java", "if (a == null) {\n return;\n}\na.go();\n"), ("given.java", "java", "if (a == null) {\n log();\n}\na = b;\na.go();\n"),
    ("other.java", "java", "if (a == null) {\n log();\n} else {\n a.go();\n}\n"), ("nested.java", "java", "void f() {\n  if (@ == null) {\n    log();\n  }\n  if (b) {\n    @.go();\n  }\n  @.go();\n}\nvoid g() {\n  @.go();\n}\n"), ("all.js", "js", "if (!@) {\n  if (y) { return; } else { throw z; }\n}\n@.go();\n"), ("some.js", "js", "if (!@) {\n  if (y) { return; }\n}\n@.go();\n"),
    ("set.py", "python", "if @ is None:\n    @ = 1\n@.go()\n"), ("use.py", "python", "def f(@):\n    if @ is None:\n        log()\n    return @.go()\n"), ("else.go", "golang", "func f() {\n  if @ == nil {\n    log()\n  } else {\n    @ = q\n  }\n  @.Go()\n}\n"), ("use.rb", "ruby", "if @.nil?\n  log\nend\n@.go\n"), ("use.cpp", "cpp", "if (@ == nullptr) {\n  log();\n}\n@->go();\n"),
    ("use.rs", "rust", "if x.is_none() {\n    log();\n}\nx.unwrap();\n"), ("use.swift", "swift", "if x == nil {\n  log()\n}\nprint(x!)\n"),
]


def narrowed_values(spark, sf):
    return guard_then_use(step(syntax_nodes(_programs(spark, sf, _GUARDS)))).select("path", "line_no", "name")


_SCOPED = [
    ("a.py", "python", "def f():\n    @ = open(a)\n    def g():\n        @.close()\n    @ = open(b)\n    g()\n@ = open(c)\n@.close()\nk = open(d)\ndef z():\n    k = open(e)\n    k.close()\n    k.close()\n"),
    ("a.js", "js", "const @ = setInterval(f, 1);\nfunction stop() { clearInterval(@); clearInterval(@); }\nfunction g() {\n  const @ = setInterval(f, 1);\n}\n"),
    ("a.go", "golang", "func f() {\n  @, err := os.Open(a)\n  defer func() {\n    @.Close()\n  }()\n}\nfunc g() {\n  @, err := os.Open(a)\n}\n"),
    ("a.cpp", "cpp", "void f() {\n  @ = malloc(1);\n  @ = malloc(2);\n  free(@);\n}\n"),
]


def scoped_resources(spark, sf):
    """Resources that are not released, where a release ends the latest open one of its name in the nearest scope that has any."""
    return held_resources(step(syntax_nodes(_programs(spark, sf, _SCOPED)))).select("path", "line_no", "kind", "name")


_FORMS = [
    ("a.js", "js", "if (a.b && a.b.c) {\n  a.b.c.d;\n}\nif ('k' in o) { o.k.a.b; }\nlet v = a && a.b.c.d;\nlet w = Object.hasOwn(o, 'k') ? o.k.a.b : o.k.c.d;\nif (z) { y.a.b.c; }\n"),
    ("a.rb", "ruby", "if h.key?(:k)\n  h.a.b\nend\nif k\n  h.c\nend\n"),
]


def guard_forms(spark, sf):
    """Conditions by form, and the places that they protect."""
    found = guards(step(syntax_nodes(_programs(spark, sf, _FORMS))))
    return C.guard_regions(found.withColumn("path", F.concat_ws("|", "path", "form"))).select(F.split("path", r"\|")[0].alias("path"), F.split("path", r"\|")[1].alias("form"), "s_line", F.col("s_col").alias("col"), "e_line", F.col("e_col").alias("e_col"))


_PATTERNS = [
    ("a.py", "python", "import re\nre.compile(r'([@]+)+$')\nre.match('^[a-z]+@$', x)\nre.sub(r\"(\\w+\\s*)+:\", '', x)\nre.search(r'(?:a|b)*c', x)\nre.compile('(')\n"),
    ("a.js", "js", "const a = /^(\\d+,?)+$/;\nconst b = x / 2 / y;\nnew RegExp('(a*)*@');\nif (/^[^@]+@[^@]+$/.test(x)) { }\n"),
    ("a.java", "java", "Pattern.compile(\"(\\\\w+\\\\s?)*@\");\ns.matches(\"[a-z]+\");\n"),
    ("a.rb", "ruby", "x =~ /(@|@@)+$/\ny =~ /^@+$/\n"),
]


def exponential_regexes(spark, sf):
    """Patterns in programs with a loop that reads one text in two ways."""
    lines = explode_lines(with_patterns(_programs(spark, sf, _PATTERNS)))
    return exponential_patterns(lines).select("path", "line_no", "pattern")


_STARTED = [("a.cs", "csharp", "SaveAsync(x);\nawait SaveAsync(y);\nvar t = SaveAsync(z);\n"), ("a.js", "js", "fetch(u);\nawait fetch(u);\nconst r = fetch(u);\n"), ("a.rs", "rust", "tokio::spawn(f());\nlet h = tokio::spawn(f());\n")]


def dropped_work(spark, sf):
    return issues(_programs(spark, sf, _STARTED), (dropped_tasks,)).select("path", "line_no", "name")


_HOOKED = [("a.jsx", "js", "useEffect(() => { const z = 1; @(id, z); setX(z); }, [id, other]);"), ("b.jsx", "js", "useMemo(() => a + b, [a, b]);")]


def hook_dependencies(spark, sf):
    gaps = C.dependency_gaps(hooks(_programs(spark, sf, _HOOKED)))
    return gaps.select("path", F.array_join("missing", ",").alias("missing"), F.array_join("unused", ",").alias("unused"))


_MANIFESTS = [("requirements.txt", "", "flask\n@==1\n# c\ny>=2\n"), ("src/go.mod", "", "module m\nrequire @ v1.2.3\n"), ("notes.txt", "", "flask\n")]


def unpinned_manifests(spark, sf):
    return manifest_lines(_programs(spark, sf, _MANIFESTS).drop("lang")).select("path", "lang", "line_no", "line")


def match_stream(spark, sf):
    """Matches of a structural matcher as JSON lines, one for each page and one broken line for each."""
    good = F.to_json(F.struct(F.lit("r").alias("ruleId"), F.concat(F.lit("p"), "page_id").alias("file"), F.lit("x").alias("lines"), F.struct(F.struct((F.col("page_id") % 9).alias("line"), F.lit(2).alias("column")).alias("start"), F.struct((F.col("page_id") % 9 + 1).alias("row"), F.lit(0).alias("column")).alias("end")).alias("range")))
    pages = _read(spark, sf, "pages")
    return ingest_matches(pages.select(good.alias("value")).union(pages.select(F.lit("{broken").alias("value")))).select("rule_id", "path", "s_line", "s_col", "e_line", "e_col")


_PLIST = '<?xml version="1.0"?><plist version="1.0"><dict><key>A</key><dict><key>B</key><true/></dict><key>C</key><string>@</string></dict></plist>'


_LISTS = [("Info.plist", "", _PLIST), ("bad.plist", "", "<"), ("x.txt", "", _PLIST)]


def property_lists(spark, sf):
    return plist_settings(_programs(spark, sf, _LISTS))


def notebooks(spark, sf):
    cell = lambda n: '{"cell_type":"code","outputs":[' + ",".join(['{"a":1}'] * n) + "]}"
    docs = _read(spark, sf, "documents").select(F.concat(F.lit("n"), "doc_id", F.lit(".ipynb")).alias("path"), F.concat(F.lit('{"cells":[{"cell_type":"markdown"},'), F.when(F.col("doc_id") % 2 == 0, cell(2)).otherwise(cell(0)), F.lit("]}")).alias("text"))
    return notebook_outputs(docs).groupBy("cells", "with_output").agg(F.count(F.lit(1)).alias("n"))


def report_counts(spark, sf):
    """Counts by level in SARIF reports, one for each supplier."""
    result = lambda level: F.struct(level.alias("level"), F.array(F.struct(F.struct(F.struct(F.lit("a.py").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    key = F.col("s_suppkey")
    results = F.array(result(F.when(key % 2 == 0, "error").otherwise("note")), result(F.lit(None).cast("string")), result(F.when(key % 3 == 0, "warning").otherwise("none")))
    files = _read(spark, sf, "supplier").select(key.cast("string").alias("path"), F.to_json(F.struct(F.array(F.struct(results.alias("results"))).alias("runs"))).alias("text"))
    return sarif_counts(files.unionByName(spark.createDataFrame([("bad", "no")], "path string, text string")))


# --- Reports


def _sums(spark, sf):
    """Findings, summary and totals. Reports read them several times, so the first two, as large as the catalogue, are written once."""
    found = step(_found(spark, sf))
    sums = step(A.summary(found, _files(spark, sf)))
    return found, sums, A.totals(sums)


def text_totals(spark, sf):
    report = sinks.text(*_sums(spark, sf), "p")
    return spark.createDataFrame([(x,) for x in report.splitlines() if x.startswith(("[", "Files", "Critical", "Warning", "Info"))], "line string")


def compact_report(spark, sf):
    found, _, totals = _sums(spark, sf)
    return spark.createDataFrame([(x,) for x in sinks.toon(found, totals).splitlines()], "line string")


def markdown_matrix(spark, sf):
    categories = spark.createDataFrame([(lang, c) for lang in LANGS for c in (1, 2, 3)], "lang string, category int")
    rows = sinks.markdown(A.matrix(_found(spark, sf), categories)).splitlines()[2:]
    return spark.createDataFrame([(x,) for x in rows], "line string")


def page_report(spark, sf):
    """Rows of the page's tables: the totals against a baseline of zeros, and each language."""
    found, sums, totals = _sums(spark, sf)
    nothing = spark.createDataFrame([(0, 0, 0, 0)], "files long, critical long, warning long, info long")
    page = sinks.html(sums, A.difference(totals, nothing, [], ["files", "critical", "warning", "info"]), "p<")
    rows = [x.split("</tr>")[0] for x in page.split("<tr>")[1:] if x.startswith("<td>")]
    return spark.createDataFrame([(x,) for x in rows], "line string")


def combined_report(spark, sf):
    """What a reader of the combined JSON report gets back, a row per scanner."""
    schema = "project string, scanners array<struct<language:string,files:bigint,critical:bigint,findings:array<struct<rule_id:string,severity:string,count:bigint>>>>, totals struct<critical:bigint,files:bigint>"
    j = F.from_json("value", schema)
    rows = sinks.combined(*_sums(spark, sf), "p", "now").select(j.alias("j")).select("j.project", F.explode("j.scanners").alias("s"), F.col("j.totals.critical").alias("all_critical"))
    return rows.select("project", F.col("s.language").alias("lang"), F.col("s.files").alias("files"), F.coalesce(F.size("s.findings"), F.lit(0)).alias("n_findings"), F.coalesce(F.aggregate("s.findings", F.lit(0).cast("long"), lambda a, x: a + x["count"]), F.lit(0).cast("long")).alias("n"), "all_critical")


def shared_report(spark, sf):
    found, sums, totals = _sums(spark, sf)
    base = spark.createDataFrame([(1, 2, 3, 4)], "files long, critical long, warning long, info long")
    delta = A.difference(totals, base, [], ["files", "critical", "warning", "info"])
    shared = sinks.shareable(sinks.combined(found, sums, totals, "p", "now"), delta, "now", {"repository": "r"}, "base.json")
    return shared.select(F.get_json_object("value", "$.git.repository").alias("repository"), F.get_json_object("value", "$.comparison.delta.files").cast("long").alias("files"), F.get_json_object("value", "$.comparison.delta.critical").cast("long").alias("critical"), F.get_json_object("value", "$.project").alias("project"))


def sarif_documents(spark, sf):
    """Runs put together from one document per language, and a broken one."""
    documents = sinks.sarif(*_occurred(spark, sf), "a", "repo", "rev")
    merged = sinks.merged_sarif(documents.select("value").union(spark.createDataFrame([("x",)], "value string")))
    runs = F.from_json("value", "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string>>>>")["runs"]
    return merged.select(F.explode(runs).alias("r")).select(F.col("r.tool.driver.name").alias("name"), F.size("r.results").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        catalogue_occurrences, catalogue_findings, catalogue_one_pass, catalogue_balances, catalogue_lacking, catalogue_ratios, catalogue_look_back, statement_suppression, whole_words, posix_classes, offset_lines, ansi_stripped, debt_totals,
        count_time_suppression, grouped_rule_counts, lenient_severity, foreign_severities, min_severity, exit_gate, merged_reports, guard_region_kinds, context_matches, risky_denominators, last_release, known_permalinks, pruned_files,
        default_ignores, test_directories, language_detection, target_union, changes_or_all, diff_statuses, project_guard, named_paths, chosen_languages, rule_selection, rule_listing, rule_variants, masked_code, block_regions, blocking_calls,
        syntax_matches, request_flows, flow_rounds, unreleased_resources, narrowed_values, scoped_resources, guard_forms, exponential_regexes, dropped_work, hook_dependencies, unpinned_manifests, match_stream, property_lists, notebooks, report_counts, text_totals, compact_report,
        markdown_matrix, page_report, combined_report, shared_report, sarif_documents,
    )
}

_CODE = f"WITH {_CODE_LINES}"
_CODE_HITS = f"{_CODE}, {_rows_sql(_of_kind('line'))}"
_CATALOGUE = "cat AS " + _values([(r.rule_id, r.lang, r.category, r.kind, len(r.tiers), r.tiers[0][1]) for r in rules()], "rule_id, lang, category, kind, n_tiers, worst")
_TIERS = "tiers AS " + _values([(r.rule_id, k, n, s) for r in _of_kind("line") for k, (n, s) in enumerate(r.tiers)], "rule_id, k, min_n, severity")
_SIZES = f"(SELECT lang, count(*) AS n_files FROM (SELECT ['{"', '".join(CODE)}'][(doc_id % 10 + 1)::INT] AS lang FROM documents UNION ALL SELECT lang FROM {_values([(lang,) for _, lang, _ in PROGRAMS], 'lang')}) GROUP BY lang)"
_COUNTED = f"{_CODE_HITS}, {_CATALOGUE}, {_TIERS}, open AS (SELECT rule_id, count(*) AS n FROM code_hits WHERE NOT suppressed GROUP BY rule_id), counted AS (SELECT c.*, coalesce(o.n, 0) AS n FROM cat c LEFT JOIN open o USING (rule_id) WHERE kind = 'line')"
_SEV = ("critical", "warning", "info")
#: Word borders as Java has them, between letters of any script and the rest.
_WORD = r"(?:^|[^\pL\pN_])(?:{})(?:$|[^\pL\pN_])"
_FINDING_LINES = "(SELECT lang, rule_id, severity, n, 'Found ' || split_part(rule_id, '.', 1) AS title FROM found WHERE severity <> 'good')"

SQL: dict[str, str] = {
    "catalogue_occurrences": f"{_CODE_HITS} SELECT rule_id, count(*) AS n, count(DISTINCT path) AS files, count(*) FILTER (suppressed) AS hidden FROM code_hits GROUP BY rule_id",
    "catalogue_findings": f"{_COUNTED} SELECT lang, category, rule_id, coalesce((SELECT severity FROM tiers t WHERE t.rule_id = c.rule_id AND c.n > t.min_n ORDER BY k LIMIT 1), 'good') AS severity, n FROM counted c",
    "catalogue_one_pass": f"{_CODE_HITS}, {_CATALOGUE} SELECT c.lang, c.rule_id, count(h.rule_id) AS n FROM cat c LEFT JOIN code_hits h USING (rule_id) WHERE c.kind = 'line' GROUP BY c.lang, c.rule_id",
    "catalogue_balances": _pair_sql("balance", _SUMS, "a > b") + " SELECT rule_id, path, a AS acquired, b AS released, a - b AS n FROM found",
    "catalogue_lacking": _pair_sql("file_without", _SUMS, "a > 0 AND b = 0") + " SELECT rule_id, path FROM found",
    "catalogue_ratios": _pair_sql("ratio", _SUMS, "a > b", "lang", "") + " SELECT rule_id, a AS first, b AS second, a - b AS n FROM found",
    "catalogue_look_back": f"{_CODE} SELECT lang, count(*) AS n FROM (SELECT lang, bool_or(regexp_matches(line, 'password|secret|token')) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 1 FOLLOWING) AS near FROM code_lines) WHERE near GROUP BY lang",
    "statement_suppression": f"{_CODE}, m AS (SELECT path, line_no FROM code_lines WHERE contains(lower(line), 'token') OR contains(lower(line), 'noqa')), c AS (SELECT DISTINCT l.path, l.line_no FROM code_lines l JOIN m ON m.path = l.path AND m.line_no BETWEEN l.line_no - 1 AND l.line_no + 1 WHERE l.line_no % 2 = 1) SELECT path, count(*) AS n FROM code_lines l WHERE contains(line, 'a') AND NOT EXISTS (SELECT 1 FROM c WHERE c.path = l.path AND l.line_no BETWEEN c.line_no AND c.line_no + 1) GROUP BY path",
    "whole_words": f"{_PLAIN} SELECT lang, count(*) FILTER (regexp_matches(line, '{_WORD.format('de|the')}')) AS word, count(*) FILTER (contains(lower(line), 'token')) AS any_case, count(*) FILTER (regexp_matches(line, '(?i){_WORD.format('la|the')}')) AS \"both\" FROM lines GROUP BY lang",
    "posix_classes": f"{_PLAIN} SELECT lang, count(*) AS n FROM lines WHERE regexp_matches(line, '[[:digit:]]{{4}}[^[:alnum:]_]+[[:upper:]]') GROUP BY lang",
    "offset_lines": "SELECT doc_id AS path, (length(h) - length(replace(h, chr(10), '')) + 1)::INT AS line_no FROM (SELECT doc_id, left(text, (length(text) // 2)::INT) AS h FROM documents WHERE text IS NOT NULL)",
    "ansi_stripped": "SELECT doc_id, sha256(text || 'end') AS digest FROM documents",
    "debt_totals": f"{_PLAIN}, d AS (SELECT lang, lower(replace(replace(line, ' the ', ' TODO '), ' la ', ' fixme ')) AS line FROM lines), c AS (SELECT lang, " + ", ".join(f"count(*) FILTER (contains(line, '{w}')) AS {w}" for w in ("todo", "fixme", "hack", "xxx", "note")) + " FROM d GROUP BY lang) SELECT *, todo + fixme + hack + xxx AS total FROM c",
    "count_time_suppression": f"{_PLAIN} SELECT lang, count(*) FILTER (contains(line, 'TOKEN') OR contains(line, '###')) AS hidden FROM lines GROUP BY lang",
    "grouped_rule_counts": f"{_HITS} SELECT lang, CASE WHEN regexp_matches(rule_id, '^(card|address|mail)[.]') THEN 'personal' ELSE 'style' END AS group_id, count(*) AS n FROM hits WHERE NOT suppressed GROUP BY ALL",
    "lenient_severity": f"{_ALL} SELECT 'async.' || rule_id AS rule_id, CASE severity WHEN 'warning' THEN 'info' ELSE severity END AS severity, n FROM found",
    "foreign_severities": "SELECT ['critical', 'critical', 'warning', 'info', 'info', 'critical', 'info', 'warning'][(event_id % 8 + 1)::INT] AS severity, count(*) AS n FROM events GROUP BY 1",
    "min_severity": f"{_ALL} SELECT rule_id, severity, n FROM found WHERE severity <> 'good'",
    "exit_gate": f"{_ALL}, t AS (SELECT coalesce(sum(n) FILTER (severity = 'critical'), 0) AS c, coalesce(sum(n) FILTER (severity = 'warning'), 0) AS w FROM found) SELECT 'plain' AS name, (c > 0)::INT AS code FROM t UNION ALL SELECT 'strict', (c + w > 0)::INT FROM t UNION ALL SELECT 'lenient', (c > 1000000000)::INT FROM t UNION ALL SELECT 'warned', (w > 0)::INT FROM t UNION ALL SELECT 'empty', 3 UNION ALL SELECT 'empty_allowed', 0",
    "merged_reports": f"{_ALL} SELECT rule_id, 2::BIGINT AS rows, severity, n FROM found",
    "guard_region_kinds": "WITH i AS (SELECT l_linenumber AS k, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber), g AS (SELECT k, CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 3 ELSE 2 END AS s FROM i) SELECT (k + s)::INT AS s_line, count(*) AS n, sum(2 * k + s)::BIGINT AS cols, sum(3 * k + s)::BIGINT AS ends, sum(4 * k + s)::BIGINT AS last FROM g GROUP BY 1",
    "context_matches": f"{_SPANS}, inside AS (SELECT m.path, m.s_line, m.s_col, bool_or(g.s_line % 2 = 0 AND regexp_matches('for q' || g.s_col, 'for q[1-3]')) AS hot, bool_or(g.s_line % 2 <> 0) AS cold FROM m JOIN g ON g.path = m.path AND (m.s_line, m.s_col) >= (g.s_line, g.s_col) AND (m.e_line, m.e_col) <= (g.e_line, g.e_col) GROUP BY ALL) SELECT s_line, count(*) AS n, sum(s_col)::BIGINT AS cols FROM inside WHERE hot AND NOT cold GROUP BY s_line",
    "risky_denominators": f"SELECT * FROM (SELECT c_custkey, [{', '.join(map(_text, _DENOMINATORS))}][(c_custkey % {len(_DENOMINATORS)} + 1)::INT] AS text FROM customer) WHERE text IN ('0', 'n', '0x0', '(k)', 'n || 0', 'max(n, 0)')",
    "last_release": "SELECT user_id AS path, count(*) AS n, min(event_id) AS first FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'signup' AND b.user_id = a.user_id AND b.event_id > a.event_id) GROUP BY user_id",
    "known_permalinks": "SELECT page_id::VARCHAR AS path, CASE WHEN page_id IN (SELECT doc_id FROM labels) THEN 'https://host/blob/main/' || page_id || '#L' || (page_id % 7) END AS url FROM pages",
    "pruned_files": f"WITH {_PATHS} SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM paths JOIN exts ON e = lower(regexp_extract(path, '[^.]*$')) WHERE lang IN ('js', 'python', 'golang') AND n_bytes <= 4000 AND NOT regexp_matches(path, '(^|/)(node_modules|dist|[.]venv)/') GROUP BY lang",
    "default_ignores": f"WITH {_PATHS} SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM paths JOIN exts ON e = lower(regexp_extract(path, '[^.]*$')) WHERE NOT regexp_matches(path, '(^|/)({'|'.join(x.replace('.', '[.]') for x in DEFAULT_IGNORES)})(/|$)') GROUP BY lang",
    "test_directories": f"WITH {_PATHS} SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM paths WHERE NOT regexp_matches(path, '(^|/)(tests|benches)(/|$)')",
    "language_detection": f"WITH {_PATHS}, names AS (SELECT lang FROM paths JOIN exts ON e = lower(regexp_extract(path, '[^.]*$')) UNION ALL SELECT lang FROM {_values([(lang, m) for lang, v in MARKERS.items() for m in v], 'lang, m')}) SELECT lang, count(*) AS n_files FROM names GROUP BY lang",
    "target_union": f"WITH {_PATHS} SELECT split_part(path, '/', 1) AS top, count(*) AS n FROM paths LEFT JOIN exts ON e = lower(regexp_extract(path, '[^.]*$')) WHERE lang = 'python' AND NOT regexp_matches(path, '(^|/)(node_modules|dist|[.]venv)/') OR path LIKE 'node_modules/%' GROUP BY 1",
    "changes_or_all": "SELECT 'changed' AS \"of\", count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'all', count(*) FROM documents",
    "diff_statuses": "SELECT CASE doc_id % 5 WHEN 3 THEN 'new' ELSE 'old' END || doc_id AS path FROM documents WHERE doc_id % 5 IN (0, 1, 3)",
    "project_guard": "WITH s AS (SELECT coalesce(sum(strlen(text)), 0) // 1048576 AS mb FROM documents) SELECT 0 AS limit_mb, true AS passes UNION ALL SELECT 1, mb <= 1 FROM s UNION ALL SELECT 1000000, mb <= 1000000 FROM s",
    "named_paths": "SELECT DISTINCT trim(n_name) AS path FROM nation",
    "chosen_languages": f"SELECT name, lang FROM {_SIZES} s, (VALUES ('all'), ('only'), ('without')) AS t(name) WHERE name = 'all' OR name = 'only' AND lang IN ('golang', 'js') OR name = 'without' AND lang NOT IN ('golang', 'ruby')",
    "rule_selection": f"WITH {_CATALOGUE}, s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS name, lang FROM cat WHERE {where}" for name, (_, where) in _CONFIGS.items()) + f") SELECT name, lang, n, n_files FROM (SELECT name, lang, count(*) AS n FROM s GROUP BY name, lang) JOIN {_SIZES} z USING (lang)",
    "rule_listing": f"WITH {_CATALOGUE} SELECT * FROM cat JOIN {_SIZES} z USING (lang)",
    "rule_variants": f"SELECT {_text(rules()[0].rule_id)} || '-' || lang AS rule_id, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang",
    "masked_code": "SELECT path, code, true AS same_length FROM (" + _made([(lang, lang, text) for lang, text, _ in _MASKED], [(lang, want) for lang, _, want in _MASKED], "path, code") + ")",
    "block_regions": _made(_BLOCKS, [("a.rs", "async", 1, 6), ("a.rs", "closure", 3, 5), ("a.rs", "function", 7, 9), ("a.py", "async", 1, 3), ("a.py", "loop", 2, 3), ("a.py", "try", 4, 7), ("a.py", "catch", 6, 7), ("a.js", "loop", 1, 5), ("a.js", "if", 2, 4)], "path, kind, s_line, e_line"),
    "blocking_calls": _made(_BLOCKS, [("a.rs", "hot", 2), ("a.rs", "outside", 8)], 'path, "where", s_line'),
    "syntax_matches": _made(_PARSED, [("a.py", f"py.{rule}", n) for rule, n in (("bare_except", 10), ("deep_access", 2), ("division", 3), ("division", 4), ("except_pass", 10), ("finally_exit", 16), ("is_literal", 5), ("json_unguarded", 12), ("mutated_loop", 7), ("eq_none", 17))], "path, rule_id, s_line"),
    "request_flows": _made(_FLOWING, [(f"{lang}.flow.{family}/bad", n) for lang, family, n, _, _ in _FLOWS], "path, line_no"),
    "flow_rounds": _made(_CHAINS, [("a.py", 1, "d>e>sink")], "path, line_no, trail"),
    "unreleased_resources": _made(_RESOURCES, [("a.py", 2, "file"), ("a.py", 11, "file"), ("a.py", 13, "file"), ("a.go", 1, "file"), ("a.cpp", 1, "thread"), ("a.cpp", 4, "memory"), ("a.cs", 1, "disposable")], "path, line_no, kind"),
    "narrowed_values": _made(_GUARDS, [("use.java", 4, "a"), ("nested.java", 6, "@"), ("some.js", 4, "@"), ("use.py", 4, "@"), ("else.go", 7, "@"), ("use.rb", 4, "@"), ("use.cpp", 4, "@"), ("use.rs", 4, "x"), ("use.swift", 4, "x")], "path, line_no, name"),
    "exponential_regexes": _made(_PATTERNS, [("a.py", 2, "([@]+)+$"), ("a.py", 4, "(\\w+\\s*)+:"), ("a.js", 1, "^(\\d+,?)+$"), ("a.js", 3, "(a*)*@"), ("a.java", 1, "(\\w+\\s?)*@"), ("a.rb", 1, "(@|@@)+$")], "path, line_no, pattern"),
    "scoped_resources": _made(_SCOPED, [("a.py", 5, "file", "@"), ("a.js", 4, "interval", "@"), ("a.go", 8, "file", "@"), ("a.cpp", 2, "memory", "@")], "path, line_no, kind, name"),
    "guard_forms": _made(_FORMS, [("a.js", "and", 1, 4, 1, 17), ("a.js", "and", 1, 5, 1, 16), ("a.js", "membership", 4, 1, 4, 26), ("a.js", "and", 5, 9, 5, 20), ("a.js", "ternary", 6, 9, 6, 49), ("a.js", "plain", 7, 8, 7, 19), ("a.rb", "membership", 1, 1, 3, 4), ("a.rb", "plain", 5, 3, 6, 4)], "path, form, s_line, col, e_line, e_col"),
    "dropped_work": _made(_STARTED, [("a.cs", 1, "SaveAsync"), ("a.js", 1, "fetch"), ("a.rs", 1, "tokio::spawn")], "path, line_no, name"),
    "hook_dependencies": _made(_HOOKED, [("a.jsx", "@", "other"), ("b.jsx", "", "")], "path, missing, unused"),
    "unpinned_manifests": _made(_MANIFESTS, [("requirements.txt", "python", 1, "flask"), ("requirements.txt", "python", 2, "@==1"), ("requirements.txt", "python", 3, "# c"), ("requirements.txt", "python", 4, "y>=2"), ("src/go.mod", "golang", 1, "module m"), ("src/go.mod", "golang", 2, "require @ v1.2.3")], "path, lang, line_no, line"),
    "match_stream": "SELECT 'r' AS rule_id, 'p' || page_id AS path, (page_id % 9 + 1)::INT AS s_line, 3 AS s_col, (page_id % 9 + 2)::INT AS e_line, 1 AS e_col FROM pages",
    "property_lists": _made(_LISTS, [("Info.plist", "A.B", "true"), ("Info.plist", "C", '"@"')], "path, key, value"),
    "notebooks": "SELECT 2 AS cells, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS with_output, count(*) AS n FROM documents GROUP BY 2",
    "report_counts": "SELECT s_suppkey::VARCHAR AS path, 1::BIGINT AS files, (s_suppkey % 2 = 0)::BIGINT AS critical, 1 + (s_suppkey % 3 = 0)::BIGINT AS warning, (s_suppkey % 2 <> 0)::BIGINT + (s_suppkey % 3 <> 0)::BIGINT AS info FROM supplier",
    "text_totals": f"{_ALL}, {_SUMMARY}, t AS (SELECT sum(files)::BIGINT AS \"Files\", sum(critical)::BIGINT AS \"Critical\", sum(warning)::BIGINT AS \"Warning\", sum(info)::BIGINT AS \"Info\" FROM summary) SELECT name || ': ' || v AS line FROM (UNPIVOT t ON \"Files\", \"Critical\", \"Warning\", \"Info\" INTO NAME name VALUE v) UNION ALL SELECT '[' || severity || '] ' || lang || ' ' || rule_id || ' (' || n || '): ' || title || '. Look at it' FROM {_FINDING_LINES}",
    "compact_report": f"{_ALL}, {_SUMMARY}, f AS {_FINDING_LINES}, t AS (SELECT sum(files)::BIGINT AS files, sum(critical)::BIGINT AS critical, sum(warning)::BIGINT AS warning, sum(info)::BIGINT AS info FROM summary) SELECT 'findings[' || (SELECT count(*) FROM f) || ']{{lang,rule_id,severity,n,title}}:' AS line UNION ALL SELECT '  ' || concat_ws(',', lang, rule_id, severity, n, title) FROM f UNION ALL SELECT 'totals:' UNION ALL SELECT '  ' || name || ': ' || v FROM (UNPIVOT t ON files, critical, warning, info INTO NAME name VALUE v)",
    "markdown_matrix": f"{_ALL}, x AS (SELECT l.lang, c.category, " + ", ".join(f"coalesce((SELECT sum(n) FROM found f WHERE f.lang = l.lang AND f.category = c.category AND severity = '{s}'), 0)::BIGINT AS {s}" for s in _SEV) + f" FROM (VALUES {', '.join(f'({_text(x)})' for x in LANGS)}) AS l(lang), (VALUES (1), (2), (3)) AS c(category)) SELECT '| ' || concat_ws(' | ', lang, category, critical + warning + info, critical, warning, info) || ' |' AS line FROM x",
    "page_report": f"{_ALL}, {_SUMMARY}, t AS (SELECT sum(critical)::BIGINT AS critical, sum(warning)::BIGINT AS warning, sum(info)::BIGINT AS info FROM summary) SELECT '<td>' || name || '</td><td>' || v || '</td><td>0</td><td>+' || v || '</td>' AS line FROM (UNPIVOT t ON critical, warning, info INTO NAME name VALUE v) UNION ALL SELECT '<td>' || concat_ws('</td><td>', lang, files, critical, warning, info) || '</td>' FROM summary",
    "combined_report": f"{_ALL}, {_SUMMARY} SELECT 'p' AS project, lang, files, (SELECT count(*) FROM found f WHERE f.lang = s.lang AND severity <> 'good')::INT AS n_findings, critical + warning + info AS n, (SELECT sum(critical) FROM summary)::BIGINT AS all_critical FROM summary s",
    "shared_report": f"{_ALL}, {_SUMMARY} SELECT 'r' AS repository, sum(files)::BIGINT - 1 AS files, sum(critical)::BIGINT - 2 AS critical, 'p' AS project FROM summary",
    "sarif_documents": f"{_ALL} SELECT 'textloom-' || h.lang AS name, count(*)::INT AS n FROM hits h JOIN found f ON f.rule_id = h.rule_id AND f.severity <> 'good' WHERE NOT h.suppressed GROUP BY 1",
}

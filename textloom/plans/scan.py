"""A whole scan: files in, findings, summaries and totals out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.source import plist_settings, python_matches, regex_matches, regions, statements
from ..functions.syntax import syntax_nodes
from ..functions.text import explode_lines
from ..operators.aggregate import at_least, counts, difference, exit_code, findings, matrix, samples, summary, totals
from ..operators.correlate import dependency_gaps, guard_regions, in_context, outside, risky_divisions
from ..operators.dataflow import FAMILIES, python_flows
from ..operators.flow import flow_specs, flows
from ..operators.ambiguity import PLACES, exponential_patterns, with_patterns
from ..operators.control import GUARD_WORDS, NARROWINGS, guard_then_use, guards
from ..operators.lifecycle import DROPPED, hooks, issues
from ..operators.lines import balances, has_marker, lacking, mark_suppressed, occurrences, ratios, unreachable
from ..operators.prune import TEST_MARKER, detected_languages, module_edges, outside_test_directories, prune, test_only_modules, without
from ..sources import sinks
from ..sources.steps import by_key, spread, step
from ..sources.tree import manifest_lines
from ..sources.versions import ignore_rules, version_ignored
from .catalogue import ALWAYS_CRITICAL, ALWAYS_INFO, ALWAYS_WARNING, Rule, rules
from .trees import WORDS, tree_rules
from .userrules import SyntaxRule, syntax_rule_matches

#: Rules of the structural checks: (rule_id, language, category, tiers, title, remediation).
STRUCTURAL: list[Rule] = [
    Rule("py.deep_access", "python", 1, "match", "", "", ((15, "info"), (0, "info")), "Long attribute chains", "Guard the parts that may be missing"),
    Rule("py.division", "python", 2, "match", "", "", ((25, "warning"), (0, "info")), "Division by something that may be zero", "Check for zero first"),
    Rule("py.is_literal", "python", 4, "match", "", "", ALWAYS_WARNING, "Identity with a literal", "Use =="),
    Rule("py.eq_none", "python", 1, "match", "", "", ALWAYS_WARNING, "None is compared by value", "Use is"),
    Rule("py.bare_except", "python", 6, "match", "", "", ALWAYS_CRITICAL, "A handler for everything", "Name the errors"),
    Rule("py.except_pass", "python", 6, "match", "", "", ((3, "warning"),), "An error is dropped", "Handle it"),
    Rule("py.finally_exit", "python", 10, "match", "", "", ALWAYS_WARNING, "A jump out of finally", "Move it behind"),
    Rule("py.mutated_loop", "python", 3, "match", "", "", ALWAYS_WARNING, "A collection changes under its loop", "Loop over a copy"),
    Rule("py.json_unguarded", "python", 9, "match", "", "", ALWAYS_WARNING, "JSON is read without a handler", "Catch the error"),
]
_DIVISION = r"(?<!return)(?<!typeof)(?<!case)(?<=[\w)\]])[ \t]*(?<![/*])/(?![/*=>])[ \t]*(?P<R>[A-Za-z_$][\w$.:]*(?:[ \t]*\([^()\n]*\))?|\([^()\n]*\))"
_CHAIN = r"(?<![\w$.?)\]])[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*){3,}"
#: The same checks by pattern: (rule, pattern in the masked text, pattern of the guards that excuse beside the blocks of an if).
PATTERNED: list[tuple[Rule, str, str | None]] = [
    *((Rule(f"{lang}.division", lang, c, "match", "", "", tiers, "Division by something that may be zero", "Check for zero first"), _DIVISION, None) for lang, c, tiers in (("js", 2, ((25, "warning"), (0, "info"))), ("cpp", 6, ((15, "warning"),)), ("rust", 4, ((0, "info"),)), ("ruby", 2, ((25, "warning"), (0, "info"))))),
    (Rule("js.deep_access", "js", 1, "match", "", "", ((20, "warning"), (0, "info")), "Long attribute chains", "Guard the parts that may be missing"), _CHAIN, r"\bif\s*\([^{};]*|[\w$.]+\s*&&[^;{}\n]*"),
]
#: Calls that may not stand in a kind of block: (rule, pattern, kinds of blocks, blocks that excuse).
CONTEXTUAL: list[tuple[Rule, str, list[str], list[str], str | None]] = [
    (Rule("rust.blocking_in_async", "rust", 20, "context", "", "", ALWAYS_WARNING, "A blocking call in asynchronous code", "Use the asynchronous form"), r"\b(std::)?(thread::sleep|fs::\w+|net::TcpStream::connect)\s*\(", ["async"], ["closure"], None),
    (Rule("rust.panic_in_drop", "rust", 21, "context", "", "", ALWAYS_CRITICAL, "A destructor may panic", "Log the error instead"), r"\b(panic|unreachable|todo)!\s*\(|\.(unwrap|expect)\s*\(", ["drop"], [], None),
    (Rule("rust.clone_in_loop", "rust", 24, "context", "", "", ((5, "info"),), "Clones inside a loop", "Borrow, or clone once"), r"\.clone\s*\(\)", ["loop"], ["closure", "async"], None),
    (Rule("golang.defer_in_loop", "golang", 5, "context", "", "", ALWAYS_WARNING, "defer inside a loop", "Put the body into a function"), r"(?m)^\s*defer\b", ["loop"], ["closure"], None),
    (Rule("java.string_in_loop", "java", 10, "context", "", "", ((3, "info"),), "Text grows inside a loop", "Use a StringBuilder"), r"\b\w+\s*\+=\s*\"", ["loop"], [], None),
    (Rule("csharp.sync_in_async", "csharp", 20, "context", "", "", ALWAYS_WARNING, "Blocking on a task in asynchronous code", "Await it"), r"\.(Result|Wait\(\)|GetAwaiter\(\)\.GetResult\(\))", ["async"], [], None),
    (Rule("js.sync_io_in_async", "js", 18, "context", "", "", ALWAYS_WARNING, "Synchronous file access in asynchronous code", "Use the promises form"), r"\b(fs\.)?\w+Sync\s*\(", ["async"], [], None),
    (Rule("python.blocking_in_async", "python", 5, "context", "", "", ALWAYS_WARNING, "A blocking call in asynchronous code", "Use the asynchronous form"), r"\b(time\.sleep|requests\.\w+|urlopen|subprocess\.run)\s*\(", ["async"], [], None),
    (Rule("python.compile_in_loop", "python", 12, "context", "", "", ALWAYS_INFO, "A pattern is compiled inside a loop", "Compile it once"), r"\bre\.compile\s*\(", ["loop"], [], None),
]
#: Settings of property lists: (rule, pattern of the key, value as JSON).
SETTINGS: list[tuple[Rule, str, str]] = [
    (Rule("swift.plist.any_transport", "swift", 7, "setting", "", "", ALWAYS_CRITICAL, "Transport security is off", "Name the domains that need it"), r"(^|\.)NSAllowsArbitraryLoads\w*$", "true"),
    (Rule("swift.plist.insecure_domain", "swift", 7, "setting", "", "", ALWAYS_WARNING, "A domain may be read without encryption", "Use https"), r"\.NS(Temporary)?ExceptionAllowsInsecureHTTPLoads$", "true"),
    (Rule("swift.plist.debuggable", "swift", 7, "setting", "", "", ALWAYS_WARNING, "A debugger may attach to the release", "Leave the entitlement to development builds"), r"(^|\.)(com\.apple\.security\.)?get-task-allow$", "true"),
    (Rule("swift.plist.file_sharing", "swift", 7, "setting", "", "", ALWAYS_INFO, "Documents are shared with the desktop", "Check that none is private"), r"^UIFileSharingEnabled$", "true"),
]
#: Flows along definitions and uses, graded SQL texts, lists of a hook's dependencies.
ORDERED: list[Rule] = [Rule(f"python.ordered.{f.name}", "python", 7, "ordered", "", "", ALWAYS_CRITICAL, f.title, "Check the value before it is used") for f in FAMILIES]
SQL_TEXTS: list[Rule] = [
    Rule("python.sql_text.tainted", "python", 7, "sql_text", "", "", ALWAYS_CRITICAL, "SQL is put together from values", "Pass them as parameters"),
    Rule("python.sql_text.unknown", "python", 7, "sql_text", "", "", ALWAYS_WARNING, "SQL is put together from parts of unknown origin", "Pass them as parameters"),
]
PATTERNS: list[Rule] = [Rule(f"{lang}.regex.exponential", lang, 7, "pattern", "", "", ALWAYS_WARNING, "A pattern can take exponential time", "Let its loops read a text in one way only") for lang in PLACES]
HOOKS: list[Rule] = [
    Rule("js.hooks.missing", "js", 4, "hook", "", "", ALWAYS_WARNING, "A hook uses what its dependencies lack", "Add the names"),
    Rule("js.hooks.unused", "js", 4, "hook", "", "", ALWAYS_INFO, "A hook depends on what it does not use", "Remove the names"),
]
_LIFECYCLE = {"python": 19, "golang": 17, "java": 19, "cpp": 16, "csharp": 19, "ruby": 8, "swift": 16, "js": 19, "rust": 19, "elixir": 8}


def _issue_rules() -> list[Rule]:
    out = []
    for lang, category in _LIFECYCLE.items():
        out.append(Rule(f"{lang}.lifecycle.named", lang, category, "issue", "", "", ALWAYS_WARNING, "A resource is not released", "Release it in all paths"))
        if lang in {n.lang for n in NARROWINGS}:
            out.append(Rule(f"{lang}.narrowing", lang, 1, "issue", "", "", ALWAYS_WARNING, "A value is used in spite of a failed check", "Leave the block, or use another value"))
        if lang in DROPPED or lang == "python":  # Python's by its syntax, as tasks that nothing takes over
            out.append(Rule(f"{lang}.async.dropped", lang, 3, "issue", "", "", ALWAYS_WARNING, "Asynchronous work is started and dropped", "Keep the handle"))
    return out


def all_rules(config: ScanConfig, extra: list[Rule] | None = None) -> list[Rule]:
    """Rules of every kind that take part in a scan."""
    flow = [Rule(s.rule_id, s.lang, s.category, "flow", "", "", ALWAYS_CRITICAL, s.title, "Validate the value before it is used") for s in flow_specs()]
    more = [*STRUCTURAL, *(p[0] for p in PATTERNED), *(c[0] for c in CONTEXTUAL), *flow, *_issue_rules(), *ORDERED, *SQL_TEXTS, *PATTERNS, *HOOKS, *(s[0] for s in SETTINGS), *(r.rule for r in tree_rules())]
    more += [Rule(f"{lang}.unreachable", lang, 10, "next_line", "", "", ((5, "info"),), "Code behind a jump", "Delete it") for lang in ("js", "python", "golang", "java", "csharp")]
    return rules(config, extra) + [r for r in more if config.runs(r.lang, r.category, r.rule_id)]


@dataclass
class ScanResult:
    files: DataFrame
    occurrences: DataFrame
    findings: DataFrame
    summary: DataFrame
    totals: DataFrame
    config: ScanConfig
    languages: DataFrame

    def exit_code(self) -> int:
        t = self.totals.first()
        c = self.config
        return exit_code(t["critical"], t["warning"], t["files"], c.strict, c.allow_empty, c.max_critical, c.max_warning)

    def report(self, project: str = "", timestamp: str = "") -> DataFrame:
        """``(value)``: the report in the scan's format, a row a document or line; ``max_details`` bounds the findings of the text form.

        Rows of the catalogue's size are put together on the driver; occurrences (sarif) and lines (jsonl) are not.
        """
        spark, kind = self.files.sparkSession, self.config.format
        if kind == "json":
            return sinks.combined(self.findings, self.summary, self.totals, project, timestamp)
        if kind == "jsonl":
            return sinks.jsonl(self.findings, self.summary, self.totals).select("value")
        if kind == "sarif":
            return sinks.sarif(self.occurrences, self.findings).select("value")
        if kind in ("csv", "markdown"):
            places = self.findings.select("lang", "category").distinct().join(self.summary.select("lang"), "lang", "left_semi")
            table = matrix(self.findings, places)
            return table.select(F.to_csv(F.struct("lang", "category", "total", "critical", "warning", "info")).alias("value")) if kind == "csv" else spark.createDataFrame([(sinks.markdown(table),)], "value string")
        if kind == "html":
            nothing = spark.createDataFrame([(0, 0, 0, 0)], "files long, critical long, warning long, info long")
            return spark.createDataFrame([(sinks.html(self.summary, difference(self.totals, nothing, [], ["files", "critical", "warning", "info"]), project),)], "value string")
        text = sinks.toon(self.findings, self.totals) if kind == "compact" else sinks.text(self.findings, self.summary, self.totals, project, self.config.max_details)
        return spark.createDataFrame([(text,)], "value string")


def _taking_part(files: DataFrame, config: ScanConfig) -> DataFrame:
    """The files that are scanned. Where that takes joins, as ignore rules and modules for tests do, they are written once: every kind of rule reads them."""

    def pruned(some: DataFrame) -> DataFrame:
        return outside_test_directories(prune(some, config)) if config.exclude_tests else prune(some, config)

    kept = pruned(files)
    gone = [step(version_ignored(kept, ignore_rules(files)))] if config.respect_ignore_files else []
    if config.exclude_tests:
        edges = module_edges(pruned(files.where("endswith(path, '.rs')")))
        for end in ("src", "dst") if gone else ():
            edges = edges.join(gone[0].withColumnRenamed("path", end), end, "left_anti")
        gone.append(test_only_modules(edges))
    return step(without(by_key(kept, "path"), reduce(DataFrame.unionByName, gone))) if gone else spread(kept)


def _suppressed(seen: list[DataFrame], others: list[DataFrame], texts: DataFrame, lines_of: Callable[[DataFrame], DataFrame], config: ScanConfig) -> DataFrame:
    """Occurrences of all kinds, ``seen`` with and ``others`` without suppressed, with what the markers cover; only texts that hold a marker are looked at for that."""
    marked = texts.where(has_marker("text", config.markers))
    marks = lines_of(marked).where("suppressed").select(F.col("path").alias("_p"), F.col("line_no").alias("_l"))
    if config.statement_suppression:
        # A marker anywhere in a statement, or on the line above it, holds for all its lines.
        marks = step(marks)
        spans = statements(marked).join(marks, (F.col("path") == F.col("_p")) & F.col("_l").between(F.col("s_line"), F.col("e_line"))).select("_p", F.explode(F.sequence("s_line", "e_line")).alias("_l"))
        marks = marks.unionByName(spans)
        seen, others = [], [*(s.withColumn("_here", F.col("suppressed")).drop("suppressed") for s in seen), *others]
    if others:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others)
        here = F.coalesce("_here", F.lit(False)) if "_here" in rows.columns else F.lit(False)
        found = rows.join(marks.distinct(), (F.col("path") == F.col("_p")) & (F.col("line_no") == F.col("_l")), "left")
        seen = [*seen, found.select("lang", "category", "rule_id", "path", "line_no", "code", (here | F.col("_p").isNotNull()).alias("suppressed"))]
    return reduce(DataFrame.unionByName, seen)


def scan(files: DataFrame, config: ScanConfig | None = None, extra: list[Rule] | None = None, own: list[SyntaxRule] | None = None) -> ScanResult:
    """Scan ``files`` (FILES, or path and text at least) by the catalogue, ``extra`` rules and a user's ``own`` syntax rules.

    One pass over the lines serves all line rules; balances and missing partners are one aggregation per file;
    the checks of whole texts run in Python, file by file. Occurrences of all kinds have one form and one
    suppression, so counts, samples and reports do not depend on the kind.
    """
    config = config or ScanConfig()
    spark = files.sparkSession
    kept = _taking_part(files, config)
    texts = kept.select("path", "lang", "text")
    own = [r for r in own or [] if config.runs(r.rule.lang, r.rule.category, r.rule.rule_id)]
    chosen = all_rules(config, extra) + [r.rule for r in own]
    by = {kind: [r for r in chosen if r.kind == kind] for kind in {r.kind for r in chosen}}

    def lines_of(some: DataFrame) -> DataFrame:
        return mark_suppressed(explode_lines(some, previous=True, until=TEST_MARKER if config.exclude_tests else None), config.markers, config.suppress_previous_line)

    lines = lines_of(texts)
    seen = [occurrences(lines, by.get("line", []))]
    #: Rows of the other kinds; which of them a marker covers is looked up at once.
    others: list[DataFrame] = []

    def add(rows: DataFrame, ids: set[str]) -> None:
        others.append(rows.where(F.col("rule_id").isin(sorted(ids))).select("lang", "category", "rule_id", "path", "line_no", "code"))

    known = spark.createDataFrame(list({r.rule_id: (r.rule_id, r.lang, r.category) for r in chosen}.values()), "_id string, lang string, category int")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(known), F.col("rule_id") == F.col("_id"))

    if by.get("manifest"):
        add(occurrences(manifest_lines(files.select("path", "text")), by["manifest"]).withColumn("line_no", F.col("line_no")), {r.rule_id for r in by["manifest"]})
    if by.get("match"):
        found = python_matches(texts)
        found = found.where("rule_id <> 'py.division'").unionByName(risky_divisions(found.where("rule_id = 'py.division'")))
        wanted = [p for p in PATTERNED if p[0] in by["match"]]
        if wanted:
            more = regex_matches(texts, {r.rule_id: (r.lang, p) for r, p, _ in wanted})
            divided = F.col("rule_id").endswith(".division")
            found = found.unionByName(risky_divisions(more.where(divided)))
            tests = {r.rule_id: (r.lang, g) for r, _, g in wanted if g}
            if tests:
                places = ["path", "s_line", "s_col", "e_line", "e_col"]
                langs = sorted({lang for lang, _ in tests.values()})
                protected = guard_regions(guards(syntax_nodes(texts.where(F.col("lang").isin(*langs) & F.col("text").rlike(r"\bif\b|\bunless\b|&&|\?")))))
                excused = regex_matches(texts, tests).select(*places).unionByName(protected.select(*places))
                found = found.unionByName(outside(more.where(~divided), excused))
        add(placed(found.select("rule_id", "path", F.col("s_line").alias("line_no"), "code")), {r.rule_id for r in by["match"]})
    if by.get("context"):
        wanted = [c for c in CONTEXTUAL if c[0] in by["context"]]
        # Written once: each rule's join reads rows, and does not match the texts again.
        found, blocks = step(regex_matches(texts, {r.rule_id: (r.lang, p) for r, p, *_ in wanted})), step(regions(texts.where(F.col("lang").isin(*sorted({r.lang for r, *_ in wanted})))))
        parts = [in_context(found.where(F.col("rule_id") == r.rule_id), blocks, kinds, cold, header) for r, _, kinds, cold, header in wanted]
        add(placed(reduce(DataFrame.unionByName, parts).select("rule_id", "path", F.col("s_line").alias("line_no"), "code")), {r.rule_id for r in by["context"]})
    if by.get("flow"):
        ids = {r.rule_id for r in by["flow"]}
        found = flows(texts, [s for s in flow_specs() if s.rule_id in ids], config.markers)
        add(placed(found.select("rule_id", "path", "line_no", F.concat_ws("  # ", "code", F.array_join("trail", " -> ")).alias("code"))), ids)
    if by.get("issue"):
        guarded = texts.where(F.col("lang").isin(*sorted({n.lang for n in NARROWINGS})) & F.col("text").rlike(GUARD_WORDS))
        empty = guard_then_use(step(syntax_nodes(guarded))).select("path", "lang", "line_no", F.lit("narrowing").alias("kind"), "name", F.concat("name", F.lit(" is used although a guard let it be empty")).alias("message"))
        found = issues(texts).unionByName(empty).withColumnRenamed("lang", "_lang")
        name = F.when(F.col("kind") == "narrowing", ".narrowing").when((F.col("kind") == "dropped") | (F.col("_lang") == "python") & (F.col("kind") == "task"), ".async.dropped").otherwise(".lifecycle.named")
        add(placed(found.select(F.concat("_lang", name).alias("rule_id"), "path", "line_no", F.col("message").alias("code"))), {r.rule_id for r in by["issue"]})
    if ids := {r.rule_id for kind in ("ordered", "sql_text") for r in by.get(kind, [])}:
        # Markers are looked at below, as for all kinds.
        found = python_flows(texts, ()).select("rule_id", "path", "line_no", F.concat_ws("  # ", "code", F.array_join("trail", " -> ")).alias("code"))
        add(placed(found), ids)
    if by.get("pattern"):
        found = exponential_patterns(explode_lines(with_patterns(texts))).withColumnRenamed("lang", "_lang")
        add(placed(found.select(F.concat("_lang", F.lit(".regex.exponential")).alias("rule_id"), "path", "line_no", F.col("pattern").alias("code"))), {r.rule_id for r in by["pattern"]})
    if by.get("hook"):
        gaps = dependency_gaps(hooks(texts))
        each = F.explode(F.array(*[F.struct(F.lit(f"js.hooks.{k}").alias("rule_id"), F.array_join(k, ", ").alias("code")) for k in ("missing", "unused")])).alias("x")
        add(placed(gaps.select("path", "line_no", each).select("x.rule_id", "path", "line_no", "x.code").where("code <> ''")), {r.rule_id for r in by["hook"]})
    if by.get("setting"):
        kinds = [F.when(F.col("key").rlike(p) & (F.col("value") == v), F.lit(r.rule_id)) for r, p, v in SETTINGS]
        settings = plist_settings(files.select("path", "text")).select(F.coalesce(*kinds).alias("rule_id"), "path", F.lit(0).alias("line_no"), F.concat_ws(" = ", "key", "value").alias("code"))
        add(placed(settings.where("rule_id IS NOT NULL")), {r.rule_id for r in by["setting"]})
    ids = {r.rule_id for r in by.get("syntax", [])}
    trees = [r for r in tree_rules() if r.rule.rule_id in ids] + own
    if trees:
        asked = {r.rule.lang for r in own}  # a user's rules may hold anywhere
        found = syntax_rule_matches(texts, trees, {lang: words for lang, words in WORDS.items() if lang not in asked})
        add(placed(found.select("rule_id", "path", F.col("s_line").alias("line_no"), "code")), {r.rule.rule_id for r in trees})
    if by.get("next_line"):
        dead = unreachable(lines)
        seen.append(placed(dead.withColumnRenamed("lang", "_of").select(F.concat("_of", F.lit(".unreachable")).alias("rule_id"), "path", "line_no", F.col("line").alias("code"), "suppressed")).select("lang", "category", "rule_id", "path", "line_no", "code", "suppressed"))
    # Written once: counts, samples and every report start from here, and not from the texts.
    every = step(_suppressed(seen, others, texts, lines_of, config))
    counted = [counts(every)]
    open_lines = lines.where("NOT suppressed")
    if by.get("balance"):
        counted.append(counts(balances(open_lines, by["balance"])))
    if by.get("file_without"):
        counted.append(counts(lacking(open_lines, by["file_without"])))
    if by.get("ratio"):
        counted.append(ratios(open_lines, by["ratio"]).select("lang", "category", "rule_id", "n"))
    found = findings(spark, reduce(DataFrame.unionByName, counted), chosen, samples(every, config.samples), config.strict)
    sums = summary(found, kept)
    return ScanResult(kept, every, at_least(found, config.min_severity), sums, totals(sums), config, detected_languages(files))

"""Registered queries: the engine's operators over the test tables, each with the SQL that gives the same rows.

Any table of texts is a corpus: ``documents`` with lang as the language, ``pages`` with the address as the path,
``conversations`` with a turn as a line. ``lineitem``, ``orders`` and ``events`` exercise the operators that
do not need text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ScanConfig
from ..functions.source import mask_column
from ..functions.text import explode_lines, extension, ignored, match_record, number_literal
from ..operators import aggregate as A
from ..operators import correlate as C
from ..operators import lines as L
from ..operators import prune as P
from ..operators.flow import FlowSpec, flows
from ..sources import sinks
from ..sources.steps import spread, step
from ..sources.tree import table_as_files
from .catalogue import Rule, variants

LANGS = ("en", "fr", "de", "es")
#: Rules over prose: (name, pattern, veto, tiers).
_PROSE = (
    ("secret", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[:=]", r"(?i)example", ((0, "critical"),)),
    ("card", r"(^|[^0-9])[0-9]{16}([^0-9]|$)", "", ((50, "critical"), (5, "warning"), (0, "info"))),
    ("address", r"([0-9]{1,3}\.){3}[0-9]{1,3}", "", ((20, "warning"), (0, "info"))),
    ("mail", r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+", "", ((20, "warning"), (0, "info"))),
    ("shout", r"[A-Z]!!", "", ((100, "warning"), (10, "info"))),
    ("table", r" \| .* \| ", "", ((100, "warning"), (10, "info"))),
    ("insult", r"(?i)(^|[^a-z])(idiot|moron|clown|worthless|pathetic)([^a-z]|$)", "", ((0, "critical"),)),
    ("licence", r"(?i)(copyright|licen[sc]e)", "", ((0, "info"),)),
    ("never", r"zzzz9999zzzz", "", ((0, "critical"),)),
)
RULES = [v for k, (name, p, x, tiers) in enumerate(_PROSE) for v in variants(Rule(name, "en", 1 + k // 3, "line", p, x, tiers, f"Found {name}", "Look at it"), {lang: f".{lang}" for lang in LANGS})]
MARKERS = ("###", "token =")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table_as_files(_read(spark, sf, "documents"), "doc_id", "text", "lang")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lines(_files(spark, sf).select("path", "lang", "text"))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return L.mark_suppressed(explode_lines(_files(spark, sf).select("path", "lang", "text"), previous=True), MARKERS)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return A.findings(spark, A.counts(L.occurrences(_marked(spark, sf), RULES)), RULES)


def _occurred(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences, written once, and the findings that are counted from them."""
    every = step(L.occurrences(_marked(spark, sf), RULES))
    return every, A.findings(spark, A.counts(every), RULES)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


_LINES = r"""
lines AS (
  SELECT path, lang, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id::VARCHAR AS path, lang, regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS p
        FROM documents WHERE length(text) > 0)
), marked AS (
  SELECT *, here OR coalesce(lag(here) OVER (PARTITION BY path ORDER BY line_no), false) AS suppressed
  FROM (SELECT *, contains(lower(line), '###') OR contains(lower(line), 'token =') AS here FROM lines)
)"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _hits_sql() -> str:
    parts = []
    for r in RULES:
        veto = f" AND NOT regexp_matches(line, {_text(r.exclude)})" if r.exclude else ""
        parts.append(f"SELECT lang, {r.category} AS category, {_text(r.rule_id)} AS rule_id, path, line_no, line AS code, suppressed FROM marked WHERE lang = {_text(r.lang)} AND regexp_matches(line, {_text(r.pattern)}){veto}")
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


def _rules_sql() -> str:
    rows = []
    for r in RULES:
        case = " ".join(f"WHEN n > {n} THEN {_text(s)}" for n, s in r.tiers)
        rows.append(f"SELECT {_text(r.lang)} AS lang, {r.category} AS category, {_text(r.rule_id)} AS rule_id, CASE {case} ELSE 'good' END AS severity, n FROM (SELECT count(*) AS n FROM hits WHERE rule_id = {_text(r.rule_id)} AND NOT suppressed)")
    return "found AS (" + " UNION ALL ".join(rows) + ")"


_ALL = f"WITH {_LINES}, {_hits_sql()}, {_rules_sql()}"
_HITS = f"WITH {_LINES}, {_hits_sql()}"
_PLAIN = f"WITH {_LINES}"
_BAL = [Rule(f"open.{lang}", lang, 1, "balance", r"[(,]", r"[.)]", ((0, "warning"),), "", "") for lang in LANGS]
_LACK = [Rule(f"lack.{lang}", lang, 1, "file_without", r"[0-9]{16}", r"[A-Z]!!", ((0, "warning"),), "", "") for lang in LANGS]
_RATIO = [Rule(f"ratio.{lang}", lang, 1, "ratio", r",", r"[0-9]", ((0, "warning"),), "", "") for lang in LANGS]


def lines_by_lang(spark, sf):
    return _lines(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("path").alias("n_files"), F.max("line_no").alias("longest"), F.sum(F.length("line")).alias("n_chars"))


def secrets_by_lang(spark, sf):
    return _found(spark, sf).where("rule_id LIKE 'secret%'").select("lang", "severity", "n")


def rule_occurrences(spark, sf):
    return L.occurrences(_marked(spark, sf), RULES).select("lang", "category", "rule_id", F.col("path").cast("long").alias("path"), "line_no", F.length("code").alias("n_chars"), "suppressed")


def rule_findings(spark, sf):
    return _found(spark, sf).select("lang", "category", "rule_id", "severity", "n")


def one_pass_counts(spark, sf):
    return L.one_pass_counts(_lines(spark, sf), RULES)


def having_threshold(spark, sf):
    return A.histogram(L.occurrences(_lines(spark, sf), RULES)).where("n > 25")


def first_samples(spark, sf):
    rows = A.samples(L.occurrences(_marked(spark, sf), RULES), 3)
    return rows.select("rule_id", F.posexplode("samples").alias("k", "s")).select("rule_id", "k", F.col("s.file").alias("file"), F.col("s.line").alias("line"))


def suppressed_lines(spark, sf):
    return _marked(spark, sf).groupBy("lang").agg(F.count(F.when(F.col("suppressed"), 1)).alias("hidden"), F.count(F.lit(1)).alias("n"))


def severity_rollup(spark, sf):
    return A.subtotals(_found(spark, sf))


def category_sums(spark, sf):
    return A.by_category(_found(spark, sf))


def category_matrix(spark, sf):
    categories = spark.createDataFrame([(lang, c) for lang in LANGS for c in (1, 2, 3, 4)], "lang string, category int")
    return A.matrix(_found(spark, sf), categories)


def scanner_summary(spark, sf):
    return A.summary(_found(spark, sf), _files(spark, sf))


def combined_totals(spark, sf):
    return A.totals(scanner_summary(spark, sf))


def severe_first(spark, sf):
    return A.worst_first(A.at_least(_found(spark, sf), "warning")).limit(5).select("rule_id", "severity", "n")


def baseline_difference(spark, sf):
    docs, labels = _read(spark, sf, "documents"), _read(spark, sf, "labels")
    now = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    then = docs.where("lang <> 'es'").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return A.difference(now, then, ["lang"], ["n"])


def debt_markers(spark, sf):
    words = {"idiot": "idiot", "clown": "clown", "shout": "!!"}
    return _lines(spark, sf).groupBy("lang").agg(*[F.count(F.when(F.lower("line").contains(w), 1)).alias(k) for k, w in words.items()])


def acquire_release(spark, sf):
    return L.balances(_lines(spark, sf), _BAL).select("lang", "rule_id", F.col("path").cast("long").alias("path"), "acquired", "released", "n")


def files_lacking(spark, sf):
    return L.lacking(_lines(spark, sf), _LACK).select("lang", "rule_id", F.col("path").cast("long").alias("path"))


def corpus_ratios(spark, sf):
    return L.ratios(_lines(spark, sf), _RATIO).select("lang", "rule_id", "first", "second", "n")


def files_with_pattern(spark, sf):
    return L.files_with(_lines(spark, sf), r"[0-9]{16}").select(F.col("path").cast("long").alias("path"))


def look_back(spark, sf):
    lines = _lines(spark, sf)
    near = lines.withColumn("near", L.context_has(lines, r"[0-9]{16}", 9))
    return near.where(F.col("line").rlike("[A-Z]!!")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("near"), 1)).alias("n_near"))


def before_marker(spark, sf):
    return P.before_tests(_lines(spark, sf), r"[0-9]{16}").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def behind_jump(spark, sf):
    after = Window.partitionBy("path").orderBy("line_no")
    return _lines(spark, sf).withColumn("dead", F.lag(F.col("line").rlike(r"^[A-Z]\w*\.$"), 1, False).over(after)).where("dead").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def ignored_paths(spark, sf):
    path = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    rows = _read(spark, sf, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", ignored(F.col("path"), ["en", "*.example.org", "1?"]).alias("out"))


def path_extensions(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    return _read(spark, sf, "pages").groupBy(extension(host).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def size_guard(spark, sf):
    files = _files(spark, sf)
    return files.where("n_bytes <= 4000").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")).join(P.project_megabytes(files))


def crowded_directories(spark, sf):
    rows = _read(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return P.suggested_ignores(rows, ScanConfig(ignores=("src1", "src2")), more_than=45)


def changed_files(spark, sf):
    changed = _read(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("path"))
    return P.changed_only(_files(spark, sf), changed).select(F.col("path").cast("long").alias("path"), "lang")


def unlabelled_files(spark, sf):
    return P.without(_files(spark, sf), _read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _spans(spark, sf):
    """Orders' items as matches and regions: the order is the file, the line number a line."""
    items = _read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("flag"))
    at = items.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("s_line"), F.col("q").alias("s_col"), F.col("l_linenumber").alias("e_line"), (F.col("q") + 1).alias("e_col"), "flag")
    return at.where("flag = 'A'"), at.where("flag = 'R'").withColumn("e_line", F.col("e_line") + 2)


def unguarded(spark, sf):
    matches, guards = _spans(spark, sf)
    return C.outside(matches, guards).groupBy("s_line").agg(F.count(F.lit(1)).alias("n"), F.sum("s_col").alias("cols"))


def guarded(spark, sf):
    matches, guards = _spans(spark, sf)
    return C.inside(matches, guards).groupBy("s_line").agg(F.count(F.lit(1)).alias("n"), F.sum("s_col").alias("cols"))


def _events(spark, sf):
    return _read(spark, sf, "events").select(F.col("user_id").alias("path"), F.lit("s").alias("name"), F.col("event_id").alias("off"), "event_type")


def unreleased_events(spark, sf):
    e = _events(spark, sf)
    return C.without_partner(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'")).select("path", "off")


def open_events(spark, sf):
    e = _events(spark, sf).where("event_type IN ('signup', 'purchase')").withColumn("opens", F.col("event_type") == "signup")
    return C.latest_open(e).select("path", "off")


def as_of_events(spark, sf):
    e = _read(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id")
    right = e.where("event_type = 'click'").select("user_id", "event_id", F.col("value").alias("clicked"))
    return C.as_of(left, right, ["user_id"], "event_id", "clicked")


def dependency_gaps(spark, sf):
    words = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, F.split("text", " ")))))
    rows = _read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("path")).agg(words("user").alias("used"), words("assistant").alias("declared"))
    gaps = C.dependency_gaps(rows.select("path", F.lit(1).alias("line_no"), "used", F.array(F.lit("de"), F.lit("the")).alias("local"), "declared"))
    return gaps.select("path", F.size("missing").alias("n_missing"), F.size("unused").alias("n_unused"))


def language_sets(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id")
    labels = _read(spark, sf, "labels").select("doc_id")
    size = lambda df, name: df.distinct().agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return size(docs.intersect(labels), "intersect").unionByName(size(docs.subtract(labels), "except")).unionByName(size(docs.union(labels), "union"))


def keep_first(spark, sf):
    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    return _read(spark, sf, "conversations").withColumn("k", F.row_number().over(order)).where("k = 1").select("conv_id", "role", "turn")


def match_records(spark, sf):
    rows = _read(spark, sf, "pages").select("page_id", match_record(F.concat_ws(":", "url", (F.col("page_id") % 97).cast("string"), F.lit("x: y"))).alias("m"))
    return rows.select("page_id", F.col("m.path").alias("path"), F.col("m.line_no").alias("line_no"), F.col("m.code").alias("code"))


def number_literals(spark, sf):
    tokens = F.regexp_extract_all("text", F.lit(r"([0-9][0-9_.]*)"), 1)
    rows = _read(spark, sf, "documents").select("doc_id", F.explode(tokens).alias("t"))
    return rows.select("doc_id", "t", number_literal(F.col("t")).alias("v"))


def last_metrics(spark, sf):
    rows = _read(spark, sf, "conversations").select(F.col("conv_id").alias("lang"), F.col("turn").alias("seq"), F.create_map("role", F.col("turn").cast("string")).alias("payload"))
    return A.merged_metrics(rows).select(F.col("lang").alias("conv_id"), F.col("payload")["user"].alias("last_user"), F.col("payload")["assistant"].alias("last_assistant"))


def permalinks(spark, sf):
    rows = L.occurrences(_marked(spark, sf), RULES).where("rule_id LIKE 'insult%'").select(F.col("path"), "line_no").distinct()
    return C.with_permalinks(rows, "https://host/blob/main/").select(F.col("path").cast("long").alias("path"), "line_no", "url")


def report_lines(spark, sf):
    found = step(_found(spark, sf))
    sums = step(A.summary(found, _files(spark, sf)))
    rows = sinks.jsonl(found, sums, A.totals(sums)).select("value")
    j = F.from_json("value", "type string, language string, rule_id string, count long, files long, critical long")
    return rows.select(j.alias("j")).select("j.*")


def sarif_levels(spark, sf):
    results = sinks.sarif_results(*_occurred(spark, sf))
    return results.groupBy("rule_id", F.col("result.level").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uri").alias("files"))


def masked_lengths(spark, sf):
    files = _files(spark, sf).withColumn("lang", F.lit("js")).withColumn("m", mask_column())
    return files.select(F.col("path").cast("long").alias("path"), F.length("m").alias("n_chars"), (F.length("m") - F.length(F.replace("m", F.lit("\n"), F.lit("")))).alias("n_breaks"))


def page_flows(spark, sf):
    spec = FlowSpec("page.flow", "js", 7, "warning", r"\b[0-9]+\b", r"\btrack\s*\(")
    files = table_as_files(_read(spark, sf, "pages"), "page_id", "html").withColumn("lang", F.lit("js"))
    return flows(files, [spec]).select(F.col("path").cast("long").alias("path"), "line_no", F.size("trail").alias("steps"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lines_by_lang, secrets_by_lang, rule_occurrences, rule_findings, one_pass_counts, having_threshold, first_samples, suppressed_lines, severity_rollup, category_sums, category_matrix, scanner_summary, combined_totals, severe_first,
        baseline_difference, debt_markers, acquire_release, files_lacking, corpus_ratios, files_with_pattern, look_back, before_marker, behind_jump, ignored_paths, path_extensions, size_guard, crowded_directories, changed_files, unlabelled_files,
        unguarded, guarded, unreleased_events, open_events, as_of_events, dependency_gaps, language_sets, keep_first, match_records, number_literals, last_metrics, permalinks, report_lines, sarif_levels, masked_lengths, page_flows,
    )
}

_SPANS = """WITH items AS (SELECT l_orderkey AS path, l_linenumber AS s_line, trunc(min(l_quantity))::INT AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
m AS (SELECT path, s_line, q AS s_col, s_line AS e_line, q + 1 AS e_col FROM items WHERE flag = 'A'),
g AS (SELECT path, s_line, q AS s_col, s_line + 2 AS e_line, q + 1 AS e_col FROM items WHERE flag = 'R')"""
_INSIDE = "EXISTS (SELECT 1 FROM g WHERE g.path = m.path AND (m.s_line, m.s_col) >= (g.s_line, g.s_col) AND (m.e_line, m.e_col) <= (g.e_line, g.e_col))"
_SUMMARY = "s AS (SELECT lang, count(DISTINCT path) AS files FROM (SELECT doc_id AS path, lang FROM documents) GROUP BY lang), summary AS (SELECT s.lang, s.files, " + ", ".join(f"coalesce((SELECT sum(n) FROM found f WHERE f.lang = s.lang AND severity = '{x}'), 0)::BIGINT AS {x}" for x in ("critical", "warning", "info")) + " FROM s)"

SQL: dict[str, str] = {
    "lines_by_lang": f"{_PLAIN} SELECT lang, count(*) AS n_lines, count(DISTINCT path) AS n_files, max(line_no) AS longest, sum(length(line))::BIGINT AS n_chars FROM lines GROUP BY lang",
    "secrets_by_lang": f"{_ALL} SELECT lang, severity, n FROM found WHERE rule_id LIKE 'secret%'",
    "rule_occurrences": f"{_HITS} SELECT lang, category, rule_id, path::BIGINT AS path, line_no, length(code) AS n_chars, suppressed FROM hits",
    "rule_findings": f"{_ALL} SELECT lang, category, rule_id, severity, n FROM found",
    "one_pass_counts": f"{_HITS}, r AS (SELECT * FROM (VALUES {', '.join(f'({_text(r.lang)}, {_text(r.rule_id)})' for r in RULES)}) AS t(lang, rule_id)) SELECT r.lang, r.rule_id, count(h.rule_id) AS n FROM r LEFT JOIN hits h USING (rule_id) GROUP BY r.lang, r.rule_id",
    "having_threshold": f"{_HITS} SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id HAVING count(*) > 25",
    "first_samples": f"{_HITS} SELECT rule_id, k, file, line FROM (SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY path, line_no, code) - 1 AS k, path AS file, line_no AS line FROM hits WHERE NOT suppressed) WHERE k < 3",
    "suppressed_lines": f"{_PLAIN} SELECT lang, count(*) FILTER (suppressed) AS hidden, count(*) AS n FROM marked GROUP BY lang",
    "severity_rollup": f"{_ALL} SELECT lang, severity, sum(n)::BIGINT AS n FROM found WHERE severity <> 'good' GROUP BY ROLLUP (lang, severity)",
    "category_sums": f"{_ALL} SELECT lang, category, sum(n)::BIGINT AS n FROM found WHERE severity <> 'good' GROUP BY lang, category",
    "category_matrix": f"{_ALL} SELECT lang, category, critical, warning, info, critical + warning + info AS total FROM (SELECT l.lang, c.category, " + ", ".join(f"coalesce((SELECT sum(n) FROM found f WHERE f.lang = l.lang AND f.category = c.category AND severity = '{x}'), 0)::BIGINT AS {x}" for x in ("critical", "warning", "info")) + f" FROM (VALUES {', '.join(f'({_text(x)})' for x in LANGS)}) AS l(lang), (VALUES (1), (2), (3), (4)) AS c(category))",
    "scanner_summary": f"{_ALL}, {_SUMMARY} SELECT * FROM summary",
    "combined_totals": f"{_ALL}, {_SUMMARY} SELECT sum(files)::BIGINT AS files, sum(critical)::BIGINT AS critical, sum(warning)::BIGINT AS warning, sum(info)::BIGINT AS info FROM summary",
    "severe_first": f"{_ALL} SELECT rule_id, severity, n FROM found WHERE severity IN ('critical', 'warning') ORDER BY severity <> 'critical', n DESC, rule_id LIMIT 5",
    "baseline_difference": "WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM documents WHERE lang <> 'es' AND doc_id IN (SELECT doc_id FROM labels) GROUP BY lang) SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS n_baseline, coalesce(a.n, 0) - coalesce(b.n, 0) AS n_delta FROM a FULL JOIN b ON a.lang = b.lang",
    "debt_markers": f"{_PLAIN} SELECT lang, count(*) FILTER (contains(lower(line), 'idiot')) AS idiot, count(*) FILTER (contains(lower(line), 'clown')) AS clown, count(*) FILTER (contains(lower(line), '!!')) AS shout FROM lines GROUP BY lang",
    "acquire_release": f"{_PLAIN} SELECT lang, 'open.' || lang AS rule_id, path::BIGINT AS path, a AS acquired, r AS released, a - r AS n FROM (SELECT lang, path, count(*) FILTER (regexp_matches(line, '[(,]')) AS a, count(*) FILTER (regexp_matches(line, '[.)]')) AS r FROM lines GROUP BY lang, path) WHERE a > r",
    "files_lacking": f"{_PLAIN} SELECT lang, 'lack.' || lang AS rule_id, path::BIGINT AS path FROM lines GROUP BY lang, path HAVING bool_or(regexp_matches(line, '[0-9]{{16}}')) AND NOT bool_or(regexp_matches(line, '[A-Z]!!'))",
    "corpus_ratios": f"{_PLAIN} SELECT lang, 'ratio.' || lang AS rule_id, a AS first, b AS second, a - b AS n FROM (SELECT lang, count(*) FILTER (contains(line, ',')) AS a, count(*) FILTER (regexp_matches(line, '[0-9]')) AS b FROM lines GROUP BY lang) WHERE a > b",
    "files_with_pattern": f"{_PLAIN} SELECT DISTINCT path::BIGINT AS path FROM lines WHERE regexp_matches(line, '[0-9]{{16}}')",
    "look_back": f"{_PLAIN} SELECT lang, count(*) AS n, count(*) FILTER (near) AS n_near FROM (SELECT lang, line, bool_or(regexp_matches(line, '[0-9]{{16}}')) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS near FROM lines) WHERE regexp_matches(line, '[A-Z]!!') GROUP BY lang",
    "before_marker": f"{_PLAIN} SELECT lang, count(*) AS n FROM (SELECT *, min(CASE WHEN regexp_matches(line, '[0-9]{{16}}') THEN line_no END) OVER (PARTITION BY path) AS f FROM lines) WHERE f IS NULL OR line_no < f GROUP BY lang",
    "behind_jump": f"{_PLAIN} SELECT lang, count(*) AS n FROM (SELECT lang, lag(regexp_matches(line, '^[A-Z]\\w*\\.$')) OVER (PARTITION BY path ORDER BY line_no) AS dead FROM lines) WHERE dead GROUP BY lang",
    "ignored_paths": r"WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages) SELECT page_id, regexp_matches(path, '^(en|.*\.example\.org|1.)$') OR len([x FOR x IN string_split(path, '/') IF regexp_matches(x, '^(en|.*\.example\.org|1.)$')]) > 0 AS out FROM p",
    "path_extensions": r"SELECT lower(regexp_extract(regexp_extract(url, '^https?://([^/?#]*)', 1), '\.([^.]*)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1",
    "size_guard": "SELECT count(*) FILTER (strlen(text) <= 4000) AS n, (sum(strlen(text)) FILTER (strlen(text) <= 4000))::BIGINT AS bytes, (sum(strlen(text)) // 1048576)::BIGINT AS megabytes FROM documents",
    "crowded_directories": "SELECT source AS top_dir, count(*) AS n_files FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source HAVING count(*) > 45",
    "changed_files": "SELECT doc_id AS path, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "unlabelled_files": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY lang",
    "unguarded": f"{_SPANS} SELECT s_line, count(*) AS n, sum(s_col)::BIGINT AS cols FROM m WHERE NOT {_INSIDE} GROUP BY s_line",
    "guarded": f"{_SPANS} SELECT s_line, count(*) AS n, sum(s_col)::BIGINT AS cols FROM m WHERE {_INSIDE} GROUP BY s_line",
    "unreleased_events": "SELECT user_id AS path, event_id AS off FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.event_id > a.event_id)",
    "open_events": """WITH e AS (SELECT user_id AS path, event_id AS off, event_type = 'signup' AS opens FROM events WHERE event_type IN ('signup', 'purchase')),
a AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w AS total FROM e WINDOW w AS (PARTITION BY path ORDER BY off)),
b AS (SELECT *, total - least(min(total) OVER (PARTITION BY path ORDER BY off), 0) AS level FROM a),
c AS (SELECT *, min(level) OVER (PARTITION BY path ORDER BY off ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM b)
SELECT path, off FROM c WHERE opens AND (later IS NULL OR later >= level)""",
    "as_of_events": "SELECT l.user_id, l.event_id, r.value AS clicked FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.event_id >= r.event_id",
    "dependency_gaps": """WITH w AS (SELECT DISTINCT conv_id, role, unnest(string_split(text, ' ')) AS x FROM conversations),
u AS (SELECT conv_id, x FROM w WHERE role = 'user'), d AS (SELECT conv_id, x FROM w WHERE role = 'assistant')
SELECT c.conv_id AS path, (SELECT count(*) FROM u WHERE u.conv_id = c.conv_id AND x NOT IN ('de', 'the') AND NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = u.conv_id AND d.x = u.x)) AS n_missing,
  (SELECT count(*) FROM d WHERE d.conv_id = c.conv_id AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = d.conv_id AND u.x = d.x AND u.x NOT IN ('de', 'the'))) AS n_unused
FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "language_sets": "SELECT 'intersect' AS op, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)",
    "keep_first": "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role",
    "match_records": "SELECT page_id, url AS path, (page_id % 97)::INT AS line_no, 'x: y' AS code FROM pages",
    "number_literals": "SELECT doc_id, t, TRY_CAST(CASE WHEN regexp_matches(replace(t, '_', ''), '^[0-9]*\\.?[0-9]+$') THEN replace(t, '_', '') END AS DOUBLE) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9][0-9_.]*)', 1)) AS t FROM documents)",
    "last_metrics": "SELECT conv_id, max(turn) FILTER (role = 'user')::VARCHAR AS last_user, max(turn) FILTER (role = 'assistant')::VARCHAR AS last_assistant FROM conversations GROUP BY conv_id",
    "permalinks": f"{_HITS} SELECT DISTINCT path::BIGINT AS path, line_no, 'https://host/blob/main/' || path || '#L' || line_no AS url FROM hits WHERE rule_id LIKE 'insult%'",
    "report_lines": f"{_ALL}, {_SUMMARY} SELECT 'finding' AS type, lang AS language, rule_id, n AS count, NULL::BIGINT AS files, NULL::BIGINT AS critical FROM found WHERE severity <> 'good' UNION ALL SELECT 'scanner', lang, NULL, NULL, files, critical FROM summary UNION ALL SELECT 'totals', NULL, NULL, NULL, sum(files)::BIGINT, sum(critical)::BIGINT FROM summary",
    "page_flows": r"WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1)::INTEGER AS line_no FROM pages) SELECT page_id AS path, line_no, 2 AS steps FROM l WHERE regexp_matches(line, '\btrack\s*\([^)]*\b[0-9]+\b')",
    "sarif_levels": f"{_ALL} SELECT h.rule_id, CASE f.severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, count(*) AS n, count(DISTINCT h.path) AS files FROM hits h JOIN found f ON f.rule_id = h.rule_id AND f.severity <> 'good' WHERE NOT h.suppressed GROUP BY 1, 2",
    "masked_lengths": "SELECT doc_id AS path, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) AS n_breaks FROM documents",
}

"""What a scan leaves: reports for people and for programs."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import rank, sarif_level
from ..schemas import FINDINGS

VERSION = "1.0.0"


def jsonl(findings: DataFrame, summary: DataFrame, totals: DataFrame, summary_only: bool = False) -> DataFrame:
    """Rows of a JSON Lines report: findings, then scanners, then totals; each with its type, nulls left out."""
    parts = [] if summary_only else [findings.where("severity <> 'good'").select(F.lit(0).alias("_k"), F.lit("finding").alias("type"), F.col("lang").alias("language"), "category", "rule_id", "severity", F.col("n").alias("count"), "title", "description", "samples")]
    parts.append(summary.select(F.lit(1).alias("_k"), F.lit("scanner").alias("type"), F.col("lang").alias("language"), "files", "critical", "warning", "info"))
    parts.append(totals.select(F.lit(2).alias("_k"), F.lit("totals").alias("type"), "files", "critical", "warning", "info"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    columns = [c for c in out.columns if c != "_k"]
    return out.select("_k", "language", F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("value"), *(["severity", "count", "rule_id"] if "rule_id" in columns else []))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Write a jsonl() result in its order."""
    order = ["_k", *([rank(F.col("severity")), F.desc("count"), "rule_id"] if "rule_id" in rows.columns else []), "language"]
    rows.orderBy(*order).select("value").write.mode("overwrite").text(path)


def combined(findings: DataFrame, summary: DataFrame, totals: DataFrame, project: str, timestamp: str) -> DataFrame:
    """One row, value: the combined report as JSON, findings attached to their language."""
    # A finding is a row of the catalogue, so these lists are as long as the catalogue, not the corpus.
    listed = findings.where("severity <> 'good'").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(rank(F.col("severity")).alias("rank"), (-F.col("n")).alias("order"), "rule_id", "category", "severity", F.col("n").alias("count"), "title", "description", "samples"))).alias("findings"))
    plain = F.transform("findings", lambda f: F.struct(*[f[c].alias(c) for c in ("rule_id", "category", "severity", "count", "title", "description", "samples")]))
    scanners = summary.join(listed, "lang", "left").select(F.struct(F.col("lang").alias("language"), F.lit(project).alias("project"), "files", "critical", "warning", "info", F.lit(timestamp).alias("timestamp"), plain.alias("findings")).alias("s"))
    all_ = scanners.agg(F.sort_array(F.collect_list("s")).alias("scanners"))
    both = totals.select(F.struct("critical", "warning", "info", "files").alias("totals")).withColumn("k", F.lit(0)).join(all_.withColumn("k", F.lit(0)), "k")
    return both.select(F.to_json(F.struct(F.lit(project).alias("project"), F.lit(timestamp).alias("timestamp"), "scanners", "totals")).alias("value"))


def module_reports(findings: DataFrame, summary: DataFrame, timestamp: str) -> DataFrame:
    """``(language, value)``: a JSON report for each scanner, its counts and its findings, for ``write.partitionBy("language").text``."""
    listed = findings.where("severity <> 'good'").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rule_id", "category", "severity", F.col("n").alias("count"), "title"))).alias("findings"))
    both = summary.join(listed, "lang", "left")
    return both.select(F.col("lang").alias("language"), F.to_json(F.struct(F.col("lang").alias("language"), "files", "critical", "warning", "info", F.lit(timestamp).alias("timestamp"), F.coalesce("findings", F.array().cast("array<struct<rule_id:string,category:int,severity:string,count:bigint,title:string>>")).alias("findings"))).alias("value"))


def shareable(report: DataFrame, difference: DataFrame, generated_at: str, git: dict[str, str | None], baseline: str | None) -> DataFrame:
    """One row, value: the combined report with where it comes from and its difference to a baseline."""
    measures = ("critical", "warning", "info", "files")
    delta = difference.select(F.lit(0).alias("k"), F.struct(F.lit(baseline).alias("baseline_path"), F.struct(*[F.col(f"{m}_delta").alias(m) for m in measures]).alias("delta"), F.struct(*[F.col(f"{m}_baseline").alias(m) for m in measures]).alias("baseline_totals")).alias("comparison"))
    more = F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.struct(*[F.lit(v).alias(k) for k, v in git.items()]).alias("git"), "comparison"))
    both = report.select(F.lit(0).alias("k"), "value").join(delta, "k")
    return both.withColumn("x", more).select(F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.lit(","), F.expr("substring(x, 2)")).alias("value"))


def sarif(occurrences: DataFrame, findings: DataFrame, automation: str | None = None, repository: str | None = None, revision: str | None = None) -> DataFrame:
    """One row per language, value: a SARIF run of its unsuppressed occurrences.

    A run is one JSON document and so is built in one task; ``sarif_results`` has the results as rows for
    corpora whose report would be too large for one.
    """
    results = sarif_results(occurrences, findings)
    runs = results.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("uri", "line", "rule_id", "result"))).alias("r"))
    more = []
    if automation:
        more.append(F.struct(F.lit(automation).alias("id")).alias("automationDetails"))
    if repository:
        more.append(F.array(F.struct(F.lit(repository).alias("repositoryUri"), F.lit(revision).alias("revisionId"))).alias("versionControlProvenance"))
    tool = F.struct(F.struct(F.concat(F.lit("textloom-"), F.col("lang")).alias("name"), F.lit(VERSION).alias("version")).alias("driver")).alias("tool")
    run = F.struct(tool, F.transform("r", lambda x: x["result"]).alias("results"), *more)
    return runs.select("lang", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def sarif_results(occurrences: DataFrame, findings: DataFrame) -> DataFrame:
    """``(lang, uri, line, rule_id, result)``: a SARIF result for each unsuppressed occurrence of a rule that is not good."""
    rows = occurrences.where("NOT suppressed") if "suppressed" in occurrences.columns else occurrences
    named = rows.select("lang", "rule_id", "path", "line_no", "code").join(F.broadcast(findings.where("severity <> 'good'").select("rule_id", "severity", "title")), "rule_id")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line_no", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.concat_ws(" - ", "title", F.trim("code")).alias("text")).alias("message"), F.array(place).alias("locations"))
    return named.select("lang", F.col("path").alias("uri"), F.col("line_no").alias("line"), "rule_id", result.alias("result"))


def write_sarif(occurrences: DataFrame, findings: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Write a SARIF log below ``path`` in parts: ``log`` holds a run for each language, which names the files of its results in ``results``.

    A results file is an external property file of the format with ``per_file`` results at most, so no row and no task holds a
    language. Results are in the order of file and line, over all files. ``log`` has a reference for each file of results.
    """
    spark = occurrences.sparkSession
    results = sarif_results(occurrences, findings).repartitionByRange("lang", "uri", "line", "rule_id").sortWithinPartitions("lang", "uri", "line", "rule_id")
    part = F.floor(F.monotonically_increasing_id() / per_file)  # some of a partition's rows, in their order
    numbered = results.select("lang", part.alias("part"), F.struct("uri", "line", "rule_id", "result").alias("r"))
    files = numbered.groupBy("lang", "part").agg(F.sort_array(F.collect_list("r")).alias("r"))
    guid = F.regexp_replace(F.md5(F.concat_ws("/", "lang", F.col("part").cast("string")).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    document = F.to_json(F.struct(F.lit("2.1.0").alias("version"), guid.alias("guid"), F.struct(F.col("lang").alias("language")).alias("properties"), F.transform("r", lambda x: x["result"]).alias("results")))
    # A row is a whole file of results; each goes to a file of its own.
    files.select(document.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/results")
    written = spark.read.text(f"{path}/results", wholetext=True)
    where = F.concat(F.lit("results/"), F.element_at(F.split(F.input_file_name(), "/"), -1))
    found = written.select(F.get_json_object("value", "$.properties.language").alias("lang"), where.alias("uri"), F.get_json_object("value", "$.guid").alias("guid"), F.size(F.from_json(F.get_json_object("value", "$.results"), "array<string>")).alias("n"))
    reference = F.struct(F.struct("uri").alias("location"), "guid", F.col("n").alias("itemCount"))
    runs = found.groupBy("lang").agg(F.array_sort(F.collect_list(reference)).alias("files"))
    tool = F.struct(F.struct(F.concat(F.lit("textloom-"), F.col("lang")).alias("name"), F.lit(VERSION).alias("version")).alias("driver")).alias("tool")
    run = F.struct(tool, F.struct(F.col("files").alias("results")).alias("externalPropertyFileReferences"))
    log = runs.agg(F.array_sort(F.collect_list(F.struct("lang", run.alias("run")))).alias("all"))
    log.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.transform("all", lambda x: x["run"]).alias("runs"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/log")


def merged_sarif(documents: DataFrame, value: str = "value") -> DataFrame:
    """One row, value: a document with the runs of all valid ``documents``; invalid ones are skipped."""
    runs = documents.select(F.get_json_object(value, "$.runs").alias("r")).where("r IS NOT NULL AND startswith(r, '[') AND r <> '[]'")
    inner = runs.agg(F.array_join(F.sort_array(F.collect_list(F.expr("substring(r, 2, length(r) - 2)"))), ",").alias("all"))
    return inner.select(F.concat(F.lit('{"version":"2.1.0","runs":['), "all", F.lit("]}")).alias("value"))


def matrix_csv(matrix: DataFrame, path: str) -> None:
    """Write a category matrix as CSV with a header."""
    matrix.orderBy("lang", "category").write.mode("overwrite").option("header", True).csv(path)


def markdown(matrix: DataFrame) -> str:
    """A category matrix, which is as large as the catalogue, as a Markdown table."""
    head = ["lang", "category", "total", "critical", "warning", "info"]
    rows = matrix.orderBy("lang", "category").select(head).collect()
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(x) for x in r) + " |" for r in rows)]) + "\n"


def text(findings: DataFrame, summary: DataFrame, totals: DataFrame, project: str, most: int = 250) -> str:
    """A report to read: findings with samples by language, worst first, then the totals; catalogue-sized rows are collected.

    Findings beyond ``most`` are not shown, and the report says how many these are.
    """
    out = [f"Project: {project}"]
    bad = findings.where("severity <> 'good'")
    shown = bad.orderBy("lang", rank(F.col("severity")), F.desc("n"), "rule_id").limit(most).collect()
    left = bad.count() - len(shown) if len(shown) == most else 0
    for r in shown:
        out.append(f"[{r['severity']}] {r['lang']} {r['rule_id']} ({r['n']}): {r['title']}. {r['description']}")
        out += [f"    {s['file']}:{s['line']}: {(s['code'] or '').strip()[:160]}" for s in r["samples"]]
    out += [f"{left} further findings are not shown"] * (left > 0)
    out += [f"{r['lang']}: {r['files']} files, {r['critical']} critical, {r['warning']} warning, {r['info']} info" for r in summary.orderBy("lang").collect()]
    t = totals.first()
    return "\n".join([*out, "Combined totals", f"Files: {t['files']}", f"Critical: {t['critical']}", f"Warning: {t['warning']}", f"Info: {t['info']}", ""])


def html(summary: DataFrame, difference: DataFrame, project: str) -> str:
    """A page with the totals against a baseline and a row per language."""
    d = difference.first()
    rows = "".join(f"<tr><td>{m}</td><td>{d[m]}</td><td>{d[f'{m}_baseline']}</td><td>{d[f'{m}_delta']:+d}</td></tr>" for m in ("critical", "warning", "info"))
    langs = "".join(f"<tr><td>{escape(str(r['lang']))}</td><td>{r['files']}</td><td>{r['critical']}</td><td>{r['warning']}</td><td>{r['info']}</td></tr>" for r in summary.orderBy("lang").collect())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(project)}</title></head><body><h1>{escape(project)}</h1><table><tr><th></th><th>now</th><th>baseline</th><th>change</th></tr>{rows}</table><table><tr><th>language</th><th>files</th><th>critical</th><th>warning</th><th>info</th></tr>{langs}</table></body></html>"


def toon(findings: DataFrame, totals: DataFrame) -> str:
    """A compact encoding: a header with the fields, then a line for each finding."""
    fields = ("lang", "rule_id", "severity", "n", "title")
    rows = findings.where("severity <> 'good'").orderBy(rank(F.col("severity")), F.desc("n"), "rule_id").select(*fields).collect()
    quote = lambda x: f'"{x}"' if isinstance(x, str) and ("," in x or '"' in x) else str(x)
    t = totals.first()
    return "\n".join([f"findings[{len(rows)}]{{{','.join(fields)}}}:", *("  " + ",".join(quote(x) for x in r) for r in rows), "totals:", *(f"  {m}: {t[m]}" for m in ("files", "critical", "warning", "info"))]) + "\n"


def findings_schema():
    """Schema that a findings file is read back with."""
    return FINDINGS

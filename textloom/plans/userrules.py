"""A user's syntax rules from YAML: patterns with holes, kinds and relations of syntax nodes, all rules in one structural join.

A file holds one rule a document: id, language, message, note, severity (error, warning, info, hint) and rule.
A rule is made of ``pattern``, ``regex``, ``kind`` and ``any`` of these, which say what a node is; ``has`` and ``inside``, which say what lies
in it or around it at any depth; ``not``, which turns any of them round; and ``all``, which puts several together.
``$X`` stands for one part without a comma of its own, ``$$$`` for any, a hole's second mention for the same text again.
Other keys raise, but for stopBy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import language
from ..functions.syntax import HEADS, MARKED, MARKS, SIGNS, syntax_nodes, tokens
from ..operators.structural import AROUND, WITHIN, labelled, structural_filter
from ..sources.steps import step
from .catalogue import Rule

#: Other tools' names of syntax nodes as they are called here; fixed values.
NODE_KINDS = {
    "for_statement": "loop", "while_statement": "loop", "do_statement": "loop", "for_in_statement": "loop", "for_expression": "loop", "while_expression": "loop", "loop_expression": "loop", "foreach_statement": "loop", "enhanced_for_statement": "loop",
    "function_declaration": "function", "function_definition": "function", "function_item": "function", "method_definition": "function", "method_declaration": "function", "arrow_function": "closure", "closure_expression": "closure", "lambda": "closure", "lambda_expression": "closure", "func_literal": "closure",
    "if_statement": "if", "if_expression": "if", "try_statement": "try", "try_expression": "try", "catch_clause": "catch", "except_clause": "catch", "finally_clause": "finally", "with_statement": "with", "with_item": "with", "using_statement": "with", "class_definition": "class", "class_declaration": "class", "impl_item": "class", "async_block": "async", "unsafe_block": "unsafe",
    "call_expression": "call", "method_invocation": "call", "invocation_expression": "call", "new_expression": "new", "object_creation_expression": "new", "await_expression": "await", "return_statement": "return", "throw_statement": "throw", "raise_statement": "throw", "defer_statement": "defer", "expression_statement": "statement",
    "assignment_expression": "assignment", "assignment_statement": "assignment", "conditional_expression": "ternary", "ternary_expression": "ternary", "switch_statement": "switch", "switch_expression": "switch", "match_expression": "switch", "object": "object",
}
KINDS = frozenset(HEADS.values()) | frozenset("file statement closure block object call new await assignment condition and ternary".split())
#: Kinds whose code is all that stands in a statement, apart from blocks.
STATEMENTS = tuple(sorted(KINDS - frozenset("file async closure block object call new await assignment condition and ternary".split())))
_SEVERITY = {"error": "critical", "warning": "warning", "info": "info", "hint": "info"}
_HOLE = re.compile(r"\$(\$\$)?([A-Za-z_]\w*)?")


@dataclass(frozen=True)
class Test:
    """What a node is: of one of ``kinds`` (any if empty), its code matched by ``pattern`` (tokens with a blank behind each) or by a user's ``regex``."""

    kinds: tuple[str, ...] = ()
    pattern: str | None = None
    regex: str | None = None

    def column(self) -> Column:
        out = F.col("kind").isin(*self.kinds) if self.kinds else F.lit(True)
        if self.pattern is not None:
            out &= F.col("_ended").rlike(self.pattern)
        if self.regex is not None:
            # As it is usually written, and with all blanks.
            out &= F.col("_plain").rlike(self.regex) | F.col("_text").rlike(self.regex)
        return out


@dataclass
class SyntaxRule:
    """What a YAML rule says: tests of the node itself, any of each group, and of what is in or around it; the flag is False for ``not``."""

    rule: Rule
    itself: list[tuple[tuple[Test, ...], bool]] = field(default_factory=list)
    related: list[tuple[tuple[Test, ...], str, bool]] = field(default_factory=list)


def pattern_test(pattern: str, lang: str) -> Test:
    """A pattern of code as a test of nodes.

    Calls, assignments, ``new`` and ``await`` are matched as whole nodes; a pattern that begins as a statement does is matched from its
    beginning; what is left, such as a name or a comparison, anywhere in the code of a statement.
    """
    words = [t.text.translate(MARKED) if t.kind == "s" else t.text for t in tokens(pattern.strip(), lang)]
    if not words:
        raise ValueError("an empty pattern")
    head = words.index("{") if "{" in words else len(words)
    if words[0] in HEADS and (words[0] not in ("init", "match", "record", "select", "when", "open") or head < len(words)):
        return Test((HEADS[words[0]],), r"^(?:.* )?" + _regex(words[:head], None))
    if any(re.fullmatch(r"(?::|[+*/%&|^-])?=", w) for w in words):
        return Test(("assignment",), rf"^(?:.* )?{_regex(words, None, commas=False)}$")
    if words[0] == "await":
        return Test(("await",), rf"^{_regex(words, None)}$")
    if words[-1] == ")" and "(" in words and words[0] != "(":
        depth = 0
        for own in range(len(words) - 1, -1, -1):  # the bracket that the last one closes
            depth += (words[own] == ")") - (words[own] == "(")
            if not depth:
                break
        return Test(("new" if words[0] == "new" else "call",), rf"^{_regex(words, own)}$")
    return Test((), rf"(?:^| ){_regex(words, None)}")


def _regex(words: list[str], own: int | None, commas: bool = True) -> str:
    """Tokens and holes as a regular expression over a node's code; ``own`` is where the brackets begin that are the node's own."""
    out, depth = [], 0
    seen: set[str] = set()
    for k, word in enumerate(words):
        hole = _HOLE.fullmatch(word)
        if hole is not None:
            name = re.sub(r"\W|_", "", hole[2] or "")
            if hole[1]:
                out.append(r"(?:[^()]* )?")
            elif name in seen:
                out.append(rf"\k<{name}> ")
            else:
                out.append(rf"(?<{name}>[^,()]+) " if name else r"[^,()]+ ")
                seen |= {name} - {""}
            continue
        if word in (")", "]", "}"):
            depth -= 1
        mine = own is not None and (k == own or k == len(words) - 1)
        plain = mine or word == "," and (commas and depth == 0 or own is not None and k > own and depth == 1)
        out.append(re.escape(word if plain else word.translate(MARKED)) + " ")
        if word in ("(", "[", "{"):
            depth += 1
    return "".join(out)


def _leaf(spec: dict, where: str, lang: str) -> tuple[Test, ...]:
    """The tests of which a node has to pass one."""
    known = {"any", "pattern", "regex", "kind", "stopBy"}
    if not isinstance(spec, dict) or set(spec) - known or not set(spec) & (known - {"stopBy"}):
        raise ValueError(f"{where}: one of any, kind, pattern and regex is missing, or something else is there")
    if "any" in spec:
        if set(spec) - {"any", "stopBy"}:
            raise ValueError(f"{where}: any stands beside other tests")
        return tuple(t for x in spec["any"] for t in _leaf(x, where, lang))
    kind = spec.get("kind")
    if kind is not None and NODE_KINDS.get(kind, kind) not in KINDS:
        raise ValueError(f"{where}: kind {kind!r} is unknown")
    found = pattern_test(spec["pattern"], lang) if "pattern" in spec else Test()
    if "regex" in spec:
        re.compile(spec["regex"])
    return (Test((NODE_KINDS.get(kind, kind),) if kind else found.kinds, found.pattern, spec.get("regex")),)


def _read(rule: SyntaxRule, spec: dict, where: str, wanted: bool = True) -> None:
    lang = rule.rule.lang
    itself = {k: v for k, v in spec.items() if k in ("any", "kind", "pattern", "regex")}
    parts = [{"any": itself["any"]}] if "any" in itself else []
    parts += [rest] if (rest := {k: v for k, v in itself.items() if k != "any"}) else []
    if len(parts) > 1 and not wanted:
        raise ValueError(f"{where}: not cannot hold any beside other tests of a node")
    for part in parts:
        rule.itself.append((_leaf(part, where, lang), wanted))
    for key, value in spec.items():
        if key in ("has", "inside"):
            if not isinstance(value, dict) or not set(value) & {"any", "kind", "pattern", "regex"}:
                raise ValueError(f"{where}: {key} names nothing")
            rule.related.append((_leaf(value, where, lang), WITHIN if key == "has" else AROUND, wanted))
        elif key == "all" and wanted:
            for part in value:
                _read(rule, part, where)
        elif key == "not" and wanted:
            _read(rule, value, where, False)
        elif key not in itself and key != "stopBy":
            raise ValueError(f"{where}: {key!r} is not supported" + ("" if wanted else " in not"))


def syntax_rule(document: dict) -> SyntaxRule:
    """A rule from one parsed YAML document."""
    where = str(document.get("id") or "a rule without an id")
    missing = [k for k in ("id", "language", "rule") if not document.get(k)]
    if missing:
        raise ValueError(f"{where}: {', '.join(missing)} is missing")
    severity = _SEVERITY.get(document.get("severity", "warning"))
    if severity is None:
        raise ValueError(f"{where}: severity {document['severity']!r} is unknown")
    rule = SyntaxRule(Rule(document["id"], language(document["language"]), int(document.get("category", 0)), "syntax", "", "", ((0, severity),), document.get("message", document["id"]), document.get("note") or ""))
    _read(rule, document["rule"], where)
    if not any(wanted for _, wanted in rule.itself):
        raise ValueError(f"{where}: nothing says what is looked for")
    return rule


def read_syntax_rules(spark: SparkSession, path: str) -> list[SyntaxRule]:
    """The rules of a YAML file or of all YAML files in a directory, by id; catalogue-sized, so the driver reads them."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("rules in YAML need PyYAML; JSON lines can be read without it") from e
    texts = [r["value"] for r in spark.read.option("pathGlobFilter", "*.y*ml").text(path, wholetext=True).collect()]
    found = [syntax_rule(d) for t in texts for d in yaml.safe_load_all(t) if d]
    return sorted(found, key=lambda r: r.rule.rule_id)


def _either(tests: tuple[Test, ...]) -> Column:
    return reduce(lambda a, b: a | b, (t.column() for t in tests))


def _itself(rule: SyntaxRule) -> Column:
    """The condition on a node alone. Unless a test names kinds, a rule is about statements, so that each place is found once."""
    out = F.lit(True)
    if not any(t.kinds for tests, wanted in rule.itself if wanted for t in tests):
        out &= F.col("kind").isin(*STATEMENTS)
    for tests, wanted in rule.itself:
        out &= _either(tests) if wanted else ~_either(tests)
    return out


def match_nodes(nodes: DataFrame, rules: list[SyntaxRule]) -> DataFrame:
    """Nodes that fulfil a rule, with rule_id: every test is an expression over NODES, every relation a part of one structural join."""
    spark = nodes.sparkSession
    # The forms of the code that tests look at are made once a node.
    nodes = nodes.withColumn("_text", F.translate("code", MARKS, SIGNS)).withColumn("_ended", F.concat("code", F.lit(" ")))
    nodes = nodes.withColumn("_plain", F.regexp_replace("_text", r"(?<!\w) | (?!\w)", ""))
    labels: dict[tuple, int] = {}
    wants = []
    for k, r in enumerate(rules):
        for tests, axis, wanted in r.related:
            wants.append((k, labels.setdefault((r.rule.lang, tests), len(labels)), axis, wanted))
    hits = labelled(nodes, {k: (r.rule.lang, _itself(r)) for k, r in enumerate(rules)}, "rule")
    # What a node has may be in its own code, where names and the like are no nodes.
    own = reduce(lambda a, b: a & b, [F.when(F.col("rule") == k, _either(tests) == wanted).otherwise(True) for k, r in enumerate(rules) for tests, axis, wanted in r.related if axis == WITHIN and not wanted], F.lit(True))
    if wants:
        marks = labelled(nodes, {n: (lang, _either(tests)) for (lang, tests), n in labels.items()}, "label").select("path", "label", "pre", "post")
        hits = structural_filter(hits.where(own), marks, spark.createDataFrame(wants, "rule int, label int, axis string, wanted boolean"))
    names = F.array(*[F.lit(r.rule.rule_id) for r in rules])
    return hits.withColumn("rule_id", names[F.col("rule")]).drop("rule", "_text", "_ended", "_plain")


def syntax_rule_matches(files: DataFrame, rules: list[SyntaxRule], some: dict[str, str] | None = None) -> DataFrame:
    """``(rule_id, path, s_line, s_col, e_line, e_col, code)`` of the rules in ``files(path, lang, text)``.

    The files are parsed once, whatever the number of rules: nodes are written, and all else is joins of them. Texts of a language in
    which its pattern of ``some`` is not found are not parsed.
    """
    langs = sorted({r.rule.lang for r in rules})
    kept = reduce(lambda a, b: a | b, [(F.col("lang") == lang) & (F.col("text").rlike((some or {})[lang]) if lang in (some or {}) else F.lit(True)) for lang in langs])
    nodes = step(syntax_nodes(files.where(kept)))
    return match_nodes(nodes, rules).select("rule_id", "path", "s_line", "s_col", "e_line", "e_col", F.translate("code", MARKS, SIGNS).alias("code"))

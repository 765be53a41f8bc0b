"""Column functions over paths, lines and texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: POSIX classes, which Java's regular expressions read otherwise; fixed values.
_POSIX = {"space": r"\s", "blank": r" \t", "digit": "0-9", "alpha": "A-Za-z", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "word": r"\w", "xdigit": "0-9A-Fa-f", "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}"}
LINE_BREAK = r"\r\n|\n|\r"


def java_regex(pattern: str) -> str:
    """A pattern with POSIX classes in brackets as Java reads it."""
    return re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]], pattern)


def literal_of(pattern: str) -> str:
    """The longest text that stands in every match of a pattern, as far as it can be told without groups and classes; empty for none."""
    if "(?i" in pattern:
        return ""
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        plain = None
        if c == "\\":
            c, k = pattern[k], k + 1
            plain = c if not c.isalnum() else None
        elif c == "[":
            k = pattern.index("]", k + 1 + (pattern[k] == "^")) + 1
            while pattern[k - 2 : k] == ":]" and "]" in pattern[k:]:  # the end of a POSIX class, not of the brackets
                k = pattern.index("]", k) + 1
        elif c == "|" and not depth:
            return ""
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in ".^$|*+?{}":
            plain = c
        if c == "{" and plain is None:
            k = pattern.find("}", k) + 1 or len(pattern)
        if plain is not None and not depth and pattern[k : k + 1] not in ("*", "?", "{"):
            run += plain
            if pattern[k : k + 1] == "+":
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
    return max([*runs, run], key=len)


def texts_of(pattern: str) -> frozenset[str]:
    """ASCII texts in lower case, one of which stands in every match of a pattern, in any case; empty if none can be told."""
    pattern = java_regex(pattern)
    if re.search(r"\[\^?(?:\\.|[^\]\\])*\[", pattern):  # Java's classes nest, Python's do not
        return frozenset()
    try:
        found = _needed(re._parser.parse(pattern))
    except re.error:
        return frozenset()
    return found if found and min(map(len, found)) > 1 else frozenset()


def _needed(items) -> frozenset[str]:
    """The set with the longest shortest text among those of a sequence's parts."""
    sets, run = [], ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        sets.append(frozenset([run]) if run else frozenset())
        run = ""
        if name == "SUBPATTERN":
            sets.append(_needed(value[3]))
        elif name == "BRANCH":
            parts = [_needed(x) for x in value[1]]
            sets.append(frozenset().union(*parts) if all(parts) else frozenset())
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            sets.append(_needed(value[2]))
    sets.append(frozenset([run]) if run else frozenset())
    return max(sets, key=lambda s: min(map(len, s), default=0))


def matches(column: Column, pattern: str, ignore_case: bool = False, word: bool = False) -> Column:
    """Whether a pattern is found: as it is, without regard to case, or as whole words."""
    pattern = java_regex(pattern)
    pattern = rf"\b(?:{pattern})\b" if word else pattern
    return column.rlike(f"(?i){pattern}" if ignore_case else pattern)


def glob_regex(glob: str) -> str:
    """A shell glob (``*``, ``?``, ``[...]``) as a regular expression over the whole string."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def ignored(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether a glob matches the relative path, its last part or any of its parts."""
    if not globs:
        return F.lit(False)
    # The last part is one of the parts, so two tests cover all three.
    return _is_one(path, globs) | F.exists(F.split(path, "/"), lambda part: _is_one(part, globs))


def perhaps_ignored(path: Column, globs: list[str]) -> Column:
    """Whether ``ignored`` can hold of a path or of its folder; names without a wildcard are compared part by part, the path is read twice at most."""
    if not globs:
        return F.lit(False)
    parts = F.exists(F.split(path, "/"), lambda part: _is_one(part, globs))
    wide = [g for g in globs if any(c in g for c in "*?[/")]
    return parts | path.rlike(f"(?s)^(?:{'|'.join(map(glob_regex, wide))})(?:/[^/]*)?$") if wide else parts


def _is_one(text: Column, globs: list[str] | tuple[str, ...]) -> Column:
    plain = [g for g in globs if not any(c in g for c in "*?[")]
    wild = [glob_regex(g) for g in globs if g not in plain]
    tests = ([text.isin(plain)] if plain else []) + ([text.rlike(f"(?s)^(?:{'|'.join(wild)})$")] if wild else [])
    return reduce(lambda a, b: a | b, tests)


def extension(path: Column) -> Column:
    """What follows the last dot of a file's name, in lower case; null without one."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def language_of(ext: Column, extensions: dict[str, tuple[str, ...]]) -> Column:
    """Language of an extension; null for none."""
    pairs = [F.lit(x) for lang, exts in extensions.items() for e in exts for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), ext)


def explode_lines(files: DataFrame, text: str = "text", breaks: str = LINE_BREAK, previous: bool = False, until: str | None = None) -> DataFrame:
    """One row per line of ``files``, numbered from 1 in line_no, without its break.

    A break at the end of a text starts no further line; an empty or null text has no lines. Columns other
    than the text stay. With ``previous`` each line also has the one before it (null for the first), so that
    nothing need be shuffled to look back by a line. With ``until`` a text ends before its first line with that pattern.
    """
    parts = F.split(F.regexp_replace(F.col(text), rf"(?:{breaks})\z", ""), breaks, -1)
    keep = [c for c in files.columns if c not in (text, "line_no", "line", "previous")]
    split = files.where(F.length(text) > 0).select(*keep, parts.alias("_line"))
    if until is not None:
        end = F.array_position(F.transform("_line", lambda line: line.rlike(until)), True)
        split = split.withColumn("_end", end).withColumn("_line", F.when(F.col("_end") > 0, F.slice("_line", F.lit(1), F.col("_end").cast("int") - 1)).otherwise(F.col("_line"))).where(F.size("_line") > 0).drop("_end")
    if not previous:
        return split.select(*keep, F.posexplode("_line").alias("_at", "line")).select(*keep, (F.col("_at") + 1).alias("line_no"), "line")
    split = split.withColumn("_before", F.concat(F.array(F.lit(None).cast("string")), F.slice("_line", F.lit(1), F.size("_line") - 1)))
    return split.select(*keep, F.posexplode(F.arrays_zip("_line", "_before")).alias("_at", "_both")).select(*keep, (F.col("_at") + 1).alias("line_no"), F.col("_both._line").alias("line"), F.col("_both._before").alias("previous"))


def line_of(text: Column, offset: Column) -> Column:
    """Line number of a 0-based code-point offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def match_record(text: Column) -> Column:
    """``path:line:code`` read greedily, so a path may hold colons; null fields if it is none."""
    p = r"^(.+):(\d+):(.*)$"
    number = F.regexp_extract(text, p, 2)
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("path"), number.cast("int").alias("line_no"), F.regexp_extract(text, p, 3).alias("code")))


def without_ansi(text: Column) -> Column:
    """A text without terminal control sequences."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def number_literal(text: Column) -> Column:
    """Value of a decimal, hexadecimal, octal or binary literal, underscores allowed; null if it is none."""
    plain = F.lower(F.regexp_replace(F.trim(text), "_", ""))
    bases = reduce(lambda rest, p: F.when(plain.rlike(f"^{p[0]}[0-9a-f]+$"), F.conv(F.substring(plain, 3, 64), p[1], 10).cast("double")).otherwise(rest), (("0x", 16), ("0o", 8), ("0b", 2)), F.expr("CAST(NULL AS DOUBLE)"))
    return F.coalesce(bases, F.when(plain.rlike(r"^[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?n?$"), F.regexp_replace(plain, "n$", "").try_cast("double")))


def timestamps(ci: bool) -> Column:
    """Time of the report: UTC in ISO form for CI, else local."""
    now = F.current_timestamp()
    return F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if ci else F.date_format(now, "yyyy-MM-dd HH:mm:ss")


def count_or_zero(value: Column) -> Column:
    """A count from any text; what is no number counts as 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))

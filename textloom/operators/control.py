"""Control flow over syntax nodes: what a guard leaves open, which regions a condition protects, and resources by scope.

A statement dominates what follows it in its block, at any depth, so its reach is a range of node numbers: from where it ends to
where the node around it ends. ``leaves`` says where control does not come out again. With these two, questions about paths
become joins on ranges and the latest event before a use, and no path is ever followed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.syntax import MARKS, SIGNS
from ..sources.steps import step


def plain_code(code: str | Column = "code") -> Column:
    """A node's code as it is usually written: no blanks but between words."""
    return F.regexp_replace(F.translate(code, MARKS, SIGNS), r"(?<!\w) | (?!\w)", "")


def dominated(nodes: DataFrame) -> DataFrame:
    """``nodes`` with reach_from and reach_to: the node numbers between which all is dominated by a node that comes to its end."""
    around = nodes.select(F.col("path").alias("_path"), F.col("pre").alias("_pre"), F.col("post").alias("reach_to"))
    return nodes.join(around, (F.col("path") == F.col("_path")) & (F.col("parent") == F.col("_pre"))).drop("_path", "_pre").withColumn("reach_from", F.col("post"))


def first_block(nodes: DataFrame) -> DataFrame:
    """``(path, parent, leaves)``: whether the first block of a node leaves, by the node's number."""
    blocks = nodes.where("kind = 'block'").groupBy("path", "parent").agg(F.min_by("leaves", "pre").alias("leaves"), F.min(F.struct("pre", "post", "s_line", "s_col", "e_line", "e_col")).alias("block"))
    return blocks.select("path", F.col("parent").alias("of"), F.col("leaves").alias("body_leaves"), "block")


@dataclass(frozen=True)
class Narrowing:
    """A guard that lets a value be empty, as a pattern of a condition with the name in a group, and what may then not be done with it."""

    lang: str
    guard: str
    use: str


#: Group 1 is the name in each; fixed values.
NARROWINGS = (
    Narrowing("java", r"^(\w+)==null$", r"\b(\w+)(?:!!|\.\w)"), Narrowing("java", r"^null==(\w+)$", r"\b(\w+)(?:!!|\.\w)"),
    Narrowing("js", r"^!(\w+)$", r"\b(\w+)(?:\.\w|\[|!\.)"), Narrowing("js", r"^(\w+)===?(?:null|undefined)$", r"\b(\w+)(?:\.\w|\[|!\.)"),
    Narrowing("csharp", r"^(\w+)(?:==| is )null$", r"\b(\w+)(?:\.\w|!\.|\[)"), Narrowing("csharp", r"^!.*\.TryGetValue\(.*\bout (?:var )?(\w+)\)$", r"\b(\w+)(?:\.\w|\[)"),
    Narrowing("swift", r"^(\w+)==nil$", r"\b(\w+)!"), Narrowing("rust", r"^(\w+)\.is_(?:none|err)\(\)$", r"\b(\w+)\.(?:unwrap|expect)\("),
    Narrowing("golang", r"^(\w+)==nil$", r"\b(\w+)\.\w"), Narrowing("cpp", r"^(\w+)==(?:nullptr|NULL|0)$", r"\b(\w+)->"), Narrowing("cpp", r"^!(\w+)$", r"\b(\w+)->"),
    Narrowing("python", r"^(\w+) is None$", r"\b(\w+)(?:\.\w|\[)"), Narrowing("python", r"^not (\w+)$", r"\b(\w+)(?:\.\w|\[)"), Narrowing("ruby", r"^(\w+)\.nil\?$", r"\b(\w+)\.\w"),
)
#: A condition that can only hold of values that may be empty: files without one are not parsed for narrowing.
GUARD_WORDS = r"\b(?:null|nil|nullptr|NULL|undefined|None)\b|\.is_(?:none|err)\(|TryGetValue|\bif\s*\(?\s*(?:!|not\s)"


def guard_then_use(nodes: DataFrame, narrowings: tuple[Narrowing, ...] = NARROWINGS) -> DataFrame:
    """``(path, lang, line_no, name)`` of the first use of each value that a guard found empty without leaving or giving it another value.

    A guard reaches what its ``if`` dominates; an assignment there, or in the guard's own block, ends that. Uses, guards and
    assignments of one name in one file are events in one order, and a use looks at the latest event before it.
    """
    langs = sorted({n.lang for n in narrowings})
    code = plain_code()
    some = nodes.where(F.col("lang").isin(*langs))
    named = lambda pick, of: F.coalesce(*[F.when((F.col("lang") == n.lang) & (F.regexp_extract(of, pick(n), 1) != ""), F.regexp_extract(of, pick(n), 1)) for n in narrowings])
    tests = some.where("kind = 'condition'").select("path", F.col("parent").alias("of"), named(lambda n: n.guard, code).alias("name")).where("name IS NOT NULL")
    open_ifs = dominated(some).where("kind = 'if'").join(first_block(some).where("NOT body_leaves"), ["path"]).where("pre = of").select("path", "lang", "pre", "reach_from", "reach_to", F.col("block.post").alias("body_to"))
    guards = open_ifs.join(tests.withColumnRenamed("of", "_of"), ["path"]).where("pre = _of").select("path", "lang", "name", F.col("reach_from").alias("at"), F.col("reach_to").alias("upto"), F.col("pre").alias("guard"), "body_to")
    known = guards.select("path", "name").distinct()
    spoken = ("statement", "return", "throw", "if", "loop", "switch", "with", "defer", "await")
    per = [F.when(F.col("lang") == n, F.regexp_extract_all(code, F.lit("|".join(dict.fromkeys(x.use for x in narrowings if x.lang == n))), F.lit(0))) for n in langs]
    words = F.transform(F.coalesce(*per), lambda x: F.regexp_extract(x, r"^\w+", 0))
    uses = some.where(F.col("kind").isin(*spoken)).select("path", F.explode(F.array_distinct(words)).alias("name"), F.col("pre").alias("at"), F.col("s_line").alias("line_no")).join(known, ["path", "name"], "left_semi")
    given = some.where("kind = 'assignment'").select("path", "name", F.col("pre").alias("at")).join(known, ["path", "name"], "left_semi")
    # An assignment within the guard's own block holds from the guard's end on.
    inner = given.join(guards.select("path", "name", "guard", "body_to"), ["path", "name"]).where("at > guard AND at < body_to").select("path", "name", "guard").distinct()
    guards = guards.join(inner, ["path", "name", "guard"], "left_anti")
    nothing = F.lit(None).cast("int")
    events = guards.select("path", "name", "at", "upto", "guard", nothing.alias("line_no"), F.lit(0).alias("rank")).unionByName(given.select("path", "name", "at", F.lit(-1).alias("upto"), nothing.alias("guard"), nothing.alias("line_no"), F.lit(2).alias("rank"))).unionByName(uses.select("path", "name", "at", nothing.alias("upto"), nothing.alias("guard"), "line_no", F.lit(1).alias("rank")))
    before = Window.partitionBy("path", "name").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("rank") != 1, F.struct("upto", "guard")), ignorenulls=True).over(before)
    found = events.withColumn("seen", last).where("rank = 1 AND seen.upto > at AND seen.guard IS NOT NULL")
    firsts = found.groupBy("path", "name", "seen.guard").agg(F.min_by("line_no", "at").alias("line_no"))
    return firsts.join(guards.select("path", "name", "guard", "lang").distinct(), ["path", "name", "guard"]).select("path", "lang", "line_no", "name").distinct()


#: Tests of membership; fixed values.
MEMBERSHIP = r"\bhasOwnProperty\b|\bObject\.hasOwn\(|\b(?:has|has_key\?|key\?|include\?|Map\.has_key\?|respond_to\?)\(|\bin\b(?!\s*\()|\bkey\?"


def guards(nodes: DataFrame) -> DataFrame:
    """``guards(path, form, cond_*, body_*, whole_*)`` for ``guard_regions``, from the conditions of ``if``, conjunctions and choices.

    A test of membership protects the whole statement, a conjunction itself (what comes after its first part), a choice whose condition is a membership
    or a conjunction all of it, any other condition the block that follows.
    """
    spot = lambda prefix, of="": [F.col(f"{of}{c}").alias(f"{prefix}_{c}") for c in ("s_line", "s_col", "e_line", "e_col")]
    code = plain_code()
    form = F.when(code.rlike(MEMBERSHIP), "membership").when(code.rlike(r"&&|\band\b"), "and").otherwise("plain")
    conditions = nodes.where("kind = 'condition'").select("path", F.col("parent").alias("of"), form.alias("form"), *spot("cond"))
    whole = nodes.where("kind = 'if'").select("path", F.col("pre").alias("of"), *spot("whole"))
    tested = whole.join(conditions, ["path", "of"]).join(first_block(nodes), ["path", "of"], "left").select("path", "form", *[f"cond_{c}" for c in ("s_line", "s_col", "e_line", "e_col")], *spot("body", "block."), *[f"whole_{c}" for c in ("s_line", "s_col", "e_line", "e_col")])
    alone = nodes.where("kind = 'and' OR kind = 'ternary'").where((F.col("kind") == "and") | code.rlike(MEMBERSHIP) | code.rlike(r"&&|\band\b"))
    kind = F.when(F.col("kind") == "and", "and").otherwise("ternary")
    return tested.unionByName(alone.select("path", kind.alias("form"), *spot("cond"), *spot("body"), *spot("whole")))


def scoped_open(events: DataFrame, scopes: DataFrame, most: int = 64) -> DataFrame:
    """Acquisitions that no release ends, where a release ends the latest open one of its name in the nearest scope that has any.

    ``events`` has (path, scope, name, off, opens boolean), ``scopes`` (path, scope, up) with up null for a file. From the deepest scopes
    outwards, releases that find nothing open move to the scope around theirs; a level is one window over (path, scope, name). Scopes
    nested deeper than ``most`` are looked at from there on only.
    """
    depth = scopes.where("up IS NULL").select("path", "scope", F.lit(0).alias("depth"))
    levels = [depth]
    for d in range(1, most + 1):
        levels.append(step(scopes.join(levels[-1].select("path", F.col("scope").alias("up")), ["path", "up"]).select("path", "scope", F.lit(d).alias("depth"))))
        if levels[-1].isEmpty():
            levels.pop()
            break
    ranked = events.join(reduce(DataFrame.unionByName, levels), ["path", "scope"])
    out, moved = [], None
    for d in range(len(levels) - 1, -1, -1):
        here = ranked.where(F.col("depth") == d).select("path", "scope", "name", "off", "opens")
        if moved is not None:
            here = here.unionByName(moved)
        by = Window.partitionBy("path", "scope", "name").orderBy("off")
        run = by.rowsBetween(Window.unboundedPreceding, 0)
        sums = here.withColumn("sum", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(run))
        low = sums.withColumn("low", F.least(F.min("sum").over(run), F.lit(0)))
        level = low.withColumn("level", F.col("sum") - F.col("low")).withColumn("was", F.coalesce(F.lag("low").over(by), F.lit(0)))
        later = level.withColumn("least", F.min("level").over(by.rowsBetween(1, Window.unboundedFollowing)))
        out.append(later.where("opens AND (least IS NULL OR least >= level)").select("path", "scope", "name", "off"))
        # A release that pushes the balance to a new low has ended nothing here.
        failed = low.withColumn("was", F.coalesce(F.lag("low").over(by), F.lit(0))).where("NOT opens AND low < was").select("path", "scope", "name", "off", "opens")
        moved = failed.join(scopes, ["path", "scope"]).where("up IS NOT NULL").select("path", F.col("up").alias("scope"), "name", "off", "opens")
    return reduce(DataFrame.unionByName, out)


#: What takes a resource, by language: kind, pattern of an assignment's value, methods and functions that release it; fixed values.
HELD = (
    ("golang", "file", r"=os\.(?:Open|Create|OpenFile)\(", "Close", ""), ("golang", "context", r"=context\.With(?:Cancel|Timeout|Deadline)\(", "", ""),
    ("java", "stream", r"=new \w*(?:Stream|Reader|Writer|Scanner|Socket)\(", "close", ""), ("cpp", "memory", r"=(?:\(.*\))?(?:malloc|calloc)\(", "", "free"), ("cpp", "file", r"=fopen\(", "", "fclose"),
    ("csharp", "disposable", r"=new \w*(?:Stream|Reader|Writer|Client|TokenSource)\(", "Dispose Close", ""), ("js", "interval", r"=setInterval\(", "", "clearInterval"), ("js", "socket", r"=new (?:WebSocket|Worker)\(", "close terminate", ""),
    ("python", "file", r"=(?:io\.)?open\(", "close", ""), ("ruby", "file", r"=File\.open\(", "close", ""), ("rust", "thread", r"=(?:std::)?thread::spawn\(", "join", ""), ("swift", "timer", r"=Timer\.scheduledTimer\(", "invalidate", ""),
)


def held_resources(nodes: DataFrame, held: tuple = HELD) -> DataFrame:
    """``(path, lang, line_no, kind, name)`` of resources that are taken and not released in their scope or one inside it."""
    code = plain_code()
    taken = F.coalesce(*[F.when((F.col("lang") == lang) & code.rlike(p), F.lit(kind)) for lang, kind, p, _, _ in held])
    opened = nodes.where("kind = 'assignment'").select("path", "lang", "scope", F.regexp_extract("name", r"^(\w+)", 1).alias("name"), F.col("pre").alias("off"), taken.alias("kind"), F.col("s_line").alias("line_no")).where("kind IS NOT NULL")
    method = F.coalesce(*[F.when((F.col("lang") == lang) & F.col("name").rlike(rf"^\w+\??\.(?:{'|'.join(ms.split())})$"), F.regexp_extract("name", r"^(\w+)", 1)) for lang, _, _, ms, _ in held if ms])
    function = F.coalesce(*[F.when((F.col("lang") == lang) & (F.col("name") == f), F.regexp_extract(code, r"\((\w+)\)$", 1)) for lang, _, _, _, fs in held for f in fs.split()])
    closed = nodes.where("kind = 'call'").select("path", "scope", F.coalesce(method, function).alias("name"), F.col("pre").alias("off")).where("name IS NOT NULL AND name <> ''")
    events = opened.select("path", "scope", "name", "off", F.lit(True).alias("opens")).unionByName(closed.withColumn("opens", F.lit(False)))
    scopes = nodes.where("kind IN ('file', 'function', 'closure')").select("path", F.col("pre").alias("scope"), F.col("scope").alias("up"))
    scopes = scopes.join(opened.select("path").distinct(), "path", "left_semi")
    return scoped_open(events, scopes).join(opened, ["path", "scope", "name", "off"]).select("path", "lang", "line_no", "kind", "name")

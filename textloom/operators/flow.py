"""Flow of request data to dangerous calls, file by file.

A specification names the sources, sinks, sanitisers and how names are bound; one engine serves all languages
and families. Files are read alone, so the work is spread by file and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SUPPRESSION_MARKERS
from ..functions.text import LINE_BREAK
from ..schemas import FLOW
from ..sources.steps import by_file


@dataclass(frozen=True)
class FlowSpec:
    """One family of flows in one language; the number fields are bounds in lines, names and rounds."""

    rule_id: str
    lang: str
    category: int
    severity: str
    source: str
    sink: str
    safe: str = r"(?!)"
    guard: str = r"(?!)"
    back: int = 0
    ahead: int = 0
    path: int = 5
    passes: int = 5
    forget: bool = False  # whether a clean assignment clears a name
    title: str = ""


#: Where request data comes from, by language; fixed values.
SOURCES = {
    "js": r"\breq(uest)?\.(query|body|params|headers|cookies)\b|\bctx\.(query|request|params)\b|\bprocess\.argv\b|\blocation\.(search|hash|href)\b|\bevent\.(body|queryStringParameters)\b",
    "python": r"\brequest\.(args|form|values|json|data|GET|POST|query_params|cookies|headers|files|get_json)\b|\binput\s*\(|\bsys\.argv\b|\bos\.environ\b|\bflask\.request\b",
    "golang": r"\br(eq|equest)?\.(FormValue|PostFormValue|URL\.Query|Header\.Get|PathValue|Host)\b|\bc\.(Query|Param|PostForm|GetHeader)\s*\(|\bmux\.Vars\(",
    "java": r"\brequest\.(getParameter|getHeader|getQueryString|getPathInfo|getCookies)\b|@(RequestParam|PathVariable|RequestBody|RequestHeader)\b",
    "ruby": r"\bparams\s*\[|\brequest\.(headers|query_string|referer|host|env)\b|\bcookies\s*\[",
    "csharp": r"\bRequest\.(Query|Form|Headers|Cookies|Path|Host)\b|\[From(Query|Route|Body|Header|Form)\]",
    "elixir": r"\bconn\.(params|query_params|body_params|path_params|host)\b|\bget_req_header\(|%\{\"\w+\"\s*=>\s*\w+\}\s*=\s*params|\bparams\[",
    "rust": r"\b(web::)?(Query|Path|Form|Json)\s*\(|\.query_string\(|\bheaders\(\)\.get\(|\bstd::env::args\(",
    "cpp": r"\breq(uest)?(\.|->)(get_param_value|get_header_value|body|params|url_params|target)\b|\bgetenv\s*\(|\bargv\s*\[",
    "swift": r"\breq(uest)?\.(query|content|parameters|headers|url)\b|\burlComponents\.queryItems\b|\bCommandLine\.arguments\b",
}
_CATEGORY = {"js": 7, "python": 7, "golang": 9, "java": 4, "ruby": 6, "csharp": 8, "elixir": 4, "rust": 8, "cpp": 10, "swift": 6}
#: (family, title, safe, guard, look-back, sinks by language); fixed values.
_FAMILIES: list[tuple[str, str, str, str, int, dict[str, str]]] = [
    ("sql", "Request data is part of an SQL text", r"(?i)\bparameteri[sz]e|\bescape\w*\s*\(|\bquote\w*\s*\(|\bint\s*\(|\bNumber\s*\(|,\s*[\[(]|\?\s*[\"'`]\s*,", r"(?!)", 0, {
        "js": r"\b(query|execute|raw)\s*\(", "python": r"\b(execute|executemany|executescript|raw|read_sql\w*)\s*\(", "golang": r"\.(Query|QueryRow|Exec)(Context)?\s*\(", "java": r"\b(executeQuery|executeUpdate|createQuery|createNativeQuery|prepareStatement)\s*\(", "ruby": r"\b(where|find_by_sql|execute|order)\s*\(", "csharp": r"\b(FromSqlRaw|ExecuteSqlRaw|SqlCommand)\s*\(", "elixir": r"\b(query!?|fragment)\s*\(", "rust": r"\b(query|execute|sql_query)\s*\(",
    }),
    ("command", "Request data reaches a command", r"(?i)shlex\.quote|pipes\.quote|shellescape|escapeshell|allow\w*\.(has|includes|get)", r"(?!)", 0, {
        "js": r"\b(exec|execSync|spawn|spawnSync|execFile)\s*\(", "python": r"\b(subprocess\.(run|Popen|call|check_output|check_call)|os\.(system|popen|exec\w+|spawn\w+))\s*\(", "golang": r"\bexec\.Command(Context)?\s*\(", "java": r"\.exec\s*\(|new\s+ProcessBuilder\s*\(", "ruby": r"\b(system|exec|spawn|Open3\.\w+|IO\.popen)\s*\(|`[^`]*#\{", "csharp": r"Process\.Start\s*\(", "elixir": r"\b(System\.cmd|System\.shell|:os\.cmd)\s*\(", "rust": r"\bCommand::new\s*\(|\.args?\s*\(", "cpp": r"\b(system|popen|execl\w*|execv\w*)\s*\(",
    }),
    ("path", "Request data names a file", r"(?i)secure_filename|safe_join|basename|path\.normalize|filepath\.Base|Path\.GetFileName|File\.basename|file_name\(\)|Path\.basename", r"(?i)commonpath|is_relative_to|startswith|HasPrefix|starts_with|StartsWith|hasPrefix|relative_to|filepath\.Rel|realpath|canonical", 16, {
        "js": r"\b(readFile|readFileSync|createReadStream|sendFile|writeFile|writeFileSync|unlink)\s*\(", "python": r"(^|[^.\w])(open|send_file|FileResponse|Path)\s*\(|\.(read_text|read_bytes|write_text|unlink)\s*\(", "golang": r"\bos\.(Open|ReadFile|Create|Remove|OpenFile)\s*\(|http\.ServeFile\s*\(", "java": r"new\s+File(InputStream|OutputStream|Reader|Writer)?\s*\(|Paths?\.(get|of)\s*\(", "ruby": r"\b(File\.(open|read|write|delete)|send_file|IO\.read)\b", "csharp": r"\bFile\.(Open|ReadAll\w+|WriteAll\w+|Delete)\s*\(|PhysicalFile\s*\(", "elixir": r"\b(File\.(read|open|write|rm)!?|send_file|send_download)\s*\(", "rust": r"\b(File::open|fs::(read|read_to_string|write|remove_file)|NamedFile::open)\s*\(", "cpp": r"\b(fopen|ifstream\s+\w+|ofstream\s+\w+|open)\s*\(", "swift": r"\b(contentsOf(File)?|FileHandle|createFile|removeItem)\b",
    }),
    ("redirect", "Request data is the target of a redirect", r"(?i)url_for|is_safe_url|url_has_allowed_host|allowed\w*|LocalRedirect|Url\.IsLocalUrl", r"(?i)netloc|hostname|allowed|IsLocalUrl|is_safe|startswith\s*\(\s*[\"']/", 24, {
        "js": r"\bredirect\s*\(|location(\.href)?\s*=[^=]", "python": r"\b(redirect|RedirectResponse|HttpResponseRedirect)\s*\(", "golang": r"\bhttp\.Redirect\s*\(|c\.Redirect\s*\(", "java": r"\bsendRedirect\s*\(|\"redirect:\"\s*\+", "ruby": r"\bredirect_to\b", "csharp": r"\bRedirect(Permanent)?\s*\(", "elixir": r"\bredirect\s*\(.*external:", "rust": r"\bRedirect::(to|temporary|permanent)\s*\(", "cpp": r"\bset_redirect\s*\(", "swift": r"\.redirect\s*\(\s*to:",
    }),
    ("header", "Request data goes into a response header", r"(?i)quote|encodeURI|sanitize|replace\s*\(.*\\[rn]|url_encode|URI\.encode", r"(?i)\\r|\\n|crlf|sanitize", 18, {
        "js": r"\b(setHeader|writeHead|res\.(set|header|append))\s*\(", "python": r"\.headers\[[^\]]+\]\s*=|\.set_cookie\s*\(|make_response\s*\(.*headers", "golang": r"\.Header\(\)\.(Set|Add)\s*\(", "java": r"\b(setHeader|addHeader)\s*\(", "ruby": r"(response\.)?headers\[[^\]]+\]\s*=", "csharp": r"Response\.Headers(\.(Add|Append)\s*\(|\[)", "elixir": r"\bput_resp_header\s*\(", "rust": r"\b(insert_header|append_header|header)\s*\(", "cpp": r"\bset_header\s*\(", "swift": r"\.headers\.(add|replaceOrAdd)\s*\(",
    }),
    ("outbound", "Request data is the address of a request", r"(?i)allow(ed|list)|whitelist|validate_url|is_safe", r"(?i)hostname|netloc|allowed|getHost|\.host\b|IsLoopback|private", 24, {
        "js": r"\b(fetch|axios(\.\w+)?|got|request\.(get|post))\s*\(", "python": r"\b(requests|httpx|session)\.(get|post|put|delete|patch|head|request)\s*\(|\burlopen\s*\(", "golang": r"\bhttp\.(Get|Post|Head|NewRequest\w*)\s*\(", "java": r"new\s+URL\s*\(|URI\.create\s*\(|getForObject\s*\(", "ruby": r"\b(Net::HTTP\.\w+|URI\.open|HTTParty\.\w+|Faraday\.\w+)\b", "csharp": r"\b(GetAsync|PostAsync|GetStringAsync|SendAsync)\s*\(", "elixir": r"\b(HTTPoison|Req|Tesla|Finch)\.\w+!?\s*\(", "rust": r"\breqwest::get\s*\(|\.(get|post)\s*\(", "cpp": r"CURLOPT_URL\s*,", "swift": r"\bURL\s*\(\s*string:",
    }),
    ("regex", "Request data is compiled as a pattern", r"(?i)re\.escape|escapeRegExp|QuoteMeta|Pattern\.quote|Regexp\.escape|regex::escape|Regex\.Escape", r"(?!)", 0, {
        "js": r"new\s+RegExp\s*\(", "python": r"\bre\.(compile|match|search|fullmatch|findall|finditer|split|subn?)\s*\(", "golang": r"\bregexp\.(MustCompile|Compile|MatchString)\s*\(", "java": r"Pattern\.compile\s*\(", "ruby": r"Regexp\.new\s*\(", "csharp": r"new\s+Regex\s*\(", "rust": r"Regex::new\s*\(", "elixir": r"Regex\.compile!?\s*\(",
    }),
    ("markup", "Request data goes into a page unescaped", r"(?i)escape|sanitize|DOMPurify|bleach\.clean|nh3\.clean|encodeURIComponent", r"(?!)", 0, {
        "js": r"\b(innerHTML|outerHTML)\s*=|document\.write\s*\(|res\.send\s*\(", "python": r"\b(mark_safe|Markup|SafeString|render_template_string|HttpResponse)\s*\(", "ruby": r"\.html_safe|\braw\s*\(", "java": r"getWriter\(\)\.(print|println|write)\s*\(", "golang": r"template\.HTML\s*\(", "csharp": r"Html\.Raw\s*\(", "elixir": r"\braw\s*\(",
    }),
    ("host", "The Host header makes an address", r"(?i)allowed_hosts|SERVER_NAME|canonical", r"(?i)allowed|canonical", 18, {
        "python": r"(reset|confirm|callback|absolute)\w*(url|link)\w*\s*=|\b(send_mail|render)\w*\s*\(", "golang": r"(?i)(url|link)\w*\s*:?=.*(Sprintf|\+)", "js": r"(?i)(url|link)\w*\s*=\s*`", "rust": r"(?i)(url|link)\w*\s*=\s*format!",
    }),
    ("archive", "An archive's entry names a path", r"(?i)safe_extract|filter\s*=\s*[\"']data|basename|filepath\.Base|GetFileName", r"(?i)commonpath|is_relative_to|startswith|HasPrefix|StartsWith|canonical|resolve|filepath\.Rel", 16, {
        "python": r"\.(extractall|extract)\s*\(", "golang": r"\bos\.(Create|OpenFile|MkdirAll)\s*\(", "java": r"new\s+File(OutputStream)?\s*\(", "js": r"\b(createWriteStream|writeFileSync|writeFile)\s*\(", "csharp": r"\.ExtractToFile\s*\(|ExtractToDirectory\s*\(", "ruby": r"\bFile\.(open|write)\b|\.extract\s*\(",
    }),
    ("nosql", "Request data is a query filter", r"(?i)\bstr\s*\(|String\s*\(|ObjectId\s*\(|int\s*\(", r"(?!)", 0, {"python": r"\.(find|find_one|update_one|update_many|delete_one|delete_many|aggregate|count_documents)\s*\(", "js": r"\.(find|findOne|updateOne|deleteOne|aggregate)\s*\("}),
    ("template", "Request data is the text of a template", r"(?!)", r"(?!)", 0, {"python": r"\b(Template|from_string|render_template_string)\s*\(", "js": r"\b(ejs|pug|handlebars|Handlebars)\.(render|compile)\s*\(", "ruby": r"ERB\.new\s*\("}),
    ("ldap", "Request data is part of a directory query", r"escape_filter_chars|escape_dn_chars", r"(?!)", 0, {"python": r"\.(search|search_s|search_ext|modify_s|simple_bind_s)\s*\("}),
    ("mail", "Request data goes into a mail header", r"(?i)sanitize|validate|replace\s*\(.*\\[rn]", r"(?!)", 0, {"python": r"\b(send_mail|EmailMessage|sendmail)\s*\(|msg\[[^\]]+\]\s*="}),
    ("mass", "All request data goes into a model", r"(?i)validated|cleaned_data|\.pick\(|permit", r"(?!)", 0, {"python": r"\b[A-Z]\w*\s*\(\s*\*\*|\.update\s*\(\s*\*\*", "js": r"Object\.assign\s*\(|\.create\s*\(\s*req\.body", "ruby": r"\.(new|create|update)\s*\(\s*params"}),
    ("eval", "Request data is run as code", r"(?i)literal_eval", r"(?!)", 0, {"python": r"(^|[^.\w])(eval|exec)\s*\(", "js": r"\beval\s*\(|new\s+Function\s*\(", "ruby": r"\b(instance_)?eval\b", "elixir": r"Code\.eval_string"}),
]
_ARCHIVE_SOURCE = r"\b(entry|member|info|header|hdr)\.(name|filename|Name|getName|FullName|path|fileName)\b|\b(zipfile|tarfile|ZipFile|TarFile)\b"
#: Random values under names of secrets; fixed values.
_RANDOM = {"python": r"\brandom\.(random|randint|choice|choices|randrange|getrandbits|sample)\b", "js": r"\bMath\.random\b", "golang": r"\brand\.(Int\w*|Read|Uint\w*)\b", "java": r"new\s+Random\b|Math\.random\b", "ruby": r"\b(rand|Random\.rand)\b", "csharp": r"new\s+Random\b|Random\.Shared\b", "cpp": r"\brand\s*\(|mt19937\b", "rust": r"\bthread_rng\b|SmallRng\b", "swift": r"\b(drand48|arc4random_stir|rand)\s*\(", "elixir": r":rand\.\w+"}


def flow_specs() -> list[FlowSpec]:
    """All families in all their languages."""
    out = []
    for family, title, safe, guard, back, sinks in _FAMILIES:
        for lang, sink in sinks.items():
            source = _ARCHIVE_SOURCE if family == "archive" else SOURCES[lang]
            out.append(FlowSpec(f"{lang}.flow.{family}", lang, _CATEGORY[lang], "critical", source, sink, safe, guard, back, 9 if lang == "csharp" else 7, 4 if back else 5, {"js": 6, "golang": 7}.get(lang, 5), lang == "elixir", title))
    for lang, source in _RANDOM.items():
        out.append(FlowSpec(f"{lang}.flow.random", lang, _CATEGORY[lang], "critical", source, r"(?i)\b\w*(token|secret|password|session|nonce|salt|otp|api_?key)\w*\s*(:?=|:)[^=]", r"(?i)SecureRandom|crypto|secrets\.|SystemRandom", title="A weak generator makes a secret"))
    return out


_ASSIGN = {
    "python": r"^\s*(?P<names>[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*(?::[^=]+)?=(?!=)\s*(?P<expr>.+)",
    "golang": r"^\s*(?:var\s+)?(?P<names>[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)(?:\s+[\w.*\[\]]+)?\s*:?=(?!=)\s*(?P<expr>.+)",
    "js": r"^\s*(?:const|let|var)?\s*(?P<names>[A-Za-z_$][\w$]*|[{\[][^}\]]*[}\]])\s*(?::[^=]+)?=(?![=>])\s*(?P<expr>.+)",
    "java": r"^\s*(?:final\s+)?(?:[\w<>\[\],.?]+\s+)?(?P<names>[A-Za-z_]\w*)\s*=(?!=)\s*(?P<expr>.+)",
    "rust": r"^\s*(?:let\s+(?:mut\s+)?)?(?P<names>[A-Za-z_]\w*)\s*(?::[^=]+)?=(?![=>])\s*(?P<expr>.+)",
    "swift": r"^\s*(?:let|var|guard\s+let|if\s+let)?\s*(?P<names>[A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)\s*(?P<expr>.+)",
    "cpp": r"^\s*(?:const\s+)?(?:[\w:<>&*]+\s+[&*]*)?(?P<names>[A-Za-z_]\w*)\s*=(?!=)\s*(?P<expr>.+)",
}
_ASSIGN |= {"csharp": _ASSIGN["java"], "ruby": r"^\s*(?P<names>@?[A-Za-z_]\w*)\s*\|{0,2}=(?![=~])\s*(?P<expr>.+)", "elixir": r"^\s*(?P<names>[A-Za-z_]\w*|%?\{[^}]*\})\s*=(?![=~>])\s*(?P<expr>.+)"}
_NAME = re.compile(r"[A-Za-z_$@][\w$]*")
_STRING = re.compile(r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""")
_COMMENTS = {"python": "#", "ruby": "#", "elixir": "#"}
_BREAK = re.compile(LINE_BREAK)


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _strip(line: str, mark: str) -> str:
    """The line up to a comment that does not stand in a literal."""
    plain = _STRING.sub(lambda m: "_" * len(m[0]), line)
    at = plain.find(mark)
    return line if at < 0 or mark == "//" and at and line[at - 1] == ":" else line[:at]


def _reach(expr: str, tainted: dict[str, list[str]]) -> str | None:
    """The first tainted name in an expression; names inside plain literals do not count, those in interpolations do."""
    if not tainted:
        return None
    plain = expr if re.search(r"[{$#]\{?\w|\bf[\"']", expr) else _STRING.sub(" ", expr)
    return next((n for n in _NAME.findall(plain) if n in tainted), None)


def trace(text: str, spec: FlowSpec, markers: tuple[str, ...] = SUPPRESSION_MARKERS) -> list[tuple[int, str, list[str]]]:
    """(line, code, trail) of each sink line that source data reaches, at most one a line.

    Names are bound file-wide. Assignments are gone through until nothing changes, ``passes`` rounds at most;
    with ``forget`` a clean assignment clears its names and the file is read once, in order. A sink is let
    off by a safe expression in its statement, or by a guard within ``back`` lines when a name carries the data.
    """
    source, sink, safe, guard = map(_compiled, (spec.source, spec.sink, spec.safe, spec.guard))
    if not source.search(text) or not sink.search(text):
        return []
    assign, mark = _compiled(_ASSIGN[spec.lang]), _COMMENTS.get(spec.lang, "//")
    raw = _BREAK.split(text)
    lines = [_strip(x, mark) for x in raw]
    low = [any(m in x.lower() for m in markers) for x in raw]
    hidden = [now or before for now, before in zip(low, [False, *low], strict=False)]

    def statement(n: int) -> str:
        whole = lines[n]
        for k in range(n + 1, min(len(lines), n + 1 + spec.ahead)):
            if whole.count("(") <= whole.count(")"):
                break
            whole += " " + lines[k].strip()
        return whole

    def bind(n: int) -> list[tuple[list[str], str]]:
        m = assign.match(statement(n))
        return [(_NAME.findall(m["names"]), m["expr"])] if m else []

    tainted: dict[str, list[str]] = {}

    def learn(n: int) -> bool:
        changed = False
        for names, expr in bind(n):
            found = source.search(expr)
            trail = None if safe.search(expr) else [found[0].strip(" (")] if found else None
            if trail is None and not safe.search(expr) and (name := _reach(expr, tainted)) is not None:
                trail = tainted[name]
            for name in names:
                if trail is None:
                    if spec.forget:
                        tainted.pop(name, None)
                elif name not in tainted:
                    tainted[name] = [*trail[-(spec.path - 1) :], name]
                    changed = True
        return changed

    if not spec.forget:
        for _ in range(spec.passes + 1):
            # All lines are learnt in each round, so a name may be used above its binding.
            if not any([learn(n) for n in range(len(lines))]):
                break
    out = []
    for n, line in enumerate(lines):
        if spec.forget:
            learn(n)
        if hidden[n] or not (m := sink.search(line)):
            continue
        whole = statement(n)
        rest = whole[m.start() :]
        if safe.search(whole):
            continue
        if found := source.search(rest):
            out.append((n + 1, raw[n].strip(), [found[0].strip(" ("), m[0].strip(" (=")]))
            continue
        name = _reach(rest[len(m[0].rstrip("(")) :], tainted)
        if name is None:
            continue
        near = "\n".join(lines[max(0, n - spec.back) : n + 2]) if spec.back else ""
        if near and guard.search(near) and re.search(rf"(?<!\w){re.escape(name)}(?!\w)", near):
            continue
        out.append((n + 1, raw[n].strip(), [*tainted[name][-(spec.path - 1) :], m[0].strip(" (=")]))
    return out


def flows(files: DataFrame, specs: list[FlowSpec] | None = None, markers: tuple[str, ...] = SUPPRESSION_MARKERS) -> DataFrame:
    """FLOW rows of ``files(path, lang, text)`` for all specifications of each file's language.

    Texts without a source of their language are let go on the JVM, before Python.
    """
    specs = flow_specs() if specs is None else specs
    by_lang: dict[str, list[FlowSpec]] = {}
    for s in specs:
        by_lang.setdefault(s.lang, []).append(s)
    may = F.lit(False)
    for lang, mine in by_lang.items():
        may |= (F.col("lang") == lang) & F.col("text").rlike("|".join(f"(?:{p})" for p in dict.fromkeys(s.source for s in mine)))

    def traced(path: str, lang: str, text: str) -> Iterator[tuple]:
        return ((s.rule_id, path, n, code, trail) for s in by_lang.get(lang, ()) for n, code, trail in trace(text, s, markers))

    return by_file(files.where(may), ["path", "lang", "text"], traced, FLOW)

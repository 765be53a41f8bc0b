"""The catalogue's rules about syntax: what a call, statement or block is, and what is in it or around it.

Each has an example, with ``@`` for a name, and the lines of it where the rule holds. All rules of a scan are one pass over the nodes and one join.
"""

from __future__ import annotations

from functools import cache

from .userrules import SyntaxRule, syntax_rule

_ANY_STATEMENT = [{"kind": k} for k in ("statement", "return", "throw", "if", "loop", "switch", "with")]
_SILENT = {"kind": "catch", "not": {"has": {"any": _ANY_STATEMENT}}}


def _calls(*names: str) -> list[dict]:
    return [{"pattern": f"{n}($$$)"} for n in names]


#: (language, name, severity, rule, title, example, lines). Names of libraries' functions are fixed values.
TREES: list[tuple[str, str, str, dict, str, str, list[int]]] = [
    ("js", "unhandled_then", "warning", {"all": [{"pattern": "$P.then($F)"}, {"not": {"inside": {"any": [{"pattern": "$_.catch($$$)"}, {"pattern": "$_.finally($$$)"}, {"kind": "try"}, {"kind": "return"}]}}}]}, "A promise's failure goes unhandled", "@(1).then(a);\n@(2).then(a).catch(b);\nfunction f() {\n  return @(4).then(a);\n}\n", [1]),
    ("js", "serial_await", "info", {"pattern": "await $X", "inside": {"kind": "loop"}, "not": {"inside": {"any": [{"pattern": "Promise.all($$$)"}, {"kind": "condition"}]}}}, "Waits follow each other in a loop", "for (const a of b) {\n  await @(a);\n}\nawait @(1);\n", [2]),
    ("js", "unguarded_parse", "warning", {"pattern": "JSON.parse($X)", "not": {"inside": {"kind": "try"}}}, "A text is parsed without handling failure", "x = JSON.parse(@);\ntry { JSON.parse(@); } catch (e) { log(e); }\n", [1]),
    ("js", "effect_keeps_interval", "warning", {"pattern": "useEffect($$$)", "has": {"pattern": "setInterval($$$)"}, "not": {"has": {"pattern": "clearInterval($$$)"}}}, "An effect starts an interval and never clears it", "useEffect(() => {\n  @ = setInterval(f, 1);\n}, []);\nuseEffect(() => {\n  @ = setInterval(f, 1);\n  return () => clearInterval(@);\n}, []);\n", [1]),
    ("js", "effect_keeps_listener", "warning", {"pattern": "useEffect($$$)", "has": {"pattern": "$W.addEventListener($$$)"}, "not": {"has": {"pattern": "$W.removeEventListener($$$)"}}}, "An effect adds a listener and never removes it", "useEffect(() => {\n  window.addEventListener('a', @);\n}, []);\nuseEffect(() => {\n  window.addEventListener('a', @);\n  return () => window.removeEventListener('a', @);\n}, []);\n", [1]),
    ("js", "pattern_in_loop", "info", {"pattern": "new RegExp($$$)", "inside": {"kind": "loop"}}, "A pattern is compiled in a loop", "while (a) {\n  b = new RegExp(@);\n}\nnew RegExp(@);\n", [2]),
    ("js", "unverified_token", "critical", {"kind": "function", "has": {"pattern": "jwt.decode($$$)"}, "not": {"has": {"pattern": "jwt.verify($$$)"}}}, "A token is decoded and never verified", "function f(a) {\n  return jwt.decode(@);\n}\nfunction g(a) {\n  jwt.verify(@, key);\n  return jwt.decode(@);\n}\n", [1]),
    ("js", "open_algorithms", "warning", {"pattern": "jwt.verify($$$)", "not": {"has": {"regex": "algorithms"}}}, "A token is verified by any algorithm", "jwt.verify(@, key);\njwt.verify(@, key, { algorithms: ['RS256'] });\n", [1]),
    ("js", "open_cookie", "warning", {"pattern": "res.cookie($$$)", "not": {"has": {"regex": "secure:true"}}}, "A cookie may travel unencrypted", "res.cookie('a', @);\nres.cookie('a', @, { secure: true });\nres.cookie('a', @, { httpOnly: true });\n", [1, 3]),
    ("js", "cors_for_all", "critical", {"all": [{"pattern": "cors($$$)"}, {"has": {"regex": r"origin:(true|['\"]\*['\"])"}}, {"has": {"regex": "credentials:true"}}]}, "Any site may send requests with credentials", "app.use(cors({ origin: true, credentials: true }));\napp.use(cors({ origin: '@', credentials: true }));\n", [1]),
    ("js", "timing_compare", "warning", {"regex": r"\b\w*([sS]ignature|[hH]mac|[dD]igest)\w*\s*[!=]==?\s*\w", "not": {"regex": r"timingSafeEqual|null|undefined|typeof|\.length"}}, "A digest is compared in a time that tells of it", "if (signature === @) {\n  go();\n}\nif (digest === undefined) {\n  go();\n}\n", [1]),
    ("js", "lost_request", "warning", {"kind": "statement", "regex": r"^(fetch|axios\.\w+)\(", "not": {"regex": r"\.(then|catch|finally)\("}}, "A request is started and dropped", "fetch(@);\nawait fetch(@);\nconst r = fetch(@);\nfetch(@).then(a).catch(b);\n", [1]),
    ("js", "silent_catch", "warning", _SILENT, "A failure is caught and passed over", "try {\n  @();\n} catch (e) {\n}\ntry { @(); } catch (e) { log(e); }\n", [3]),
    ("js", "thrown_literal", "warning", {"kind": "throw", "regex": r"^throw ?['\"`\d]"}, "What is thrown has no stack", "function f() {\n  throw 'bad';\n}\nfunction g() {\n  throw new Error(@);\n}\n", [2]),
    ("js", "async_executor", "warning", {"pattern": "new Promise($$$)", "has": {"regex": r"^async\b"}}, "A promise's executor is asynchronous", "a = new Promise(async (b, c) => {\n  b(@);\n});\nd = new Promise((b, c) => b(@));\n", [1]),
    ("js", "async_foreach", "warning", {"pattern": "$A.forEach($$$)", "has": {"regex": r"^async\b"}}, "forEach does not wait", "@.forEach(async (a) => {\n  b(a);\n});\n@.forEach((a) => b(a));\n", [1]),
    ("js", "written_document", "warning", {"any": _calls("document.write", "document.writeln")}, "The document is written to", "document.write(@);\ndocument.body.append(@);\n", [1]),
    ("js", "timer_runs_text", "critical", {"any": _calls("setTimeout", "setInterval"), "regex": r"\(['\"`]"}, "A timer runs a text", "setTimeout('a()', 1);\nsetTimeout(@, 1);\n", [1]),
    ("js", "markup_assigned", "warning", {"any": [{"pattern": "$E.innerHTML = $V"}, {"pattern": "$E.outerHTML = $V"}], "not": {"regex": r"(?i)sanitize|purify|escape|=\s*['\"]"}}, "Markup is set from a value", "a.innerHTML = @;\na.innerHTML = DOMPurify.sanitize(@);\na.textContent = @;\n", [1]),
    ("js", "command_from_parts", "critical", {"any": _calls("exec", "execSync", "child_process.exec"), "regex": r"[+`]"}, "A command is put together", "exec('ls ' + @);\nexec('ls');\n", [1]),
    ("js", "finally_returns", "warning", {"kind": "return", "inside": {"kind": "finally"}}, "A return in finally hides failures", "function f() {\n  try {\n    @();\n  } finally {\n    return 1;\n  }\n}\n", [5]),
    ("python", "unmanaged_file", "warning", {"pattern": "open($$$)", "not": {"inside": {"kind": "with"}}}, "A file is opened outside of with", "x = open(@)\nwith open(@) as h:\n    pass\n", [1]),
    ("python", "unguarded_parse", "warning", {"any": _calls("json.loads", "json.load"), "not": {"inside": {"kind": "try"}}}, "A text is parsed without handling failure", "json.loads(@)\ntry:\n    json.loads(@)\nexcept ValueError:\n    raise\n", [1]),
    ("python", "endless_request", "warning", {"any": _calls("requests.get", "requests.post", "requests.put", "requests.delete", "requests.request"), "not": {"regex": "timeout"}}, "A request has no time limit", "requests.get(@)\nrequests.get(@, timeout=1)\n", [1]),
    ("python", "shared_default", "critical", {"kind": "function", "regex": r"=(\[\]|\{\}|set\(\)|dict\(\)|list\(\))"}, "A default is shared by all calls", "def f(a, b=[]):\n    return @\n\n\ndef g(a, b=None):\n    return @\n", [1]),
    ("python", "catches_all", "warning", {"kind": "catch", "regex": r"^except ?:"}, "A handler catches everything", "try:\n    @()\nexcept:\n    raise\n", [3]),
    ("python", "silent_catch", "warning", {"kind": "catch", "has": {"regex": "^pass$"}, "not": {"has": {"any": [{"kind": "if"}, {"kind": "loop"}, {"kind": "return"}, {"kind": "call"}]}}}, "A failure is caught and passed over", "try:\n    @()\nexcept E:\n    pass\ntry:\n    @()\nexcept E:\n    log()\n", [3]),
    ("python", "blocking_in_async", "warning", {"any": _calls("time.sleep", "requests.get", "requests.post", "subprocess.run", "urlopen"), "inside": {"kind": "async"}, "not": {"inside": {"pattern": "$_.to_thread($$$)"}}}, "A blocking call stops the loop", "async def f():\n    time.sleep(@)\n\n\ndef g():\n    time.sleep(@)\n", [2]),
    ("python", "serial_await", "info", {"pattern": "await $X", "inside": {"kind": "loop"}, "not": {"inside": {"pattern": "$_.gather($$$)"}}}, "Waits follow each other in a loop", "async def f():\n    for a in b:\n        await @(a)\n    await @(1)\n", [3]),
    ("python", "unsafe_yaml", "critical", {"pattern": "yaml.load($$$)", "not": {"regex": "SafeLoader"}}, "A text is loaded as any object", "yaml.load(@)\nyaml.load(@, Loader=yaml.SafeLoader)\n", [1]),
    ("python", "shell_command", "critical", {"any": _calls("subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call"), "regex": "shell=True"}, "A command goes through a shell", "subprocess.run(@, shell=True)\nsubprocess.run([@])\n", [1]),
    ("python", "weak_digest", "warning", {"any": _calls("hashlib.md5", "hashlib.sha1"), "not": {"regex": "usedforsecurity=False"}}, "A digest that can be forged", "hashlib.md5(@)\nhashlib.md5(@, usedforsecurity=False)\nhashlib.sha256(@)\n", [1]),
    ("python", "guessable_name", "critical", {"pattern": "tempfile.mktemp($$$)"}, "A temporary name that others can take", "tempfile.mktemp()\ntempfile.mkstemp(@)\n", [1]),
    ("python", "finally_returns", "warning", {"kind": "return", "inside": {"kind": "finally"}}, "A return in finally hides failures", "def f():\n    try:\n        @()\n    finally:\n        return 1\n", [5]),
    ("python", "compared_to_itself", "warning", {"pattern": "$A == $A"}, "A value is compared to itself", "if @ == @:\n    go()\nif @ == b:\n    go()\n", [1]),
    ("python", "unsure_lock", "warning", {"pattern": "$L.acquire()", "not": {"inside": {"any": [{"kind": "try"}, {"kind": "with"}]}}}, "A lock may stay locked", "@.acquire()\ntry:\n    @.acquire()\nfinally:\n    @.release()\n", [1]),
    ("python", "formatted_log", "info", {"any": [{"pattern": f"{o}.{m}($$$)"} for o in ("logging", "logger", "log") for m in ("debug", "info", "warning", "error")], "regex": r"\(f['\"]"}, "A log's text is formatted even if it is not shown", "logger.info(f'a {@}')\nlogger.info('a %s', @)\n", [1]),
    ("python", "naive_time", "warning", {"any": _calls("datetime.utcnow", "datetime.utcfromtimestamp", "datetime.datetime.utcnow")}, "A time without its zone", "datetime.utcnow()\ndatetime.now(@)\n", [1]),
    ("python", "loaded_objects", "critical", {"any": _calls("pickle.load", "pickle.loads", "marshal.loads", "shelve.open")}, "Bytes are loaded as any object", "pickle.loads(@)\njson.dumps(@)\n", [1]),
    ("golang", "defer_in_loop", "warning", {"kind": "defer", "inside": {"kind": "loop"}, "not": {"inside": {"kind": "closure"}}}, "Deferred calls pile up in a loop", "func f() {\n  for _, a := range @ {\n    defer a.Close()\n    func() {\n      defer a.Close()\n    }()\n  }\n}\n", [3]),
    ("golang", "kept_lock", "critical", {"kind": "function", "has": {"pattern": "$M.Lock()"}, "not": {"has": {"pattern": "$N.Unlock()"}}}, "A function locks and never unlocks", "func f() {\n  @.Lock()\n}\nfunc g() {\n  @.Lock()\n  defer @.Unlock()\n}\n", [1]),
    ("golang", "dropped_result", "info", {"pattern": "_ = $X"}, "A result is dropped on purpose", "func f() {\n  _ = @(1)\n  a = @(1)\n}\n", [2]),
    ("golang", "endless_request", "warning", {"any": _calls("http.Get", "http.Post", "http.Head", "http.PostForm")}, "The default client has no time limit", "func f() {\n  a, b := http.Get(@)\n  c, d := client.Get(@)\n}\n", [2]),
    ("golang", "timer_in_loop", "warning", {"any": _calls("time.After", "time.Tick"), "inside": {"kind": "loop"}}, "A timer is made in each round", "func f() {\n  for {\n    <-time.After(@)\n  }\n}\nfunc g() {\n  <-time.After(@)\n}\n", [3]),
    ("golang", "late_add", "warning", {"pattern": "$W.Add($X)", "regex": r"^(\w+\.)*wg\.", "inside": {"kind": "closure"}}, "A wait group grows while it is waited for", "func f() {\n  wg.Add(1)\n  go func() {\n    wg.Add(1)\n    @()\n  }()\n}\n", [4]),
    ("golang", "sql_from_parts", "critical", {"any": [{"pattern": f"$D.{m}($$$)"} for m in ("Query", "Exec", "QueryRow", "QueryContext", "ExecContext")], "regex": r"fmt\.Sprintf|\"\+"}, "SQL is put together from values", "func f() {\n  db.Query(fmt.Sprintf(\"a %s\", @))\n  db.Query(\"a ?\", @)\n}\n", [2]),
    ("golang", "library_panic", "warning", {"pattern": "panic($$$)", "not": {"inside": {"regex": r"^func (main|init|Must\w*)\b"}}}, "A function panics instead of failing", "func f() {\n  panic(@)\n}\nfunc main() {\n  panic(@)\n}\n", [2]),
    ("golang", "unverified_peer", "critical", {"regex": "InsecureSkipVerify:true"}, "A peer's certificate is not verified", "func f() {\n  c := &tls.Config{\n    InsecureSkipVerify: true,\n  }\n  @(c)\n}\n", [3]),
    ("rust", "unwrap_outside_tests", "warning", {"pattern": "$X.unwrap()", "not": {"inside": {"regex": r"\bfn test_|mod tests"}}}, "A failure ends the program", "fn go() {\n  @.unwrap();\n}\nfn test_it() {\n  @.unwrap();\n}\n", [2]),
    ("rust", "blocking_in_async", "warning", {"any": _calls("thread::sleep", "std::thread::sleep", "block_on", "$R.block_on"), "inside": {"kind": "async"}, "not": {"inside": {"kind": "closure"}}}, "A blocking call stops the executor", "async fn f() {\n  thread::sleep(@);\n  spawn(|| { thread::sleep(@); });\n}\nfn g() { thread::sleep(@); }\n", [2]),
    ("rust", "unsafe_in_drop", "warning", {"kind": "unsafe", "inside": {"regex": "Drop for"}}, "Unsafe code runs when a value is dropped", "impl Drop for A {\n  fn drop(&mut self) {\n    unsafe { free(self.@) }\n  }\n}\nfn f() { unsafe { free(@) } }\n", [3]),
    ("rust", "ends_program", "warning", {"any": _calls("panic!", "todo!", "unimplemented!"), "not": {"inside": {"regex": r"\bfn test_|mod tests"}}}, "A function ends the program", "fn f() {\n  panic!(\"a\");\n}\nfn test_f() {\n  panic!(\"@\");\n}\n", [2]),
    ("rust", "copy_in_loop", "info", {"any": [{"pattern": "$X.clone()"}, {"pattern": "$X.to_owned()"}], "inside": {"kind": "loop"}}, "A value is copied in each round", "fn f() {\n  for a in b {\n    g(@.clone());\n  }\n  g(@.clone());\n}\n", [3]),
    ("rust", "forgotten_value", "warning", {"any": _calls("mem::forget", "std::mem::forget", "Box::leak")}, "A value is never dropped", "fn f() {\n  mem::forget(@);\n  drop(@);\n}\n", [2]),
    ("rust", "reinterpreted_bytes", "critical", {"any": _calls("mem::transmute", "std::mem::transmute", "mem::zeroed", "mem::uninitialized")}, "Bytes are taken for another type", "fn f() {\n  unsafe { mem::transmute(@) };\n  g(@);\n}\n", [2]),
    ("java", "unmanaged_stream", "warning", {"any": [{"pattern": f"new {n}($$$)"} for n in ("FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "Socket")], "not": {"inside": {"kind": "try"}}}, "A stream is opened outside of try", "void f() {\n  x = new FileInputStream(@);\n  try (InputStream y = new FileInputStream(@)) { g(); }\n}\n", [2]),
    ("java", "silent_catch", "warning", _SILENT, "A failure is caught and passed over", "void f() {\n  try {\n    @();\n  } catch (Exception e) {\n  }\n  try { @(); } catch (Exception e) { log(e); }\n}\n", [4]),
    ("java", "catches_all", "info", {"kind": "catch", "regex": r"catch\((final )?(Throwable|Exception) "}, "A handler catches everything", "void f() {\n  try {\n    @();\n  } catch (Throwable t) {\n    g();\n  }\n  try { @(); } catch (IOException e) { g(); }\n}\n", [4]),
    ("java", "compared_texts", "warning", {"regex": r"[!=]= ?\""}, "Texts are compared by identity", "void f() {\n  if (@ == \"a\") {\n    g();\n  }\n  if (\"a\".equals(@)) {\n    g();\n  }\n}\n", [2]),
    ("java", "thread_run_here", "warning", {"pattern": "$T.run()", "regex": r"[tT]hread\w*\.run\("}, "A thread's work is done by the caller", "void f() {\n  thread.run();\n  @.run();\n}\n", [2]),
    ("java", "finally_returns", "warning", {"kind": "return", "inside": {"kind": "finally"}}, "A return in finally hides failures", "int f() {\n  try {\n    @();\n  } finally {\n    return 1;\n  }\n}\n", [5]),
    ("java", "unchecked_optional", "warning", {"pattern": "$O.get()", "regex": r"\b[oO]pt\w*\.get\(", "not": {"inside": {"regex": r"isPresent|isEmpty"}}}, "An optional is read unchecked", "void f() {\n  g(opt.get());\n  if (opt.isPresent()) {\n    g(opt.get(), @);\n  }\n}\n", [2]),
    ("java", "printed_trace", "info", {"pattern": "$E.printStackTrace()"}, "A failure goes to the console", "void f() {\n  e.printStackTrace();\n  log(@);\n}\n", [2]),
    ("java", "sql_from_parts", "critical", {"any": [{"pattern": f"$S.{m}($$$)"} for m in ("executeQuery", "executeUpdate", "execute")], "regex": r"\+"}, "SQL is put together from values", "void f() {\n  st.executeQuery(\"a\" + @);\n  st.executeQuery(\"a\");\n}\n", [2]),
    ("csharp", "undisposed_connection", "warning", {"any": [{"pattern": f"new {n}($$$)"} for n in ("SqlConnection", "FileStream", "StreamReader", "StreamWriter")], "not": {"inside": {"any": [{"kind": "with"}, {"regex": r"^using "}]}}}, "A disposable object has no using", "void F() {\n  var a = new SqlConnection(@);\n  using (var b = new SqlConnection(@)) { G(); }\n}\n", [2]),
    ("csharp", "async_void", "warning", {"kind": "function", "regex": r"\basync void\b"}, "Failures of the method cannot be caught", "class A {\n  public async void F() {\n    await @();\n  }\n  public async Task G() {\n    await @();\n  }\n}\n", [2]),
    ("csharp", "blocking_in_async", "warning", {"regex": r"\.Result\b|\.Wait\(\)", "inside": {"kind": "async"}}, "A blocking wait in asynchronous code", "class A {\n  public async Task F() {\n    var a = @.Result;\n  }\n  public int G() {\n    return @.Result;\n  }\n}\n", [3]),
    ("csharp", "shared_lock", "warning", {"regex": r"^lock\((this|typeof\()"}, "Others can take the lock", "void F() {\n  lock (this) {\n    G();\n  }\n  lock (@) {\n    G();\n  }\n}\n", [2]),
    ("csharp", "lost_trace", "warning", {"kind": "throw", "regex": r"^throw \w+$", "inside": {"kind": "catch"}}, "A failure is thrown anew without its trace", "void F() {\n  try {\n    @();\n  } catch (E e) {\n    throw e;\n  }\n}\n", [5]),
    ("csharp", "silent_catch", "warning", _SILENT, "A failure is caught and passed over", "void F() {\n  try {\n    @();\n  } catch (E e) {\n  }\n}\n", [4]),
    ("cpp", "throwing_destructor", "critical", {"kind": "throw", "inside": {"regex": r"~\w+\("}}, "A destructor throws", "A::~A() {\n  throw @;\n}\nvoid f() {\n  throw @;\n}\n", [2]),
    ("cpp", "kept_memory", "warning", {"kind": "function", "has": {"any": _calls("malloc", "calloc")}, "not": {"has": {"any": [*_calls("free"), {"kind": "return"}]}}}, "A function takes memory and gives none back", "void f() {\n  p = malloc(@);\n}\nvoid g() {\n  p = malloc(@);\n  free(p);\n}\n", [1]),
    ("cpp", "own_deletion", "critical", {"regex": r"^delete this$"}, "An object deletes itself", "void f() {\n  delete this;\n  delete @;\n}\n", [2]),
    ("cpp", "copied_failure", "warning", {"kind": "catch", "regex": r"catch\((?!.*&)(?!\.\.\.)"}, "A failure is caught by value", "void f() {\n  try {\n    @();\n  } catch (std::exception e) {\n    g();\n  }\n  try { @(); } catch (const std::exception& e) { g(); }\n}\n", [4]),
    ("cpp", "shell_command", "critical", {"any": _calls("system", "popen")}, "A command goes through a shell", "void f() {\n  system(@);\n  g(@);\n}\n", [2]),
    ("cpp", "unbounded_copy", "critical", {"any": _calls("strcpy", "strcat", "sprintf", "gets", "vsprintf")}, "A copy without a bound", "void f() {\n  strcpy(a, @);\n  strncpy(a, @, 3);\n}\n", [2]),
    ("cpp", "new_in_loop", "info", {"pattern": "new $T($$$)", "inside": {"kind": "loop"}}, "Memory is taken in each round", "void f() {\n  while (a) {\n    b = new C(@);\n  }\n  b = new C(@);\n}\n", [3]),
    ("ruby", "sleeping_loop", "info", {"pattern": "sleep($X)", "inside": {"kind": "loop"}}, "A loop waits by sleeping", "while a\n  sleep(@)\nend\nsleep(@)\n", [2]),
    ("ruby", "run_text", "critical", {"any": _calls("eval", "instance_eval", "class_eval", "$O.instance_eval")}, "A text is run", "eval(@)\nputs(@)\n", [1]),
    ("ruby", "command_from_parts", "critical", {"any": _calls("system", "exec", "spawn", "IO.popen"), "regex": r"#\{"}, "A command is put together", "system(\"ls #{a}\")\nsystem(\"ls\", @)\n", [1]),
    ("elixir", "made_atom", "warning", {"pattern": "String.to_atom($X)"}, "Atoms are made from texts and never freed", "def f(x) do\n  String.to_atom(@)\n  String.to_existing_atom(@)\nend\n", [2]),
    ("elixir", "left_inspection", "info", {"pattern": "IO.inspect($$$)"}, "An inspection was left behind", "def f(x) do\n  IO.inspect(@)\n  g(@)\nend\n", [2]),
    ("elixir", "run_text", "critical", {"any": _calls("Code.eval_string", "Code.eval_file", "Code.compile_string")}, "A text is run", "def f(x) do\n  Code.eval_string(@)\n  g(@)\nend\n", [2]),
    ("swift", "waiting_closure", "warning", {"pattern": "$X.wait()", "inside": {"kind": "closure"}}, "A closure waits for another", "queue.async {\n  @.wait()\n}\n@.wait()\n", [2]),
    ("swift", "forced_try", "warning", {"regex": r"\btry!"}, "A failure ends the program", "let a = try! f(@)\nlet b = try? f(@)\n", [1]),
    ("swift", "ends_program", "info", {"any": _calls("fatalError", "preconditionFailure"), "not": {"inside": {"regex": r"\brequired init"}}}, "A function ends the program", "func f() {\n  fatalError(\"a\")\n}\nfunc g() {\n  h(@)\n}\n", [2]),
    ("swift", "synchronous_main", "warning", {"regex": r"DispatchQueue\.main\.sync\b"}, "The main queue is waited for", "DispatchQueue.main.sync {\n  @()\n}\nDispatchQueue.main.async {\n  @()\n}\n", [1]),
]
_LEVEL = {"critical": "error", "warning": "warning", "info": "info"}
#: Words that a file of a language has if one of its rules can hold: other files are not parsed.
WORDS = {
    "js": r"\.then\(|\bawait\b|JSON\.parse|useEffect|RegExp|jwt|cookie|cors\(|===|fetch|axios|\bcatch\b|\bthrow\b|Promise|forEach|document\.write|setTimeout|setInterval|(?:inner|outer)HTML|\bexec|\bfinally\b",
    "python": r"\bopen\(|json\.load|requests\.|\bdef\s|\bexcept\b|\basync\b|yaml|subprocess|hashlib|mktemp|\bfinally\b|==|\.acquire|\blog|utc|pickle|marshal|shelve",
    "golang": r"\bdefer\b|\.Lock\(|_ =|http\.|time\.(?:After|Tick)|wg\.|Sprintf|\.Query|\.Exec|panic\(|InsecureSkipVerify", "rust": r"\.unwrap\(|sleep|block_on|\bunsafe\b|panic!|todo!|unimplemented!|\.clone\(|to_owned|forget|leak|transmute|zeroed|uninitialized",
    "java": r"\bnew\s|\bcatch\b|==|!=|\.run\(|\bfinally\b|\.get\(|printStackTrace|\.execute", "csharp": r"\bnew\s|\basync\b|\block\b|\bthrow\b|\bcatch\b", "cpp": r"\bthrow\b|malloc|calloc|\bdelete\b|\bcatch\b|system|popen|str(?:cpy|cat)|sprintf|\bgets\b|\bnew\b",
    "ruby": r"\bsleep\b|eval|system|exec|spawn|popen", "elixir": r"to_atom|inspect|Code\.", "swift": r"\.wait\(|try!|fatalError|preconditionFailure|main\.sync",
}


@cache
def tree_rules() -> tuple[SyntaxRule, ...]:
    """All rules, named <language>.tree.<name>."""
    out = []
    for lang, name, severity, rule, title, _, _ in TREES:
        found = syntax_rule({"id": f"{lang}.tree.{name}", "language": lang, "severity": _LEVEL[severity], "message": title, "category": 7 if severity == "critical" else 10, "rule": rule})
        out.append(found)
    return tuple(out)

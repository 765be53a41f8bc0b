"""Options of a scan: what is read, which rules run, what is reported. Driver-side only, never a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

FORMATS = ("text", "json", "jsonl", "sarif", "html", "csv", "markdown", "compact")
SEVERITIES = ("critical", "warning", "info", "good")

#: Directories that are not scanned unless asked for; fixed values.
DEFAULT_IGNORES = (
    "node_modules", "venv", ".venv", "env", ".env", "site-packages", "dist", "build", "vendor", "target", "bin", "obj", ".idea", ".vscode",
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", ".gradle", "DerivedData", "bundler", "gems", "wheels",
)
#: Directories that the checks of one language leave out besides; fixed values.
EXCLUDED: dict[str, tuple[str, ...]] = {
    "js": (".next", "out", ".turbo", ".cache", ".pnpm", ".yarn", ".parcel", ".svelte-kit", ".astro", ".vite", ".expo", "storybook-static"),
    "python": (".tox", ".nox", ".eggs", ".cache", ".ipynb_checkpoints", ".hypothesis", ".pytype"),
    "cpp": ("cmake-build-*", "out", "lib", "_deps", "third_party", "bazel-*"),
    "rust": (".cargo", ".rustup", ".cache"),
    "golang": ("third_party", "Godeps", "out", "tmp", "bazel-*", "_bazel"),
    "java": ("out", ".settings", ".mvn", ".generated"),
    "ruby": (".bundle", "log", "tmp", "pkg", "doc", "storage"),
    "swift": (".build", ".swiftpm", "Pods", "Carthage"),
    "csharp": ("packages", "out", "artifacts", ".vs"),
    "elixir": ("_build", "deps", ".elixir_ls", "cover", "doc", "tmp", "log"),
}
#: File extensions of each language; fixed values.
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "js": ("js", "jsx", "ts", "tsx", "mjs", "cjs"),
    "python": ("py", "pyi", "pyx", "pxd", "pxi", "ipynb"),
    "cpp": ("c", "cc", "cpp", "cxx", "c++", "h", "hh", "hpp", "hxx", "ipp", "tpp"),
    "rust": ("rs",),
    "golang": ("go", "tmpl", "gotmpl", "tpl"),
    "java": ("java", "kt", "kts"),
    "ruby": ("rb", "rake", "ru", "gemspec", "erb"),
    "swift": ("swift", "mm", "m"),
    "csharp": ("cs", "csx"),
    "elixir": ("ex", "exs", "eex", "heex", "leex"),
}
#: Files that name a project's language whatever their extension; fixed values.
MARKERS: dict[str, tuple[str, ...]] = {
    "js": ("package.json", "tsconfig.json"), "python": ("pyproject.toml", "requirements.txt", "setup.py"), "cpp": ("CMakeLists.txt",), "rust": ("Cargo.toml",), "golang": ("go.mod",),
    "java": ("pom.xml", "build.gradle", "build.gradle.kts"), "ruby": ("Gemfile", "Rakefile"), "swift": ("Package.swift",), "csharp": (), "elixir": ("mix.exs",),
}
ALIASES = {"javascript": "js", "typescript": "js", "ts": "js", "py": "python", "c": "cpp", "c++": "cpp", "rs": "rust", "go": "golang", "kotlin": "java", "rb": "ruby", "cs": "csharp", "c#": "csharp", "ex": "elixir"}
#: Category packs: languages that take part, and the categories each is limited to (empty: all); fixed values.
PACKS = {"resource-lifecycle": {"python": (16, 19), "golang": (5, 17), "java": (), "swift": (16, 19), "csharp": ()}}
SUPPRESSION_MARKERS = ("scan:ignore", "scan: disable", "nolint", "noqa")
MAX_FILE_BYTES, MAX_PROJECT_MB = 25 << 20, 1000


def language(name: str) -> str:
    """Normal form of a language's name; unknown names stay as they are."""
    name = name.strip().lower()
    return ALIASES.get(name, name)


def languages(detected: list[str], only: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Detected languages in order, within ``only`` (all if none), without ``exclude``, each once."""
    wanted = {language(x) for x in only or []}
    without = {language(x) for x in exclude or []}
    return [x for x in dict.fromkeys(map(language, detected)) if (not wanted or x in wanted) and x not in without]


@dataclass(frozen=True)
class ScanConfig:
    """One scan request."""

    format: str = "text"
    ci: bool = False
    fail_on_warning: bool = False
    only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignores: tuple[str, ...] = DEFAULT_IGNORES
    excluded: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EXCLUDED))  # directories, by language
    respect_ignore_files: bool = False
    statement_suppression: bool = False
    extensions: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EXTENSIONS))
    skip_categories: dict[str, tuple[int, ...]] = field(default_factory=dict)  # "" holds for all languages
    only_categories: dict[str, tuple[int, ...]] = field(default_factory=dict)
    pack: str | None = None
    rule_globs: tuple[str, ...] = ()
    disabled_globs: tuple[str, ...] = ()
    profile: str | None = None
    min_severity: str = "good"
    markers: tuple[str, ...] = SUPPRESSION_MARKERS
    suppress_previous_line: bool = True
    samples: int = 3
    max_details: int = 250
    max_file_bytes: int = MAX_FILE_BYTES
    max_project_mb: int = MAX_PROJECT_MB
    exclude_tests: bool = False
    allow_empty: bool = False
    max_critical: int = 0
    max_warning: int | None = None

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"format {self.format!r} is none of {', '.join(FORMATS)}")
        if self.min_severity not in SEVERITIES:
            raise ValueError(f"severity {self.min_severity!r} is none of {', '.join(SEVERITIES)}")
        if self.pack is not None and self.pack not in PACKS:
            raise ValueError(f"there is no pack {self.pack!r}")

    @property
    def strict(self) -> bool:
        return self.fail_on_warning or self.profile == "strict"

    def runs(self, lang: str, category: int, rule_id: str) -> bool:
        """Whether a rule is part of this scan."""
        from fnmatch import fnmatchcase

        if self.only and language(lang) not in {language(x) for x in self.only} or language(lang) in {language(x) for x in self.exclude}:
            return False
        if self.pack is not None:
            allowed = PACKS[self.pack].get(lang)
            if allowed is None or allowed and category not in allowed:
                return False
        skip = (*self.skip_categories.get("", ()), *self.skip_categories.get(lang, ()))
        only = self.only_categories.get(lang) or self.only_categories.get("")
        # A loose profile leaves out markers and debugging leftovers, which do not stop a release.
        loose = self.profile == "loose" and (".debt" in rule_id or ".debug" in rule_id)
        named = not self.rule_globs or any(fnmatchcase(rule_id, g) for g in self.rule_globs)
        return not loose and category not in skip and (not only or category in only) and named and not any(fnmatchcase(rule_id, g) for g in self.disabled_globs)

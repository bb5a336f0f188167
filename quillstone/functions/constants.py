"""Fixed values that results depend on."""

# Language of a file by the lower-cased suffix of its name.
LANGUAGE_BY_SUFFIX = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "java": "java", "kt": "kotlin",
    "rb": "ruby", "php": "php", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "sql": "sql", "sh": "shell",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "html": "html", "htm": "html", "css": "css", "scss": "scss", "less": "scss",
    "md": "markdown", "txt": "text", "cfg": "toml", "ini": "toml", "env": "text",
}

# Language of a file by its whole name; these come before the suffix.
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "make"}

# Patterns of paths whose chunks get no vector.
VECTOR_SKIP = (
    r"(^|/)migrations/",
    r"(^|/)fixtures?/",
    r"(^|/)node_modules/",
    r"(^|/)static/vendor/",
    r"\.min\.(js|css)$",
    r"\.(po|mo|map|lock|svg)$",
)

# Words by which a finding speaks of code outside the patch.
EXTERNAL_CLAIMS = (
    "вызыва", "все места", "остальные места", "другие места", "caller", "во всём проекте", "по всему проекту", "нигде больше",
    "принято в проекте", "в остальном коде", "соседн",
)

# Words by which an answer admits that it came to a dead end.
DEAD_ENDS = (
    "не вижу никакого документа", "не вижу документ", "предоставьте документ", "приложите документ", "не нашёл", "не нашел", "не смог найти",
    "не смогла найти", "не найдено", "не удалось найти", "не удалось обнаружить", "нет прямого упоминания", "потребуется искать",
    "потребуется найти", "нужно искать", "мне потребуется", "сузить поиск", "уточните", "did not find", "could not find", "i would need",
    "i need to search", "narrow the search", "please clarify", "no direct mention",
)

# Names that are never the target of a call edge.
BUILTIN_NAMES = (
    "print len range str int float bool list dict set tuple isinstance getattr setattr hasattr super sorted sum min max any all enumerate "
    "zip open type repr format next iter"
).split()

# Words that begin a definition line.
DEFINITION_WORDS = ("def", "class", "func", "function", "struct", "interface", "type")

# Suffixes of documentation files, and languages of documents.
DOCUMENT_SUFFIXES = ("md", "rst", "txt", "adoc")
DOCUMENT_LANGUAGES = ("markdown", "text")

# Severities from the worst down with their ranks, and finding verdicts.
SEVERITY_RANK = {"critical": 3, "major": 2, "minor": 1, "nitpick": 0}
VERDICTS = ("useful", "false_positive", "wontfix")

# States without a way out, and those that may be started again.
TERMINAL_SNAPSHOT = ("ready", "failed", "cancelled")
TERMINAL_RUN = ("completed", "failed", "cancelled")
RESTARTABLE_RUN = ("failed", "cancelled")

# Order of context pieces by origin.
ORIGIN_ORDER = ("changed_symbol", "callee", "caller", "similar")

# Label of files without a known language.
NO_LANGUAGE = "прочее"

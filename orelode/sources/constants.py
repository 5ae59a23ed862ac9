"""Word and name lists that the rules' results depend on."""

VAGUE_SUFFIXES = ("Manager", "Orchestrator", "Handler", "Store", "Repository", "Controller", "Utils", "Info")
PROCESS_WORDS = ("Builder", "Importer", "Exporter", "Validator", "Converter", "Parser", "Reader", "Writer", "Fetcher", "Collector", "Handler", "Manager", "Provider", "Renderer", "Serializer", "Dispatcher", "Processor", "Analyzer", "Scheduler", "Runner", "Executor", "Authenticator")
PATTERN_WORDS = ("Visitor", "Iterator", "Command", "Factory", "Strategy", "Proxy", "Adapter")
SECURITY_WORDS = ("auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "execute")
UNIT_WORDS = ("km", "mile", "m", "cm", "mm", "min", "minute", "sec", "second", "hour", "day", "week", "month", "year", "mph", "kmh", "kg", "watt")
UNIT_CALLS = ("Quantity", "timedelta", "TimeDelta", "Distance")
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "its", "it", "is", "are", "be", "was", "were", "this", "that", "these", "those", "from", "as", "at", "by", "into", "over", "under", "when", "while", "if", "not", "no", "any", "all", "each", "their", "his", "her", "we", "you", "they", "must", "will", "should", "would", "can", "could", "may", "might", "shall")
LOOKUP_CALLS = ("get", "getattr", "setdefault", "pop")
PATCH_METHODS = ("setattr", "setitem", "delattr", "setenv", "delenv")
SKIP_WORDS = ("os.environ", "environ", "getenv", "os.path.exists", "sys.platform")
PATH_METHODS = ("read_text", "write_text", "read_bytes", "write_bytes", "mkdir", "unlink", "rename", "replace", "touch", "rmdir", "iterdir", "glob", "rglob", "exists", "resolve", "symlink_to", "copy")
OS_CALLS = ("remove", "rename", "mkdir", "makedirs", "rmdir", "unlink", "symlink", "link", "replace")
SHUTIL_CALLS = ("copy", "copy2", "move", "rmtree", "copytree")
TEMPFILE_CALLS = ("TemporaryDirectory", "NamedTemporaryFile", "TemporaryFile", "mkdtemp", "mkstemp", "mktemp")
GENERATED_MARKS = ("do not edit", "auto-generated", "autogenerated", "@generated", "generated by", "code generated")
VENDOR_DIRS = ("vendor", "third_party", "thirdparty", "node_modules", "site-packages")
SKIP_DIRS = (".git", ".venv", "venv", "node_modules", "__pycache__", ".ruff_cache", ".pytest_cache", ".mypy_cache", "htmlcov", "dist", "build", "target", ".tox", ".eggs")
LINK_SCHEMES = ("http://", "https://", "#", "mailto:", "tel:", "skill://", "rule://", "agent://", "memory://", "artifact://")
FRAMEWORK_BASES = ("object", "BaseModel", "Protocol", "ABC", "ABCMeta", "NamedTuple", "TypedDict", "Generic", "Enum", "IntEnum", "StrEnum", "Flag", "Exception")
ABSTRACT_DECORATORS = ("abstractmethod", "abstractproperty", "abstractclassmethod", "abstractstaticmethod")
TEST_ONLY_SIGNALS = ("suppression", "type-ignore", "monkeypatch", "skipif", "fakefs", "allow-reason")

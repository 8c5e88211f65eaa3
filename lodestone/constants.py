"""Values that results depend on.  Fixed values: they define the engine's semantics."""

# ranking
BM25_K1, BM25_B = 1.2, 0.75
SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 0.85, 0.15
CONTENT_BOOST, PATH_BOOST, FILENAME_BOOST, SYMBOL_BOOST = 1.0, 1.0, 2.0, 2.0
NORMALISE_EPSILON = 1.1920929e-07
DUPLICATE_COSINE = 0.95
GRAPH_BASE, GRAPH_GAIN = 0.8, 0.2
SYMBOL_HIT_BOOST = 1.1

# access paths
ANN_FROM, BINARY_FROM = 500, 1000
ANN_OVERSAMPLE, BINARY_OVERSAMPLE = 4, 10
PRF_DOCS, PRF_TERMS, PRF_MIN_COUNT, PRF_MIN_LENGTH = 10, 5, 2, 3
DEFAULT_LIMIT = 10
REMOTE_OVERSAMPLE, REMOTE_LEAST = 4, 20

# files and chunks
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_CHUNK_BYTES = 8192
WINDOW_LINES = 400
TARGET_CHUNK_LINES, MAX_CHUNK_LINES = 50, 200
MAX_CONTEXT_ITEMS, MAX_CONTEXT_BYTES = 10, 100
SNIPPET_LINES = 12
SIGNATURE_CHARS = 200

# store
FORMAT_VERSION = 6
VECTOR_DIM = 384
DEBOUNCE_MS = 500
UPSERT_BATCH, UPSERT_LARGE_BATCH, ATTRIBUTE_BYTES = 100, 1000, 3800

#: Stop words of keyword extraction.
STOP_WORDS = (
    "the", "and", "for", "but", "with", "from", "this", "that", "into", "when", "what", "how", "why", "does", "are", "our", "your", "their",
    "then", "where", "located", "find", "show", "get", "can", "will", "should", "would", "could",
)

#: Suffixes in the order in which stemming tries them.
SUFFIXES = (
    "ization", "isation", "ation", "sion", "ion", "ment", "ness", "able", "ible", "ing", "ings", "ier", "ors", "ers", "or", "er", "ed",
    "es", "s",
)

#: Characters that count as one token each.
PUNCTUATION = "()[]{}<>;:,.=+-*/%!&|^~?@#$\\"

#: Extensions of files that are not text.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "svg", "ico", "webp", "avif", "psd", "tiff", "tif", "jxl", "heic", "heif", "jp2", "jpx", "pic",
    "icns", "cur", "raw", "arw", "cr2", "nef", "dng", "mp4", "mov", "avi", "mkv", "webm", "wmv", "flv", "m4v", "mp3", "wav", "flac", "ogg",
    "aac", "m4a", "wma", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "gz", "bz2", "7z", "rar", "tar", "xz", "zst", "exe",
    "dll", "so", "a", "dylib", "bin", "msi", "class", "wasm", "pyc", "pyo", "woff", "woff2", "ttf", "otf", "eot", "glb", "gltf", "obj",
    "fbx", "stl", "blend", "sqlite", "sqlite3", "db", "mdb",
)

#: Paths that ingestion skips.
DEFAULT_IGNORE = (
    ".git", ".git/", ".hg/", ".svn/", "node_modules/", "vendor/", "target/", "dist/", "build/", "out/", ".next/", ".nuxt/", "venv/", "env/",
    ".env/", "__pycache__/", "*.pyc", ".idea/", ".vscode/", ".vs/", "*.swp", "*.swo", "*~", ".DS_Store", ".cache/", ".tmp/", "tmp/",
    "temp/", "*.log", "*.tmp", ".fastembed_cache/", "models/", ".models/", "data/", ".data/", "*.o", "*.so", "*.dylib", "*.dll", "*.exe",
    "*.out", "*.app", "*.class", "*.jar", "*.war", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock",
    "Pipfile.lock", "Gemfile.lock", "*.min.js", "*.min.css", "*.bundle.js", "*-min.js",
)

#: Language label -> extensions, for chunking.
LANGUAGES = {
    "rust": "rs", "python": "py", "javascript": "js jsx", "typescript": "ts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "ruby": "rb", "markdown": "md markdown", "json": "json", "yaml": "yaml yml",
    "toml": "toml", "html": "html htm", "css": "css", "bash": "sh bash",
}
#: The same for the symbol graph.
GRAPH_LANGUAGES = {
    "rust": "rs", "python": "py", "typescript": "ts", "tsx": "tsx", "javascript": "js jsx", "go": "go", "java": "java", "c": "c h",
    "cpp": "cpp cc cxx hpp", "csharp": "cs", "ruby": "rb",
}

#: Path patterns of the file classes, matched without regard to case.
GENERATED_PATHS = [
    r"(^|/)vendor/", r"(^|/)node_modules/", r"(^|/)dist/", r"(^|/)build/", r"(^|/)out/", r"(^|/)target/", r"(^|/)\.next/",
    r"(^|/)\.nuxt/", r"(^|/)coverage/", r"\.gen\.(rs|go|ts|js|py)$", r"\.generated\.", r"_pb2\.py$", r"_pb2_grpc\.py$",
    r"\.pb\.(go|rs|cc|h)$", r"\.graphql\.(ts|js)$", r"(^|/)openapi[-_]?client/", r"(^|/)package-lock\.json$", r"(^|/)yarn\.lock$",
    r"(^|/)Cargo\.lock$", r"(^|/)poetry\.lock$", r"(^|/)Gemfile\.lock$", r"\.min\.(js|css)$", r"\.bundle\.(js|css)$",
]
TEST_PATHS = [
    r"(^|/)tests?/", r"(^|/)specs?/", r"(^|/)__tests__/", r"(^|/)e2e/", r"(^|/)integration[-_]?tests?/",
    r"_test\.(rs|go|py|ts|js|tsx|jsx|rb|ex|exs)$", r"_spec\.(rs|rb|ex|exs)$", r"\.test\.(ts|tsx|js|jsx|mjs|cjs)$",
    r"\.spec\.(ts|tsx|js|jsx|mjs|cjs|scala)$", r"(^|/)test_[^/]*\.py$", r"Test\.(java|kt|scala)$", r"Tests\.(java|kt|scala)$",
    r"Spec\.(java|kt|scala)$", r"(^|/)jest\.config\.", r"(^|/)vitest\.config\.", r"(^|/)pytest\.ini$", r"(^|/)conftest\.py$",
]
DOC_PATHS = [
    r"(^|/)docs?/", r"(^|/)documentation/", r"(^|/)examples?/", r"(^|/)samples?/", r"\.(md|mdx|rst|adoc|txt)$", r"(^|/)readme",
    r"(^|/)changelog", r"(^|/)license", r"(^|/)contributing", r"(^|/)code_of_conduct", r"(^|/)security\.md$", r"(^|/)authors", r"(^|/)history",
]
#: Class -> score factor, in the order in which classes are tried.
FILE_TYPES = {"generated": 0.5, "test": 0.8, "documentation": 0.7, "implementation": 1.0}

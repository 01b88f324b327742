"""Word lists, patterns, thresholds and texts that results depend on.

Nothing here is logic. Patterns use the classes of ``functions.text`` in place of the ASCII-only
shorthands; flags are added where they are used.
"""

from auditframe.functions.text import (
    DIGIT as D,
    ENDS_WORD,
    SPACE as S,
    STARTS_WORD,
    WORD as W,
    WORD_CHARS as WC,
    WORD_EDGE,
)

# --- Fixed values: files and languages ------------------------------------------------------------

LANGUAGE_BY_SUFFIX = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".cs": "C#",
    ".go": "Go",
    ".rs": "Rust",
    ".rb": "Ruby",
    ".php": "PHP",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".r": "R",
    ".m": "MATLAB",
    ".jl": "Julia",
    ".lua": "Lua",
    ".pl": "Perl",
    ".sh": "Shell",
    ".ps1": "PowerShell",
}

REPORT_LANGUAGE_SUFFIXES = {
    "Python": [".py"],
    "JavaScript": [".js", ".jsx"],
    "TypeScript": [".ts", ".tsx"],
    "Java": [".java"],
    "C/C++": [".c", ".cpp", ".cc", ".cxx"],
    "Go": [".go"],
    "Rust": [".rs"],
    "C#": [".cs"],
}

EXCLUDED_PARTS = {
    "python": ["venv", "env", "__pycache__", ".git"],
    "javascript": ["node_modules", ".git", "dist", "build"],
    "go": ["vendor", ".git"],
    "java": ["target", "build", ".git"],
    "census": ["venv", "env", "__pycache__", ".git", "node_modules"],
}

SOURCE_SUFFIXES = {
    "python": [".py"],
    "javascript": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"],
    "go": [".go"],
    "java": [".java"],
}

DOC_NAMES_AT_ROOT = [
    "README", "readme", "DOCUMENTATION", "documentation", "GUIDE", "guide", "MANUAL", "manual", "API", "api",
]
DOC_SUFFIXES_AT_ROOT = ["md", "rst", "txt"]
DOC_DIRECTORIES = ["docs", "doc", "wiki"]
NOT_DOC_SUFFIXES = [".pyc", ".class", ".o", ".so", ".dll", ".exe"]

CORRELATED_SUFFIXES = [".py", ".js", ".java", ".cpp", ".go"]
SECRET_SCAN_SUFFIXES = [".py", ".js", ".ts", ".java", ".env", ".config", ".conf"]
BENCHMARK_NAME_PARTS = ["benchmark", "perf", "performance", "bench"]
CI_PATHS = [".github/workflows", ".gitlab-ci.yml", "Jenkinsfile", ".travis.yml", "azure-pipelines.yml"]

# --- Fixed values: complexity ---------------------------------------------------------------------

COMPLEXITY_BINS = [
    ("A", "A (1-5)", 5),
    ("B", "B (6-10)", 10),
    ("C", "C (11-20)", 20),
    ("D", "D (21-30)", 30),
    ("E", "E (31-40)", 40),
    ("F", "F (41+)", None),
]

# --- Fixed values: history ------------------------------------------------------------------------

COMMIT_CATEGORY_WORDS = {
    "features": ["feat", "feature", "add", "implement", "new"],
    "fixes": ["fix", "bug", "patch", "resolve", "solved"],
    "documentation": ["doc", "docs", "documentation", "readme"],
    "refactoring": ["refactor", "restructure", "reorganize", "cleanup"],
    "tests": ["test", "tests", "testing", "spec"],
    "breaking_changes": ["breaking", "break", "incompatible", "major"],
}
BREAKING_MARK = "!:"
FEATURE_COMMIT_PARTS = ["feat", "feature", "add", "implement"]
SEMVER = rf"^v?{D}+\.{D}+\.{D}+(-[a-zA-Z0-9.-]+)?(\+[a-zA-Z0-9.-]+)?$"

HISTORY_CODE_SUFFIXES = [".py", ".js", ".java", ".go", ".rs", ".cpp", ".c"]
ABANDONED_SUFFIXES = [".py", ".js", ".java", ".go"]
HISTORY_DOC_SUFFIXES = [".md", ".rst", ".txt"]
HISTORY_DOC_NAME_STARTS = ["README", "CHANGELOG"]
HISTORY_DOC_DIRECTORY = "docs"
# Names that make a file a key file: globs over the name, or over the end of the path.
KEY_FILE_GLOBS = [
    "README*", "setup.py", "pyproject.toml", "package.json", "Makefile", "CMakeLists.txt", "*.config.*", "src/main.*",
]

# --- Fixed values: claims -------------------------------------------------------------------------

CLAIM_PATTERNS = {
    "feature": [
        rf"(supports?|provides?|enables?|allows?|implements?|offers?){S}+(.+)",
        rf"(can|will|does){S}+(.+)",
        rf"(feature[s]?|functionality|capability)[:]{S}*(.+)",
    ],
    "performance": [
        rf"(fast|quick|efficient|optimized|performance){S}+(.+)",
        rf"({D}+[x]?{S}*faster|slower){S}+than{S}+(.+)",
        rf"(handles?|processes?|supports?){S}+({D}+{S}*(?:requests?|operations?|items?))",
        rf"(latency|throughput|response time)[:]{S}*(.+)",
    ],
    "security": [
        rf"(secure|encrypted|authenticated|authorized|protected){S}+(.+)",
        rf"(prevents?|blocks?|validates?|sanitizes?){S}+(.+)",
        rf"(vulnerability|threat|attack|exploit){S}+(.+)",
    ],
    "api": [
        rf"(api|endpoint|method|function|class){S}*[:]{S}*(.+)",
        rf"(returns?|accepts?|expects?|requires?){S}+(.+)",
        rf"(parameter[s]?|argument[s]?|input[s]?|output[s]?)[:]{S}*(.+)",
    ],
    "behavior": [
        rf"(always|never|must|should|shall){S}+(.+)",
        rf"(guaranteed|ensures?|maintains?){S}+(.+)",
        rf"(default[s]?{S}+to|behavior[s]?|action[s]?)[:]{S}*(.+)",
    ],
}

CERTAIN_WORDS = ["always", "never", "guaranteed", "must"]
HEDGING_WORDS = ["may", "might", "possibly", "sometimes"]
HIGH_CONFIDENCE = 0.7
CODE_EXAMPLE_CONFIDENCE = 0.8

CODE_BLOCK = rf"(?s)```{W}*\n(.*?)\n```"
# A name can only match from its first character, so looking back spares the tries inside it.
FUNCTION_CALL = rf"{STARTS_WORD}({W}++){S}*+\([^)]*\)"
METHOD_CALL = rf"{STARTS_WORD}({W}++)\.({W}++){S}*+\([^)]*\)"
REFERENCED_CALL = rf"`({W}+\.{W}+|{W}+\(\))`"
REFERENCED_CLASS = rf"`class{S}+({W}+)`|`({W}+){S}+class`"
REFERENCED_FILE = rf"`([/{WC}]+\.{W}+)`"

FEATURE_STOP_WORDS = ["that", "this", "with", "from", "have"]
FEATURE_KEYWORD_LENGTH = 4
FEATURE_KEYWORDS = 3
SECURITY_KEYWORDS = [
    "auth", "encrypt", "decrypt", "validate", "sanitize", "token", "password", "hash", "salt", "verify", "secure",
]

# claim type -> (verification method, whether it can always be verified)
VERIFICATION_METHODS = {
    "api": ("unit_test", True),
    "performance": ("benchmark", True),
    "security": ("security_test", True),
    "feature": ("integration_test", False),
    "behavior": ("property_test", False),
}

# verification method -> (type, priority, text before the number, text after it, approach)
VERIFICATION_ADVICE = {
    "unit_test": (
        "unit_testing", "high", "Write unit tests for ", " API claims",
        "Create test cases that verify each function/method exists and behaves as documented",
    ),
    "benchmark": (
        "performance_testing", "medium", "Create benchmarks for ", " performance claims",
        "Implement performance tests to measure and verify performance claims",
    ),
    "security_test": (
        "security_testing", "high", "Verify ", " security claims",
        "Create security test cases and use security analysis tools",
    ),
    "integration_test": (
        "integration_testing", "medium", "Create integration tests for ", " feature claims",
        "Write end-to-end tests that verify feature functionality",
    ),
}
REVIEW_ADVICE = (
    "documentation_review", "low", "Review ", " claims that couldn't be automatically verified",
    "Manually review these claims and update documentation or add verification methods",
)

# --- Fixed values: secrets and redaction ----------------------------------------------------------

SECRET_PATTERNS = {
    "api_key": rf"(api[_-]?key|apikey){S}*[:=]{S}*['\"]?([a-zA-Z0-9_-]{{20,}})['\"]?",
    "password": rf"(password|passwd|pwd){S}*[:=]{S}*['\"]([^'\"]+)['\"]",
    "token": rf"(token|auth){S}*[:=]{S}*['\"]?([a-zA-Z0-9_-]{{20,}})['\"]?",
    "aws": (
        rf"(aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)"
        rf"{S}*[:=]{S}*['\"]?([a-zA-Z0-9/+=]{{20,}})['\"]?"
    ),
}

# A look-ahead for the first letter rejects most positions cheaply; it never changes a match.
USER_PATH = r"(?iu)/(?:home|Users)/([^/]+)/"
WINDOWS_PATH = r"(?iu)C:\\Users\\([^\\]+)\\"
EMAIL = rf"{WORD_EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{WORD_EDGE}"
IPV4 = rf"(?=[0-9]){STARTS_WORD}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{ENDS_WORD}"
MAC = rf"{STARTS_WORD}(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}{ENDS_WORD}"
ASSIGNED_KEY = (
    rf"(?=[aAtTsSſ])(?iu)(?:api[_-]?key|token|secret)[\"']?{S}*[:=]{S}*"
    rf"[\"']?([a-zA-Z0-9_\-]{{10,}})[\"']?"
)
STANDALONE_SECRET = (
    rf"{STARTS_WORD}(sk-[a-zA-Z0-9_\-]{{10,}}|pk_[a-zA-Z0-9_\-]{{10,}}|[a-zA-Z0-9]{{32,}}){WORD_EDGE}"
)
SSH_KEY = r"ssh-(?:rsa|dss|ed25519) [A-Za-z0-9+/=]+"
AWS_ACCESS_KEY = r"AKIA[0-9A-Z]{16}"
AWS_SECRET = rf"(?iu)((?:aws_secret_access_key|aws_secret_key|secret_key){S}*)={S}*[A-Za-z0-9/+=]{{40}}"
GITHUB_TOKEN = r"gh[ps]_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]+"
URL_CREDENTIALS = r"(?:https?|ftp)://[^:]+:[^@]+@[^/]+"
URL_USER_PART = r"://[^@]+@"
HOST_ASSIGNMENT = (
    rf"(?=[hHmMcC])(?iu)(?:hostname|machine|computer)[\"']?{S}*[:=]{S}*[\"']?([a-zA-Z0-9_\-\.]+)[\"']?"
)

SAFE_IPS = ["127.0.0.1", "0.0.0.0", "255.255.255.255", "8.8.8.8", "1.1.1.1"]
LOCAL_IP_STARTS = ["127.", "192.168.", "10.", "172."]
SAFE_MACS = ["00:00:00:00:00:00", "FF:FF:FF:FF:FF:FF", "00-00-00-00-00-00", "FF-FF-FF-FF-FF-FF"]

# --- Fixed values: tests and tool logs ------------------------------------------------------------

TEST_INDICATORS = {
    ("python", "pytest"): ["pytest.ini", "conftest.py", "test_*.py", "*_test.py"],
    ("python", "unittest"): ["test*.py"],
    ("python", "nose"): ["nose.cfg", ".noserc"],
    ("python", "doctest"): ["*.py"],
    ("javascript", "jest"): ["jest.config.js", "jest.config.json", "package.json"],
    ("javascript", "mocha"): ["mocha.opts", ".mocharc.js", ".mocharc.json"],
    ("javascript", "jasmine"): ["jasmine.json", "spec/"],
    ("javascript", "vitest"): ["vitest.config.js", "vitest.config.ts"],
    ("typescript", "jest"): ["jest.config.ts", "tsconfig.json"],
    ("typescript", "vitest"): ["vitest.config.ts"],
    ("java", "junit"): ["pom.xml", "build.gradle", "src/test/java/"],
    ("java", "gradle"): ["build.gradle", "build.gradle.kts"],
    ("java", "testng"): ["testng.xml"],
    ("csharp", "nunit"): ["*.csproj", "nunit.framework"],
    ("csharp", "xunit"): ["xunit.runner.json"],
    ("csharp", "mstest"): ["*.testsettings"],
    ("go", "gotest"): ["*_test.go", "go.mod"],
    ("go", "ginkgo"): ["*_suite_test.go"],
    ("rust", "cargo"): ["Cargo.toml", "tests/"],
    ("ruby", "rspec"): ["spec/", ".rspec", "spec_helper.rb"],
    ("ruby", "minitest"): ["test/", "test_helper.rb"],
    ("php", "phpunit"): ["phpunit.xml", "phpunit.xml.dist"],
    ("php", "pest"): ["pest.php"],
    ("cpp", "gtest"): ["CMakeLists.txt", "test/", "tests/"],
    ("cpp", "catch2"): ["catch.hpp", "catch2/"],
    ("swift", "xctest"): ["Package.swift", "Tests/"],
    ("kotlin", "junit"): ["build.gradle.kts", "src/test/kotlin/"],
    ("scala", "scalatest"): ["build.sbt", "src/test/scala/"],
}
MANIFEST_LANGUAGES = ["javascript", "typescript"]

COVERAGE_ARTIFACTS = {
    "python": ["coverage.xml", ".coverage", "htmlcov/"],
    "javascript": ["coverage/", "lcov.info", "coverage-final.json"],
    "java": ["target/site/jacoco/", "build/reports/jacoco/"],
    "go": ["coverage.out", "coverage.html"],
    "csharp": ["TestResults/*/coverage.cobertura.xml"],
    "rust": ["tarpaulin-report.xml", "lcov.info"],
}

# framework -> count -> pattern; the first match of each counts.
STDOUT_COUNTS = {
    "pytest": {
        "passed": rf"({D}+) passed",
        "failed": rf"({D}+) failed",
        "skipped": rf"({D}+) skipped",
        "errors": rf"({D}+) error",
    },
    "jest": {
        "passed": rf"Tests:{S}+({D}+) passed",
        "failed": rf"Tests:{S}+({D}+) failed",
        "skipped": rf"Tests:{S}+({D}+) skipped",
        "total": rf"Tests:{S}+({D}+) total",
    },
    "mocha": {
        "passed": rf"({D}+) passing",
        "failed": rf"({D}+) failing",
        "skipped": rf"({D}+) pending",
    },
    "cargo": {
        "passed": rf"test result: ok. ({D}+) passed",
        "failed": rf"({D}+) failed",
        "skipped": rf"({D}+) ignored",
    },
}
GO_PASS_LINE = r"(?m)^[ \t]*--- PASS:"
GO_FAIL_LINE = r"(?m)^[ \t]*--- FAIL:"
KEPT_LOG_CHARACTERS = 5000

# --- Fixed values: report texts -------------------------------------------------------------------

# rule -> (category, priority, recommendation, action); {n} is filled with the rule's number.
REPORT_ADVICE = {
    "no_framework": (
        "Testing", "high",
        "No test framework detected. Implement unit tests to ensure code reliability.",
        "Set up a testing framework appropriate for your language (pytest, jest, JUnit, etc.)",
    ),
    "few_tests": (
        "Testing", "medium",
        "Low test count detected. Increase test coverage.",
        "Write more comprehensive tests covering edge cases and main functionality",
    ),
    "complex_code": (
        "Code Quality", "high",
        "High average code complexity detected.",
        "Refactor complex functions, extract methods, and simplify logic",
    ),
    "no_security": (
        "Security", "high",
        "No security analysis performed.",
        "Run security scanning tools (bandit, gosec, etc.) appropriate for your language",
    ),
    "few_comments": (
        "Documentation", "medium",
        "Many files lack sufficient documentation.",
        "Add docstrings and comments to improve code maintainability",
    ),
    "no_ci": (
        "DevOps", "medium",
        "No CI/CD configuration detected.",
        "Set up continuous integration to automatically run tests and checks",
    ),
    "young": (
        "Maturity", "medium",
        "Repository is only {n} days old - features may be unstable.",
        "Consider the maturity of the codebase when evaluating for production use",
    ),
    "bus_factor": (
        "Sustainability", "high",
        "Low bus factor ({n}) indicates over-reliance on few contributors.",
        "Encourage more contributors and document key knowledge areas",
    ),
    "outdated_docs": (
        "Documentation", "high",
        "{n} documentation files appear outdated compared to code changes.",
        "Review and update documentation to reflect recent code changes",
    ),
}

# rule -> (type, category, message)
INSIGHTS = {
    "young": ("warning", "maturity", "This is a young repository (< 90 days old). Features may be unstable."),
    "fixes": ("warning", "quality", "High ratio of bug fixes to features may indicate quality issues."),
    "breaking": ("warning", "stability", "Multiple breaking changes detected. API may be unstable."),
    "outdated_docs": (
        "warning", "documentation", "Some documentation appears outdated compared to recent code changes.",
    ),
    "bus_factor": (
        "info", "sustainability", "Low bus factor ({n}). Project depends heavily on few contributors.",
    ),
    "churn": (
        "warning", "stability", "Several files have high change frequency, indicating potential instability.",
    ),
}

# issue type -> recommendation
ISSUE_ADVICE = {
    "high_complexity": "Refactor this function to reduce complexity",
    "security_vulnerability": "Review and fix this security vulnerability",
    "hardcoded_secret": (
        "Remove hardcoded secrets and use environment variables or secret management systems"
    ),
    "test_failures": "Fix failing tests to ensure code reliability",
    "type_errors": "Fix type errors to improve code reliability",
    "low_bus_factor": "Encourage knowledge sharing and more contributors",
    "outdated_documentation": "Review and update documentation to match code changes",
}

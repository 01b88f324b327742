from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions import classify, documents
from auditframe.functions.text import basename, has_suffix, may_hold, strip, suffix
from auditframe.operators import claims, correlate, findings


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("o")).first()["o"]


def test_strip_and_suffix(spark):
    assert one(spark, strip(F.col("t")), t="\u2003\x85 a b\xa0\n") == "a b"
    for path, expected in {"a/b.PY": ".PY", "a/.env": "", "x": "", "a.b/c": "", "a/b.tar.gz": ".gz", ".a.b": ".b"}.items():
        assert one(spark, suffix(F.col("t")), t=path) == expected
        assert one(spark, has_suffix(F.col("t"), [".PY", ".gz", ".b"]), t=path) == (expected in (".PY", ".gz", ".b"))
    assert one(spark, basename(F.col("t")), t="a/b/c.py") == "c.py"


def test_may_hold_is_a_superset(spark):
    for text, expected in {"x SUPPORTS y": True, "nothing": False, "\u017fupports": True}.items():
        assert one(spark, may_hold(F.col("t"), ["support"]), t=text) is expected


def test_language(spark):
    for path, expected in {"a.PY": "Python", "x/y.rs": "Rust", "q.unknown": None, ".py": None}.items():
        assert one(spark, classify.language(F.col("t")), t=path) == expected


def test_excluded_parts_are_whole_parts(spark):
    column = classify.in_excluded_directory(F.col("t"), "python")
    assert one(spark, column, t="a/venv/x.py") is True
    assert one(spark, column, t="a/myvenv/x.py") is False
    assert one(spark, column, t="environment/x.py") is False


def test_documentation_names(spark):
    expected = {
        "README": True, "readme.pdf": True, "sub/README.md": False, "notes.md": True, "docs/x": True,
        "a/docs/x.png": True, "docs/a/x.py": False, "api_client.py": True, "docs/x.so": False, "src/x.py": False,
    }
    for path, is_doc in expected.items():
        assert one(spark, classify.is_documentation(F.col("t")), t=path) is is_doc, path


def test_line_counts(spark, files):
    text = "# c\n\nx = 1\n  # d\ny\n"
    row = files({"a.py": text, "b.go": "// x\n\ncode\n", "c.js": "// x\n\ncode\n", "e.py": ""}).select(
        "path", classify.line_counts(F.col("path"), F.col("text")).alias("n")
    )
    counts = {r["path"]: r["n"] for r in row.collect()}
    assert (counts["a.py"]["loc"], counts["a.py"]["comments"], counts["a.py"]["blank"]) == (5, 2, 1)
    assert counts["b.go"]["loc"] == 1
    assert counts["c.js"]["loc"] == 2
    assert counts["e.py"]["loc"] == 0


def units(spark, function, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.inline(function(F.col("t"))))
    return [(r["line_number"], r["text"], r["context"]) for r in df.collect()]


def test_text_units(spark):
    assert units(spark, documents.text_units, "a\n\n  \nb") == [(1, "a", "General"), (4, "b", "General")]


def brute_rst(text):
    lines, section, out = text.split("\n"), "General", []
    for i, line in enumerate(lines):
        following = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if following and set(following) <= set("=-~"):
            section = line.strip()
        elif line.strip():
            out.append((i + 1, line, section))
    return out


def test_rst_units_against_brute_force(spark):
    texts = [
        "Intro\nTitle\n=====\nbody\n\nSub\n ~~~ \nmore",
        "Title\n---\n---\nx",
        "a\n\n===\nb\n-=~\n",
        "===\nT\n===\n12:x\n",
        "",
        "only",
    ]
    for text in texts:
        assert units(spark, documents.rst_units, text) == brute_rst(text), text


def test_markdown_units(spark):
    text = "Intro\n# One ##\n\n* **Bold** `x`\n2. two\n#### deep\n###### deeper\n#no space\n### Three\ny: 1"
    assert units(spark, documents.markdown_units, text) == [
        (0, "Intro", "General"), (0, "Bold x", "One"), (0, "two", "One"), (0, "#no space", "One"), (0, "y: 1", "Three"),
    ]


def test_html_units(spark):
    html = "<h1>A &amp; B</h1><p>x <b>y</b></p><ul><li><p>n</p></li></ul><h2 class=x>C</h2><code>q</code><H3>open"
    assert units(spark, documents.html_units, html) == [(0, "x y", "A & B"), (0, "n", "A & B"), (0, "q", "C")]


def test_docstrings(project):
    found = {(r["line_number"], r["text"].split("\n")[0]) for r in claims.docstrings(project.filter("path = 'main.py'")).collect()}
    assert found == {(0, "Main module for a sample."), (3, "Sum two numbers."), (13, "A calculator.")}


def test_claims_of_a_project(project):
    rows = {(r["source"], r["claim_type"], r["text"]): r["confidence"] for r in claims.all_claims(project).collect()}
    assert round(rows[("text", "performance", "calculations: Can handle up to 1000 operations per second")], 6) == 0.65
    assert ("text", "feature", "handle up to 1000 operations per second") in rows
    assert ("docstring", "behavior", "returns the right sum.") in rows
    assert rows[("example", "api", "Function 'total' exists and can be called")] == 0.8
    assert rows[("example", "api", "Object 'obj' has method 'process'")] == 0.8


def test_claim_confidence(spark):
    def score(text, kind):
        return round(one(spark, classify.claim_confidence(F.col("t"), F.lit(kind)), t=text), 6)

    assert score("it always works", "feature") == 0.7
    assert score("it may fail", "feature") == 0.3
    assert score("the mayor", "behavior") == 0.3
    assert score("always 5 x", "api") == 0.9
    assert score("3", "performance") == 0.65


def test_references_keep_double_counts(project):
    refs = [r["ref"] for r in claims.code_references(project).orderBy("ord").collect()]
    assert refs == ["a.b", "run()", "Foo", "a.b", "docs/x.md"]


def test_tokens(spark):
    assert one(spark, documents.api_words(F.col("t")), t="señal grüße a_1 x") == ["señal", "grüße", "a_1", "x"]
    assert one(spark, documents.feature_keywords(F.col("t")), t="with Señal AND this grüße plus more") == [
        "señal", "grüße", "plus",
    ]


def test_commit_categories(spark):
    messages = [
        "feat: add new feature", "fix: resolve bug in parser", "docs: update README", "refactor: restructure modules",
        "test: add unit tests", "feat!: breaking change in API",
    ]
    df = spark.createDataFrame([(m,) for m in messages], "subject string")
    flags = classify.commit_categories(F.col("subject"))
    counts = df.agg(*[F.count_if(f).alias(n) for n, f in flags.items()]).first().asDict()
    assert counts == {
        "features": 3, "fixes": 1, "documentation": 1, "refactoring": 1, "tests": 1, "breaking_changes": 1,
    }


def test_lint(project):
    found = {(r["line"], r["kind"]) for r in findings.lint_lines(project.filter("path = 'main.py'")).collect()}
    assert found == {(10, "too_many_arguments"), (10, "missing_docstring"), (16, "missing_docstring"), (19, "bare_except")}


def test_lint_counts_plain_arguments(spark, files):
    text = (
        "def f(a, b=(1, 2), c: Dict[str, int] = {}, *, d, e, g, h):\n    'doc'\n"
        "def g(p, q, /, a, b, c, d, e, g=','):\n    'doc'\n"
        "async def h(a, b, c, d, e, f):\n    pass\n"
        "def i(): return 1\n"
    )
    found = [(r["line"], r["kind"], r["message"]) for r in findings.lint_lines(files({"x.py": text})).collect()]
    assert found == [(3, "too_many_arguments", "Function 'g' has 6 arguments (max recommended: 5)")]


def test_secret_findings(files):
    text = 'API_KEY = "sk-1234567890abcdef1234567890abcdef"\npassword = "admin123"\n'
    found = {(r["path"], r["kind"], r["matches"]) for r in findings.secret_findings(files({"a.py": text, "b.md": text})).collect()}
    assert found == {("a.py", "api_key", 1), ("a.py", "password", 1)}


def test_symbols(files):
    df = files({"a.py": "def f (x):\nclass C:\nclass D(E):\ndef f():", "b.ts": "function g(){}\nclass H {", "c.go": "func x()"})
    found = {(r["path"], r["symbol"]) for r in correlate.symbols(df).collect()}
    assert found == {("a.py", "f"), ("a.py", "C"), ("a.py", "D"), ("b.ts", "g"), ("b.ts", "H")}


def test_positional_arguments_at_any_depth(spark):
    from auditframe.functions.code import _positional_arguments

    cases = {
        "a, b=((((((1, 2), 3), 4), 5), 6), 7), c={'x': [1, (2, [3, {4: 5}])]}, d=','": 4,
        "a, b: dict[str, tuple[int, list[int]]] = {}": 2,
        "": 0,
        "a, /, b, *, c": 1,
    }
    for signature, expected in cases.items():
        assert one(spark, _positional_arguments(F.col("t")), t=signature) == expected, signature

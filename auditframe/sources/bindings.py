"""The given tables as the engine's logical tables.

The views are plain SQL that Spark and any ANSI engine read alike; ``{name}`` stands for a given table.
A third of all rows belongs to repository ``src0``, so that every query meets a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditframe.session import deal, pin_utc, spread

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Tables whose rows are long texts: their patterns cost more than moving the rows.
TEXT_TABLES = ("documents", "pages", "conversations")

# Tables of short rows that views make texts of, a row's patterns costing thousands of times its reading.
SEED_TABLES = ("part",)


def _repo(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'src0' ELSE concat('src', CAST({key} % 20 AS STRING)) END"


_SUFFIX = (
    "CASE l_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.js' WHEN 3 THEN '.md' ELSE '.java' END"
)

VIEWS = {
    "files": """
        SELECT source AS repo_id,
               concat(source, CASE WHEN doc_id % 7 = 0 THEN '/docs/README'
                                   WHEN doc_id % 11 = 0 THEN '/build/d' ELSE '/src/d' END,
                      CAST(doc_id AS STRING),
                      CASE WHEN doc_id % 7 = 0 THEN '.md' WHEN lang = 'en' THEN '.py' WHEN lang = 'fr' THEN '.js'
                           WHEN lang = 'de' THEN '.go' ELSE '.java' END) AS path,
               text
        FROM {documents}""",
    "commits": f"""
        SELECT {_repo('event_id')} AS repo_id, CAST(event_id AS STRING) AS hash,
               CAST(ts AS TIMESTAMP) AS ts, concat('u', CAST(user_id % 10 AS STRING)) AS author,
               CASE event_type WHEN 'signup' THEN 'feat: add signup flow' WHEN 'error' THEN 'fix: resolve crash'
                    WHEN 'click' THEN 'docs: update readme' WHEN 'view' THEN 'refactor: cleanup view'
                    ELSE 'test: spec for breaking change' END AS subject
        FROM {{events}}""",
    "commit_files": f"""
        SELECT {_repo('l_orderkey')} AS repo_id, CAST(l_orderkey AS STRING) AS hash,
               CAST(l_shipdate AS TIMESTAMP) AS ts, o_orderpriority AS author,
               CASE WHEN l_partkey % 50 = 7 THEN concat('lib', CAST(l_partkey % 400 AS STRING), '/README.md')
                    WHEN l_partkey % 50 = 8 THEN concat('app', CAST(l_partkey % 400 AS STRING), '/package.json')
                    ELSE concat('src/p', CAST(l_partkey AS STRING), {_SUFFIX}) END AS path,
               CASE WHEN l_linenumber = 1 THEN 'A' ELSE 'M' END AS change
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "tags": f"""
        SELECT {_repo('p_partkey')} AS repo_id,
               CASE WHEN p_partkey % 9 = 0 THEN concat('release-', CAST(p_size AS STRING))
                    ELSE concat('v', CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.',
                                CAST(p_partkey % 7 AS STRING)) END AS tag,
               CAST(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INT) AS TIMESTAMP) AS ts,
               p_name AS message
        FROM {{part}}""",
    "function_metrics": f"""
        SELECT {_repo('l_orderkey')} AS repo_id,
               concat('src/f', CAST(l_orderkey % 997 AS STRING), '.py') AS path,
               concat('fn', CAST(l_partkey AS STRING)) AS name,
               l_linenumber AS lineno, CAST(l_quantity AS INT) AS complexity
        FROM {{lineitem}}""",
    "claim_lines": f"""
        SELECT {_repo('p_partkey')} AS repo_id, p_partkey AS claim_id,
               CASE p_partkey % 6 WHEN 0 THEN concat('Supports ', p_name, ' exports')
                    WHEN 1 THEN concat('Handles ', CAST(p_size * 100 AS STRING), ' requests for ', p_name)
                    WHEN 2 THEN concat('Prevents token reuse, may validate ', p_name)
                    WHEN 3 THEN concat('Returns the ', p_name, ' value')
                    WHEN 4 THEN concat('It must always keep ', p_name)
                    ELSE concat('A plain sentence about ', p_name) END AS text
        FROM {{part}}""",
    # Source files with definitions in three languages, one per supplier and part brand.
    "code_files": f"""
        SELECT {_repo('p_partkey')} AS repo_id,
               concat('src/m', CAST(p_partkey AS STRING),
                      CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' ELSE '.md' END) AS path,
               CASE p_partkey % 4
                    WHEN 1 THEN concat('function ', substr(p_name, 1, position(' ' IN p_name) - 1), ' (a) ', chr(123),
                                       ' return a; ', chr(125), chr(10), 'class ',
                                       substr(p_name, position(' ' IN p_name) + 1), ' ', chr(123), ' ', chr(125))
                    ELSE concat('def ', substr(p_name, 1, position(' ' IN p_name) - 1), '(a, b):', chr(10),
                                '    return a + b', chr(10), 'class ',
                                substr(p_name, position(' ' IN p_name) + 1), ':', chr(10), '    encrypted = True') END
                    AS text
        FROM {{part}}""",
    "test_runs": f"""
        SELECT {_repo('l_orderkey')} AS repo_id, l_orderkey AS run_id, l_linenumber AS run_part,
               CASE l_linenumber % 4 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' ELSE 'go' END
                   AS language,
               CASE l_linenumber % 4 WHEN 0 THEN 'jest' WHEN 1 THEN 'pytest' WHEN 2 THEN 'cargo' ELSE 'gotest' END
                   AS framework,
               CASE l_linenumber % 4
                    WHEN 0 THEN concat('Tests:       ', CAST(CAST(l_quantity AS INT) AS STRING), ' passed, ',
                                       CAST(CAST(l_quantity AS INT) AS STRING), ' total')
                    WHEN 1 THEN concat('=== ', CAST(CAST(l_quantity AS INT) AS STRING), ' passed, ',
                                       CAST(l_linenumber AS STRING), ' failed, 1 error in 0.5s ===')
                    WHEN 2 THEN concat('test result: ok. ', CAST(CAST(l_quantity AS INT) AS STRING),
                                       ' passed; 0 failed; ', CAST(l_linenumber AS STRING), ' ignored')
                    ELSE concat('--- PASS: TestA (0.00s)', chr(10), '--- PASS: TestB (0.01s)', chr(10),
                                '--- FAIL: Test', CAST(l_partkey AS STRING), ' (0.00s)', chr(10), 'FAIL') END AS stdout
        FROM {{lineitem}}""",
}


# Logs, reports and documents that hold the given values in the shapes of tool output. Braces are doubled.
_PART_REPO = _repo("p_partkey")
_KEY = "CAST(p_partkey AS STRING)"
_SIZE = "CAST(p_size AS STRING)"

VIEWS |= {
    "commit_log_lines": """
        SELECT event_id,
               CASE WHEN event_id % 17 = 5 THEN concat('short|', CAST(event_id AS STRING))
                    ELSE concat('h', CAST(event_id AS STRING), '|', CAST(1700000000 + event_id * 61 AS STRING), '|u',
                                CAST(user_id % 10 AS STRING), '|u@example.org|', event_type, ' | ', props) END AS line
        FROM {events}""",
    "file_log_lines": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'src0' ELSE concat('src', CAST(o_orderkey % 20 AS STRING)) END AS log_id,
               o_orderkey * 10 AS line_no, concat(CAST(900000000 + o_orderkey * 3600 AS STRING), '|') AS line
        FROM {orders}
        UNION ALL
        SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'src0' ELSE concat('src', CAST(l_orderkey % 20 AS STRING)) END AS log_id,
               l_orderkey * 10 + l_linenumber AS line_no,
               CASE WHEN l_linenumber = 7 THEN '' ELSE concat('src/p', CAST(l_partkey AS STRING), '.py') END AS line
        FROM {lineitem}""",
    "lint_reports": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS report_id,
               CASE p_partkey % 10 WHEN 0 THEN 'no report' WHEN 1 THEN ''
                    ELSE concat('[{{{{"type":"convention","path":"src/m', {_KEY}, '.py","line":', {_SIZE},
                                ',"column":0,"symbol":"missing-docstring","message":"Missing ', p_name, '"}}}},',
                                '{{{{"type":"', CASE WHEN p_size > 25 THEN 'error' ELSE 'warning' END,
                                '","path":"src/m', {_KEY}, '.py","line":1,"column":4,"symbol":"', p_type,
                                '","message":"Bad: ', p_brand, '"}}}},{{{{"path":"x.py","line":2}}}}]') END AS report
        FROM {{part}}""",
    "security_reports": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS report_id,
               CASE p_partkey % 10 WHEN 0 THEN '{{{{"results":' WHEN 1 THEN ''
                    ELSE concat('{{{{"metrics":{{{{"n":1}}}},"results":[{{{{"filename":"src/m', {_KEY}, '.py","line_number":',
                                {_SIZE}, ',"issue_severity":"', CASE WHEN p_size > 30 THEN 'HIGH'
                                WHEN p_size > 15 THEN 'MEDIUM' ELSE 'LOW' END,
                                '","issue_confidence":"HIGH","issue_text":"Use of ', p_name,
                                '","test_id":"B1', CAST(p_partkey % 10 AS STRING), '"}}}}]}}}}') END AS report
        FROM {{part}}""",
    "lint_file_reports": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS report_id,
               CASE WHEN p_partkey % 10 = 0 THEN '[' ELSE
                    concat('[{{{{"filePath":"src/m', {_KEY}, '.js","messages":[{{{{"ruleId":"complexity","severity":2,',
                           '"message":"Function has a complexity of ', {_SIZE}, '.","line":', {_SIZE},
                           ',"column":1}}}},{{{{"ruleId":"no-undef","severity":1,"message":"', p_name,
                           ' is not defined","line":2,"column":3}}}}]}}}},{{{{"filePath":"src/n', {_KEY},
                           '.js","messages":[]}}}}]') END AS report
        FROM {{part}}""",
    "json_logs": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS log_id,
               concat('{{{{"code":"SA', {_SIZE}, '","message":"', p_name, '"}}}}', chr(10), 'plain text', chr(10), chr(10),
                      '{{{{"code":"ST', CAST(p_partkey % 7 AS STRING), '","message":"', p_type, '"}}}}') AS stdout
        FROM {{part}}""",
    "type_logs": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS log_id,
               concat('src/m', {_KEY}, '.py:', {_SIZE}, ': error: Incompatible type: ', p_type, chr(10),
                      'Found ', CAST(p_partkey % 5 AS STRING), ' errors', chr(10),
                      'src/n.py:3: note: see ', p_name) AS stdout
        FROM {{part}}""",
    "compiler_logs": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS log_id,
               concat('  src/m', {_KEY}, '.ts(', {_SIZE}, ',1): error TS2304: ', p_name, '  ', chr(10),
                      'no position', chr(10), 'half (open') AS stdout
        FROM {{part}}""",
    "complexity_logs": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS log_id,
               concat({_SIZE}, ' main f', {_KEY}, ' src/m', CAST(p_partkey % 50 AS STRING), '.go:', {_SIZE}, ':1', chr(10),
                      'x main g src/z.go:1:1', chr(10), '3  util  (T).h  src/u', CAST(p_partkey % 9 AS STRING),
                      '.go:2:1') AS stdout
        FROM {{part}}""",
    "test_reports": f"""
        SELECT {_repo('l_orderkey')} AS repo_id, l_orderkey AS run_id, l_linenumber AS run_part,
               CASE l_linenumber % 4 WHEN 0 THEN 'jest' WHEN 1 THEN 'pytest' WHEN 2 THEN 'gotest' ELSE 'mocha' END
                   AS framework,
               CASE l_linenumber % 4
                    WHEN 0 THEN concat('{{{{"numTotalTests":', CAST(CAST(l_quantity AS INT) + 2 AS STRING),
                                       ',"numPassedTests":', CAST(CAST(l_quantity AS INT) AS STRING),
                                       ',"numFailedTests":1,"numPendingTests":1}}}}')
                    WHEN 1 THEN concat('{{{{"summary":{{{{"total":', CAST(CAST(l_quantity AS INT) + 3 AS STRING),
                                       ',"passed":', CAST(CAST(l_quantity AS INT) AS STRING), ',"failed":3}}}}}}}}')
                    WHEN 2 THEN '[{{{{"Action":"run"}}}},{{{{"Action":"pass"}}}},{{{{"Action":"pass"}}}},{{{{"Action":"fail"}}}}]'
                    ELSE '' END AS report,
               concat(CAST(l_linenumber AS STRING), ' passing, 1 failing, 2 pending') AS stdout
        FROM {{lineitem}}""",
    "junit_reports": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS report_id,
               CASE WHEN p_partkey % 2 = 0
                    THEN concat('<testsuite name="', p_name, '" tests="', {_SIZE},
                                '" failures="1" errors="0" skipped="1" time="0.5"><testcase name="t"/></testsuite>')
                    ELSE concat('<testsuites><testsuite name="a" tests="', {_SIZE},
                                '" failures="2"/><testsuite tests="3" errors="1" time="0.25"/></testsuites>') END AS xml
        FROM {{part}}""",
    "manifests": f"""
        SELECT {_PART_REPO} AS repo_id, p_partkey AS manifest_id,
               CASE WHEN p_partkey % 10 = 0 THEN 'broken'
                    ELSE concat('{{{{"devDependencies":{{{{"', CASE p_partkey % 4 WHEN 0 THEN 'jest' WHEN 1 THEN '@types/mocha'
                                WHEN 2 THEN 'vitest' ELSE 'lodash' END, '":"1.', {_SIZE}, '","shared":"dev"}}}},',
                                '"dependencies":{{{{"shared":"', p_brand, '"}}}}}}}}') END AS manifest
        FROM {{part}}""",
    "tool_logs": f"""
        SELECT {_PART_REPO} AS repo_id,
               CASE p_partkey % 6 WHEN 0 THEN 'c_cpp' WHEN 1 THEN 'c_cpp' WHEN 2 THEN 'java' WHEN 3 THEN 'python'
                    ELSE 'rust' END AS language,
               CASE p_partkey % 6 WHEN 0 THEN 'cbmc' WHEN 1 THEN 'frama_c' WHEN 2 THEN 'openjml' WHEN 3 THEN 'crosshair'
                    WHEN 4 THEN 'miri' ELSE 'prusti' END AS tool,
               concat('src/m', {_KEY}) AS path, CAST(p_size % 2 AS INT) AS exit_code,
               CASE p_partkey % 6
                    WHEN 0 THEN concat('CBMC version 5.12', chr(10), 'Parsing ', p_name, chr(10), CASE WHEN p_size > 20
                                       THEN 'VERIFICATION FAILED' ELSE 'VERIFICATION SUCCESSFUL' END, chr(10),
                                       ' assertion at line ', {_SIZE}, ': FAILURE', chr(10), 'done')
                    WHEN 1 THEN concat('[wp] Goal a Proved', chr(10), '[wp] Goal b ', CASE WHEN p_size > 20 THEN 'Proved'
                                       ELSE 'Unknown' END, chr(10), '[wp] Goal c', chr(10), 'Proved: ', {_SIZE}, chr(10),
                                       'Total: 50')
                    WHEN 2 THEN concat('  m', {_KEY}, '.java:3: warning: ', p_name, ' ', chr(10), 'ok', chr(10),
                                       'x: error: ', p_type)
                    WHEN 3 THEN concat('start', chr(10), 'Counterexample found for f', {_KEY}, chr(10), '  inputs: x=',
                                       {_SIZE}, chr(10), '  actual: ', p_name, chr(10), chr(10),
                                       'Counterexample found for g', chr(10), '  inputs: y')
                    ELSE p_name END AS stdout,
               CASE WHEN p_size > 40 THEN 'error: Undefined Behavior: dangling' ELSE p_type END AS stderr
        FROM {{part}}""",
    "markdown_docs": f"""
        SELECT {_PART_REPO} AS repo_id, concat('docs/g', {_KEY}, '.md') AS path,
               concat('Intro ', p_name, ' supports everything.', chr(10), '# Title ', p_type, chr(10), chr(10),
                      '- Always keeps `', p_name, '`', chr(10), '## API', chr(10), 'The `', replace(p_name, ' ', '.'),
                      '` function returns ', {_SIZE}, ' and `class ', replace(p_name, ' ', '_'), '` and `run()`.', chr(10),
                      '```python', chr(10), 'x = ', replace(p_name, ' ', '_'), '(', {_SIZE}, ')', chr(10),
                      'obj.step(1)', chr(10), '```', chr(10), '#### Deep', chr(10), 'Must never fail.') AS text
        FROM {{part}}""",
    # Wrapped paragraphs, underlined headings, nested lists, rules, and code that looks like Markdown.
    "guide_docs": f"""
        SELECT {_PART_REPO} AS repo_id, concat('docs/guide', {_KEY}, '.md') AS path,
               concat('Guide to ', p_name, chr(10), CASE WHEN p_size % 3 = 0 THEN '=====' ELSE '-----' END, chr(10),
                      'It provides', chr(10), '  **', p_type, '** that must', chr(10), 'always work.', chr(10),
                      '- outer ', p_name, chr(10), '  wrapped', chr(10), '  - nested item', chr(10), '    goes on', chr(10),
                      CASE WHEN p_size % 2 = 0 THEN '```sh' ELSE '' END, chr(10), '# no heading in code', chr(10), chr(10),
                      '- never fails: ', {_SIZE}, chr(10), CASE WHEN p_size % 5 = 0 THEN '' ELSE '```' END, chr(10),
                      'After it', chr(10), '***', chr(10), '## Part ', {_KEY}, ' ##', chr(10), '1. one', chr(10), '2) two', chr(10),
                      '---', chr(10), '#### Deep', chr(10), 'It can `', p_brand, '`', chr(10), '   ', chr(10), '===', chr(10),
                      'The end', chr(10), 'is', chr(10), '--') AS text
        FROM {{part}}""",
    "rst_docs": f"""
        SELECT {_PART_REPO} AS repo_id, concat('docs/g', {_KEY}, '.rst') AS path,
               concat('Intro ', p_name, chr(10), 'Title ', p_type, chr(10), '=====', chr(10), chr(10), 'Provides ', {_SIZE},
                      ' things', chr(10), 'Part', chr(10), ' ~~~ ', chr(10), 'It can ', p_name) AS text
        FROM {{part}}""",
    "source_docs": f"""
        SELECT {_PART_REPO} AS repo_id, concat('src/m', {_KEY}, '.py') AS path,
               concat('\"\"\"Module ', p_name, ' supports x.\"\"\"', chr(10), 'def f', {_KEY}, '(a, b, c, d, e',
                      CASE WHEN p_size > 25 THEN ', f=(1, 2)' ELSE ', *, k=1' END, '):', chr(10),
                      CASE WHEN p_size % 2 = 0 THEN '    \"\"\"Returns the size.\"\"\"' ELSE '    x = 1' END, chr(10),
                      '    try:', chr(10), '        pass', chr(10), '    except', CASE WHEN p_size % 3 = 0 THEN ':'
                      ELSE ' ValueError:' END, chr(10), '        pass', chr(10), 'class C', {_KEY}, ':', chr(10), chr(10),
                      '    # comment', chr(10), '    \"\"\"Handles 10 items.\"\"\"', chr(10)) AS text
        FROM {{part}}""",
    # Definitions whose signatures run over several lines, with brackets in comments and strings.
    "signature_files": f"""
        SELECT {_PART_REPO} AS repo_id, concat('src/s', {_KEY}, '.py') AS path,
               concat('def f', {_KEY}, '(', chr(10), '    a, b=(1, 2),  # first (of many', chr(10), '    c=\"x, (y\"',
                      CASE WHEN p_size > 25 THEN ', d=None, e=[], f=0' ELSE ', *, k=1' END, chr(10), ') -> dict[str,', chr(10),
                      '          int]:', chr(10),
                      CASE WHEN p_size % 2 = 0 THEN concat('    \"\"\"Returns ', p_name, '.\"\"\"') ELSE '    return 1' END,
                      chr(10), 'class C', {_KEY}, '(', chr(10), '    Base, metaclass=M', chr(10), '):', chr(10),
                      '    \"\"\"Handles ', {_KEY}, ' items.\"\"\"', chr(10)) AS text
        FROM {{part}}""",
    # Forty packages: what their documentation says, their code (half of them lack what is documented), their tests.
    "package_docs": """
        SELECT concat('pkg', CAST(p_partkey % 40 AS STRING)) AS repo_id, p_partkey AS claim_id,
               CASE WHEN p_partkey % 7 = 3 THEN concat('Supports ', p_name, ' exports')
                    ELSE concat('Returns the ', p_name, ' value') END AS text
        FROM {part}""",
    "package_code": f"""
        SELECT concat('pkg', CAST(p_partkey % 40 AS STRING)) AS repo_id, concat('src/m', {_KEY}, '.py') AS path,
               concat('def ', CASE WHEN p_partkey % 40 < 20 THEN substr(p_name, 1, position(' ' IN p_name) - 1)
                                   ELSE concat('other_', {_KEY}) END, '(a):', chr(10), '    return a') AS text
        FROM {{part}}""",
    "package_tests": f"""
        SELECT concat('pkg', CAST(p_partkey % 40 AS STRING)) AS repo_id, p_partkey AS run_id, 1 AS run_part,
               'python' AS language, 'pytest' AS framework,
               concat('=== ', {_SIZE}, ' passed', CASE WHEN p_partkey % 40 % 4 = 0 THEN ', 2 failed' ELSE '' END,
                      ' in 0.5s ===') AS stdout
        FROM {{part}}""",
    # Names of all kinds of indicator files, one per part.
    "project_files": f"""
        SELECT {_PART_REPO} AS repo_id,
               CASE p_partkey % 25
                    WHEN 0 THEN concat('tests/test_m', {_KEY}, '.py') WHEN 1 THEN 'pytest.ini'
                    WHEN 2 THEN 'jest.config.js' WHEN 3 THEN concat('spec/s', {_KEY}, '.rb') WHEN 4 THEN 'Cargo.toml'
                    WHEN 5 THEN concat('app', {_KEY}, '/coverage.xml')
                    WHEN 6 THEN concat('app', CAST(p_partkey % 40 AS STRING), '/htmlcov/i', {_KEY}, '.html')
                    WHEN 7 THEN concat('.github/workflows/c', {_KEY}, '.yml')
                    WHEN 8 THEN concat('tests/bench_', {_KEY}, '.py') WHEN 9 THEN 'go.mod'
                    WHEN 10 THEN concat('src/test/java/T', {_KEY}, '.java')
                    WHEN 11 THEN concat('TestResults/r', {_KEY}, '/coverage.cobertura.xml') WHEN 12 THEN 'package.json'
                    WHEN 13 THEN concat('lib/m', {_KEY}, '_test.go') WHEN 14 THEN concat('app', {_KEY}, '/README.md')
                    WHEN 15 THEN concat('env/lib', {_KEY}, '.py') WHEN 16 THEN concat('src/perf', {_KEY}, '.cpp')
                    WHEN 17 THEN concat('wiki/p', {_KEY}) WHEN 18 THEN concat('guide', {_KEY}, '.pdf')
                    WHEN 19 THEN concat('docs/sub/p', {_KEY}, '.md') WHEN 20 THEN concat('doc/x', {_KEY}, '.so')
                    WHEN 21 THEN concat('src/v', {_KEY}, '.tsx') WHEN 22 THEN concat('a/b.config.', {_KEY})
                    WHEN 23 THEN concat('web/node_modules/q', {_KEY}, '.js') ELSE concat('lib/L', {_KEY}, '.CPP') END AS path,
               CASE WHEN p_partkey % 25 = 12 THEN '{{{{"devDependencies":{{{{"mocha":"1","@types/jest":"2"}}}}}}}}'
                    ELSE p_name END AS text
        FROM {{part}}""",
}


class Bindings:
    """Lazily built frames over one folder of given tables, each looked up once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin_utc(spark)
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._frames[name] = spread(df) if name in TEXT_TABLES else deal(df) if name in SEED_TABLES else df
        return self._frames[name]

    def sql(self, query: str) -> DataFrame:
        """Run a query whose ``{name}`` marks are given tables."""
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in query}
        return self.spark.sql(query, **used)

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.sql(VIEWS[name])
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def as_ansi(query: str) -> str:
    """The same query over tables registered under their own names."""
    for name in TABLES:
        query = query.replace("{" + name + "}", name)
    return query.replace("{{", "{").replace("}}", "}")



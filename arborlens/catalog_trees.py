"""The operators on three small source trees, and what must come out, written by hand.

TREES holds real manifests, imports in three languages, entry points, links that lead nowhere and files that are no text. The oracles are plain
tables of values: nothing in them is derived from the rules or the operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_registry import query
from .durable import new_path
from .functions import text
from .operators import facts, graph, imports, manifests, metrics, tree, usage
from .plans import analyze
from .sources import repo

TREES: dict[str, dict[str, bytes]] = {
    "web": {
        "package.json": b'{"name": "web", "dependencies": {"react": "18", "pg": "8", "left-pad": "1"}, "devDependencies": {"vite": "5"}, "peerDependencies": {"vue": "3"}, "scripts": {"next": "x"}}',
        "admin/package.json": b'{"dependencies": {"express": "4", "react": "18"}}',
        "broken/package.json": b'{"dependencies": {"koa": "1"}} x',
        "src/index.ts": b"import App from './App'\nimport { api } from \"../lib/api\"\n// import gone from './gone'\nimport react from 'react'\nconst u = require('./util')\n\nconst l = import('./lazy')\n",
        "src/App.tsx": b"import x from './App.css'\nexport default 1\n",
        "src/App.css": b"a {}\n \t\nb {}\n",
        "src/util.js": b"module.exports = 1\n",
        "src/lazy.mjs": b"x\n",
        "src/gone.ts": b"y\n",
        "lib/api/index.js": b"z\n",
        "Dockerfile": b"FROM x\n",
        "docker-compose.yml": b"a: 1\n",
        ".github/workflows/ci.txt": b"on: push\n",
        "k8s/app.yaml": b"b: 1\n",
        "logo.png": b"\x00\x01",
        "bad.py": b"\xff\xfe",
        "node_modules/react/index.js": b"pruned\n",
        "src/build/out.js": b"pruned\n",
    },
    "py": {
        "requirements.txt": b"Flask==2.0\n# django\n\nsqlalchemy>=1 ; x\nfastapi~=1\nRedis [x]\ncelery\n",
        "app.py": b"from .core import run\nfrom ..up import y\nimport os\nfrom flask import Flask\n",
        "pkg/__init__.py": b"",
        "pkg/a.py": b"from .b import x\nfrom ..core import z\nfrom . import c\n# from .d import q\n",
        "pkg/b/__init__.py": b"1\n",
        "core.py": b"from .pkg.a import k\n",
        "stale.py": b"2\n",
        "Makefile": b"all:\n",
    },
    "rs": {
        "Cargo.toml": b'[package]\ntokio = "1"\n[dependencies]\naxum = "0.7"\n"sqlx" = { version = "1" }\n[dependencies.warp]\nwarp = "1"\n[dev-dependencies]\nyew="1"\nserde = "1"\n',
        "go.mod": b"module x\nrequire (\n\tgithub.com/labstack/echo/v4 v4.1\n\tgo.uber.org/fx v1 // github.com/gin-gonic/gin\n)\n",
        "src/main.rs": b"mod a;\npub mod b;\n// mod c;\nmod d { }\nuse tokio::x;\n",
        "src/a.rs": b"1\n2\n",
        "src/b/mod.rs": b"mod deep;\n",
        "src/b/deep.rs": b"4\n",
        "src/c.rs": b"3\n",
        "cmd/main.go": b"package main\n",
        "cmd/other.go": b'package main\nimport "github.com/labstack/echo/v4"\n',
    },
}


def _trees(spark: SparkSession) -> DataFrame:
    rows = [(r, p, c) for r, files in TREES.items() for p, c in files.items()]
    return repo.from_table(spark.createDataFrame(rows, "repo_id string, path string, content binary"))


def _facts(spark: SparkSession) -> DataFrame:
    return facts.facts(_trees(spark))


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


@query(
    _values(
        "repo_id, kind, label",
        "'web', 'framework', 'React'", "'web', 'framework', 'React'", "'web', 'framework', 'Vite'", "'web', 'framework', 'Vue'", "'web', 'framework', 'Express'", "'web', 'database', 'PostgreSQL'",
    )
)
def npm_labels(spark, sf_dir):
    return manifests.npm_labels(_facts(spark))


@query(_values("repo_id, kind, label", "'py', 'framework', 'Flask'", "'py', 'database', 'SQLAlchemy'", "'py', 'database', 'Redis'"))
def pip_labels(spark, sf_dir):
    return manifests.pip_labels(_facts(spark))


@query(_values("repo_id, kind, label", "'rs', 'framework', 'Axum'", "'rs', 'database', 'SQLx'", "'rs', 'framework', 'Yew'"))
def cargo_labels(spark, sf_dir):
    return manifests.cargo_labels(_facts(spark))


@query(_values("repo_id, kind, label", "'rs', 'framework', 'Echo'", "'rs', 'framework', 'Gin'"))
def go_labels(spark, sf_dir):
    return manifests.go_labels(_facts(spark))


@query(
    _values(
        "repo_id, frameworks, databases, infrastructure",
        "'web', 'Express+React+Vite+Vue', 'PostgreSQL', 'Docker+Docker Compose+GitHub Actions+Kubernetes'", "'py', 'Flask', 'Redis+SQLAlchemy', 'Makefile'", "'rs', 'Axum+Echo+Gin+Yew', 'SQLx', ''",
    )
)
def all_label_sets(spark, sf_dir):
    sets = manifests.label_sets(manifests.all_labels(_trees(spark)))
    return sets.select("repo_id", *[F.array_join(c, "+").alias(c) for c in ("frameworks", "databases", "infrastructure")])


_EDGES = (
    "'web', 'src/index.ts', 'src/App.tsx', 1", "'web', 'src/index.ts', 'lib/api/index.js', 2", "'web', 'src/index.ts', 'src/util.js', 3", "'web', 'src/index.ts', 'src/lazy.mjs', 4",
    "'web', 'src/App.tsx', 'src/App.css', 1", "'py', 'app.py', 'core.py', 1", "'py', 'core.py', 'pkg/a.py', 1", "'py', 'pkg/a.py', 'pkg/b/__init__.py', 1", "'py', 'pkg/a.py', 'core.py', 2",
    "'rs', 'src/main.rs', 'src/a.rs', 1", "'rs', 'src/main.rs', 'src/b/mod.rs', 2", "'rs', 'src/b/mod.rs', 'src/b/deep.rs', 1",
)


def _edges(spark: SparkSession) -> DataFrame:
    return imports.edges(_facts(spark), _trees(spark))


def _placed(adjacency: DataFrame) -> DataFrame:
    out = adjacency.select("repo_id", F.col("path").alias("src"), F.posexplode("deps").alias("k", "dst"))
    return out.select("repo_id", "src", "dst", (F.col("k") + 1).alias("place"))


@query(_values("repo_id, src, dst, place", *_EDGES[:5]))
def js_import_edges(spark, sf_dir):
    files = _trees(spark).where("repo_id = 'web'")
    return _placed(imports.adjacency(files.select("repo_id", "path"), imports.edges(files, files)))


@query(_values("repo_id, src, dst, place", *_EDGES[5:9]))
def python_import_edges(spark, sf_dir):
    files = _trees(spark).where("repo_id = 'py'")
    return _placed(imports.adjacency(files.select("repo_id", "path"), imports.edges(files, files)))


@query(_values("repo_id, src, dst, place", *_EDGES[9:]))
def rust_import_edges(spark, sf_dir):
    files = _trees(spark).where("repo_id = 'rs'")
    return _placed(imports.adjacency(files.select("repo_id", "path"), imports.edges(files, files)))


@query(
    _values(
        "line, spec, pos",
        "1, './a', 0", "2, './b', 0", "2, './d', 1", "2, './c', 2", "3, 'x', 0", "4, '', 0", "6, './e', 0", "6, './f', 1", "7, './t', 0",
    )
)
def import_triggers(spark, sf_dir):
    """The three triggers, in their order and not the line's, with each kind of quotes; nothing without quotes or for other triggers."""
    lines = [
        "import a from './a'", "import('./c'); x = require('./d') + y from \"./b\"", "from  'x'", "from ''", "import './plain'; from x; require(y)", "x from './e' from `./f`", "require( './t')",
    ]
    rows = spark.createDataFrame([*enumerate(lines, 1)], "line int, body string")
    return rows.select("line", F.posexplode(imports.specifiers(F.col("body"))).alias("pos", "spec"))


@query(_values("repo_id, path", "'web', 'src/index.ts'", "'web', 'lib/api/index.js'", "'py', 'app.py'", "'rs', 'src/main.rs'", "'rs', 'cmd/main.go'"))
def entry_points(spark, sf_dir):
    return graph.entry_points(_trees(spark).select("repo_id", F.col("path").alias("node"))).withColumnRenamed("node", "path")


@query(
    _values(
        "repo_id, path, place",
        "'web', '.github/workflows/ci.txt', 1", "'web', 'Dockerfile', 2", "'web', 'admin/package.json', 3", "'web', 'bad.py', 4", "'web', 'broken/package.json', 5", "'web', 'docker-compose.yml', 6",
        "'web', 'k8s/app.yaml', 7", "'web', 'logo.png', 8", "'web', 'package.json', 9", "'web', 'src/gone.ts', 10", "'py', 'Makefile', 1", "'py', 'pkg/__init__.py', 2",
        "'py', 'requirements.txt', 3", "'py', 'stale.py', 4", "'rs', 'Cargo.toml', 1", "'rs', 'cmd/other.go', 2", "'rs', 'go.mod', 3", "'rs', 'src/c.rs', 4",
    )
)
def dead_files(spark, sf_dir):
    """In the order of the result's list."""
    rows = analyze.analyze(_trees(spark)).select("repo_id", F.posexplode("dead_code").alias("k", "shown"))
    return rows.select("repo_id", F.expr("substr(shown, 3)").alias("path"), (F.col("k") + 1).alias("place"))


@query(
    _values(
        "framework, repo_id, path",
        "'react', 'web', 'src/index.ts'", "'flask', 'py', 'app.py'", "'tokio', 'rs', 'src/main.rs'", "'echo', 'rs', 'cmd/other.go'",
    )
)
def framework_usage(spark, sf_dir):
    names = ("react", "Flask", "tokio", "echo", "gin", "vite", "nothing")
    return reduce(DataFrame.unionByName, [usage.files_using(_trees(spark), n).select(F.lit(n.lower()).alias("framework"), "repo_id", "path") for n in names])


@query(
    _values(
        "name, language",
        "'x.rs', 'Rust'", "'x.ts', 'TypeScript'", "'x.tsx', 'TypeScript'", "'x.js', 'JavaScript'", "'x.jsx', 'JavaScript'", "'x.mjs', 'JavaScript'", "'x.py', 'Python'", "'x.go', 'Go'",
        "'x.sol', 'Solidity'", "'x.css', 'CSS'", "'x.scss', 'CSS'", "'x.sass', 'CSS'", "'x.html', 'HTML'", "'x.htm', 'HTML'", "'x.toml', 'TOML'", "'x.json', 'JSON'", "'x.yml', 'YAML'",
        "'x.yaml', 'YAML'", "'x.md', 'Markdown'", "'x.markdown', 'Markdown'", "'x.sh', 'Shell'", "'x.bash', 'Shell'", "'x.zsh', 'Shell'", "'A.RS', 'Rust'", "'a.test.Js', 'JavaScript'",
        "'x.bin', NULL", "'Makefile', NULL", "'.py', NULL", "'x.cjs', NULL",
    )
)
def language_table(spark, sf_dir):
    names = "rs ts tsx js jsx mjs py go sol css scss sass html htm toml json yml yaml md markdown sh bash zsh".split()
    rows = spark.createDataFrame([(n,) for n in [*[f"x.{e}" for e in names], "A.RS", "a.test.Js", "x.bin", "Makefile", ".py", "x.cjs"]], "name string")
    return rows.select("name", metrics.language(text.extension(F.col("name"))).alias("language"))


@query(
    _values(
        "line, slash, hash",
        "'// a', TRUE, TRUE", "'/* a', TRUE, TRUE", "'* a', TRUE, TRUE", "'*/', TRUE, TRUE", "'# a', FALSE, TRUE", "'#', FALSE, TRUE", "'#a', FALSE, FALSE", "'#[x]', FALSE, FALSE", "'a // b', FALSE, FALSE",
        "'/ a', FALSE, FALSE", "'', FALSE, FALSE",
    )
)
def comment_tests(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("// a", "/* a", "* a", "*/", "# a", "#", "#a", "#[x]", "a // b", "/ a", "")], "line string")
    return rows.select("line", text.is_slash_comment(F.col("line")).alias("slash"), text.is_usage_comment(F.col("line")).alias("hash"))


@query(
    _values(
        "path, loc",
        "'package.json', 1", "'admin/package.json', 1", "'broken/package.json', 1", "'src/index.ts', 6", "'src/App.tsx', 2", "'src/App.css', 2", "'src/util.js', 1", "'src/lazy.mjs', 1", "'src/gone.ts', 1",
        "'lib/api/index.js', 1", "'Dockerfile', 1", "'docker-compose.yml', 1", "'.github/workflows/ci.txt', 1", "'k8s/app.yaml', 1",
    )
)
def scanned_lines(spark, sf_dir):
    """A tree on disk, scanned and counted: pruned directories, binary and invalid files are left out."""
    root = new_path(spark, "tree")
    for path, content in TREES["web"].items():
        repo.Tree(root).write(path, content)
    return metrics.file_lines(repo.files(spark, root)).select("path", "loc")


@query(
    _values(
        "path, below",
        "'/r/web/src/a.ts', './src/a.ts'", "'/r/web', '/r/web'", "'/r/website/a', '/r/website/a'", "'/other/a', '/other/a'", "'/r/web/.x', './.x'",
    )
)
def relative_paths(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("/r/web/src/a.ts", "/r/web", "/r/website/a", "/other/a", "/r/web/.x")], "path string")
    return rows.select("path", text.relative_to(F.col("path"), "/r/web/").alias("below"))


@query(
    _values(
        "line_no, line",
        "1, '├── pkg/'", "2, '│   ├── b/'", "3, '│   │   └── __init__.py'", "4, '│   ├── __init__.py'", "5, '│   └── a.py'", "6, '├── app.py'", "7, '├── core.py'", "8, '├── Makefile'",
        "9, '├── requirements.txt'", "10, '└── stale.py'",
    )
)
def tree_of_files(spark, sf_dir):
    return tree.tree_lines(_entries(spark, "py")).select("line_no", "line")


@query(_values("line_no, line", "1, '├── cmd/'", "2, '│       …'", "3, '├── src/'", "4, '│       …'", "5, '├── Cargo.toml'", "6, '└── go.mod'"))
def tree_to_a_depth(spark, sf_dir):
    return tree.tree_lines(_entries(spark, "rs"), 1).select("line_no", "line")


def _entries(spark: SparkSession, repo_id: str) -> DataFrame:
    """(repo_id, path, is_dir) of a tree's files and the directories above them."""
    files = _trees(spark).where(F.col("repo_id") == repo_id).select("repo_id", F.split("path", "/").alias("p"))
    every = files.select("repo_id", F.size("p").alias("n"), "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return every.groupBy("repo_id", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("path")).agg(F.max(F.col("k") < F.col("n")).alias("is_dir"))


@query(
    _values(
        "repo_id, project_type, architecture, total_loc, languages",
        "'web', 'Full-stack web application', 'Frontend → API → Database', 19, 'CSS=2,JSON=3,JavaScript=3,TypeScript=9,YAML=2'",
        "'py', 'Python backend service', 'API → Database', 11, 'Python=11'", "'rs', 'Rust backend service', 'API → Database', 23, 'Go=3,Rust=10,TOML=10'",
    )
)
def analysis_of_trees(spark, sf_dir):
    languages = F.array_join(F.transform(F.map_entries("languages"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return analyze.analyze(_trees(spark)).select("repo_id", "project_type", "architecture", "total_loc", languages.alias("languages"))


@query(
    """SELECT 'py' AS repo_id, '{"project_type":"Python backend service","total_loc":11,"languages":{"Python":11},"frameworks":["Flask"],"databases":["Redis","SQLAlchemy"],"""
    """"infrastructure":["Makefile"],"architecture":"API → Database","dead_code":["./Makefile","./pkg/__init__.py","./requirements.txt","./stale.py"],"""
    """"dependency_graph":{"./Makefile":[],"./app.py":["./core.py"],"./core.py":["./pkg/a.py"],"./pkg/__init__.py":[],"./pkg/a.py":["./pkg/b/__init__.py","./core.py"],"""
    """"./pkg/b/__init__.py":[],"./requirements.txt":[],"./stale.py":[]},"file_breakdown":[{"file":"./requirements.txt","loc":6,"language":"Other"},"""
    """{"file":"./app.py","loc":4,"language":"Python"},{"file":"./pkg/a.py","loc":4,"language":"Python"},{"file":"./Makefile","loc":1,"language":"Other"},"""
    """{"file":"./core.py","loc":1,"language":"Python"},{"file":"./pkg/b/__init__.py","loc":1,"language":"Python"},{"file":"./stale.py","loc":1,"language":"Python"},"""
    """{"file":"./pkg/__init__.py","loc":0,"language":"Python"}]}' AS json"""
)
def result_json_of_a_tree(spark, sf_dir):
    return analyze.to_json(analyze.analyze(_trees(spark).where("repo_id = 'py'")))


@query(
    _values(
        "message, said",
        "'remote: not found', 'Repository not found or access denied: U'", "'error 404', 'Repository not found or access denied: U'", "'error 403', 'Repository not found or access denied: U'",
        "'authentication failed', 'Repository not found or access denied: U'", "'could not read Username', 'Repository not found or access denied: U'",
        "'could not resolve host', 'Network error while cloning: could not resolve host'", "'failed to connect', 'Network error while cloning: failed to connect'",
        "'timed out', 'Network error while cloning: timed out'", "'SSL problem', 'Network error while cloning: SSL problem'", "'network down', 'Network error while cloning: network down'",
        "'unsupported URL protocol', 'Invalid repository URL: U'", "'invalid url', 'Invalid repository URL: U'", "'odd', 'Failed to clone repository: odd'",
        "'SSL not found', 'Repository not found or access denied: U'", "'invalid network', 'Network error while cloning: invalid network'",
    )
)
def clone_errors(spark, sf_dir):
    messages = (
        "remote: not found", "error 404", "error 403", "authentication failed", "could not read Username", "could not resolve host", "failed to connect", "timed out", "SSL problem",
        "network down", "unsupported URL protocol", "invalid url", "odd", "SSL not found", "invalid network",
    )
    rows = spark.createDataFrame([(m,) for m in messages], "message string")
    return rows.select("message", text.clone_error(F.col("message"), F.lit("U")).alias("said"))


@query(_values("line_no, line", "1, 'Languages'", "2, '  Python               11  100%'", "3, 'Frameworks'", "4, '  Flask'", "5, 'Databases'", "6, '  Redis,  SQLAlchemy'"))
def stack_report(spark, sf_dir):
    """A text report of one repository: its result is one row, so the driver holds it."""
    from .plans import report

    row = analyze.analyze(_trees(spark).where("repo_id = 'py'")).drop("repo_id").first()
    return spark.createDataFrame([*enumerate(report.stack(row.asDict(recursive=True)).splitlines(), 1)], "line_no int, line string")

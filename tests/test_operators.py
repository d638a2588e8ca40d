"""The operators on small trees and tables, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from arborlens import rules
from arborlens.functions import text
from arborlens.functions.json_keys import section_keys
from arborlens.operators import graph, imports, infer, manifests, metrics, tree, usage
from arborlens.plans import analyze, report
from arborlens.sources import repo


def files(spark, given):
    rows = [("r", p, c if isinstance(c, bytes) else c.encode()) for p, c in given.items()]
    return repo.from_table(spark.createDataFrame(rows, "repo_id string, path string, content binary"))


def values(df, f):
    return [r[0] for r in df.select(f).collect()]


@pytest.mark.parametrize(
    "content, loc",
    [(b"a\n\n  \nb\n\t\nc", 3), (b"\x00\xff\x10A", None), (b"\xf0\x28\x8c\x28", None), (" \n　".encode(), 0), (b"a\r\nb\r\n", 2), (b"a\rb", 1), ("﻿".encode(), 1), (b"", 0)],
)
def test_line_count(spark, content, loc):
    df = spark.createDataFrame([(content,)], "c binary")
    assert values(df, text.line_count(text.text_of(F.col("c")))) == [loc]


def test_names_and_languages(spark):
    given = {"a.rs": "Rust", "b.TSX": "TypeScript", ".bashrc": None, "x.tar.gz": None, "Makefile": None, "n.markdown": "Markdown", "a.b.py": "Python", "z.": None}
    df = spark.createDataFrame([(k,) for k in given], "n string")
    assert values(df, metrics.language(text.extension(F.col("n")))) == [*given.values()]
    assert len(rules.LANGUAGES) == 23 and len(rules.ENTRY_POINTS) == 37 and len(rules.USAGE) == 31


@pytest.mark.parametrize(
    "path, out", [("./a/./b", "a/b"), ("a/../../b", "../b"), ("/x//y/../z", "/x/z"), ("..", ".."), ("a/b/..", "a"), ("", "")]
)
def test_normalize(spark, path, out):
    assert values(spark.createDataFrame([(path,)], "p string"), text.normalize(F.col("p"))) == [out]


def test_language_sums(spark):
    rows = [("r", "a.rs", 100, "Rust"), ("r", "b.rs", 50, "Rust"), ("r", "c.ts", 200, "TypeScript"), ("r", "d.x", 99, None), ("r", "e.py", 0, "Python")]
    df = spark.createDataFrame(rows, "repo_id string, path string, loc bigint, language string")
    assert {r.language: r["loc"] for r in metrics.language_loc(df).collect()} == {"Rust": 150, "TypeScript": 200, "Python": 0}
    assert metrics.total_loc(df).first().total_loc == 350


def labels(spark, given):
    return {(r.kind, r.label) for r in manifests.all_labels(files(spark, given)).collect()}


def test_manifests(spark):
    npm = {"dependencies": {"react": "1", "pg": "2", "left-pad": "0"}, "devDependencies": {"vite": "3"}, "peerDependencies": {"vue": "1"}, "scripts": {"next": "x"}}
    assert labels(spark, {"package.json": json.dumps(npm)}) == {("framework", "React"), ("database", "PostgreSQL"), ("framework", "Vite"), ("framework", "Vue")}
    assert labels(spark, {"package.json": json.dumps(npm) + " x", "a/package.json": '{"dependencies": {"koa": NaN}}', "b/package.json": '{"dependencies": [1]}'}) == set()
    assert labels(spark, {"requirements.txt": "Flask==2.0\n# django\n\nsqlalchemy>=1 ; x\nfastapi~=1\nredis [x]\n"}) == {("framework", "Flask"), ("database", "SQLAlchemy"), ("database", "Redis")}
    cargo = '[package]\ntokio = "1"\n[dependencies]\naxum = "0.7"\n"sqlx" = { version = "1" }\n[dependencies.warp]\nwarp = "1"\n[workspace.dependencies]\nyew="1"\ntonic.workspace = true\n'
    assert labels(spark, {"Cargo.toml": cargo}) == {("framework", "Axum"), ("database", "SQLx"), ("framework", "Yew")}
    assert labels(spark, {"go.mod": "module x\nrequire (\n\tgithub.com/labstack/echo/v4 v4\n\tgo.uber.org/fx v1\n)\n"}) == {("framework", "Echo"), ("framework", "Uber FX")}


def test_infrastructure(spark):
    paths = ["Dockerfile", "a/docker-compose.yml", "Makefile", ".github/workflows/x.txt", "k8s/a.yaml", "b/kubernetes/c.json", "docker-compose.json"]
    assert labels(spark, dict.fromkeys(paths, "")) == {("infrastructure", x) for x in ("Docker", "Docker Compose", "Makefile", "GitHub Actions", "Kubernetes")}
    assert labels(spark, {"kubernetes/c.json": "", "dockerfile": ""}) == set()


def test_usage(spark):
    given = {"a.ts": "import x from 'react'", "b.js": 'const r = require("react")', "c.ts": "// import x from 'react'", "d.py": "from react import x", "e.py": "#from flask\nimport flask", "f.py": "# import flask"}
    own = files(spark, given)
    assert [r.path for r in usage.files_using(own, "React").collect()] == ["a.ts", "b.js"]
    assert [r.path for r in usage.files_using(own, "flask").collect()] == ["e.py"]
    assert usage.files_using(own, "nothing").count() == 0
    rust = files(spark, {"a.rs": "#[tokio::main]", "b.rs": "use actix_web::x;", "c.go": '"github.com/go-chi/chi/v5"'})
    assert [len(usage.files_using(rust, n).collect()) for n in ("tokio", "actix-web", "chi", "gin")] == [1, 1, 1, 0]


IMPORTS = [
    ({"src/a.ts": "import {x} from './b'\nimport y from \"../c\"; const z = require('./d'); import('./e')", "src/b.ts": "", "c/index.js": "", "src/d.js": "", "src/e.mjs": ""}, "src/a.ts", ["src/b.ts", "c/index.js", "src/d.js", "src/e.mjs"]),
    ({"a.ts": "import './b'\n// from './b'\nimport x from 'react'", "b.ts": ""}, "a.ts", []),
    ({"a.ts": "x from './user.service'", "user.service.ts": "", "user.ts": ""}, "a.ts", ["user.ts"]),
    ({"a.ts": "x from './a.js'", "a.js.ts": ""}, "a.ts", ["a.ts"]),
    ({"a.js": "x from './b' ; y from './b.js'", "b.js": ""}, "a.js", ["b.js"]),
    ({"p/q/a.py": "from .b import x\nfrom ..c.d import y\nfrom . import z\nimport os", "p/q/b.py": "", "p/c/d/__init__.py": "", "p/q/z.py": ""}, "p/q/a.py", ["p/q/b.py", "p/c/d/__init__.py"]),
    ({"src/main.rs": "mod a;\npub mod b;\nmod c { }\n// mod d;\npub(crate) mod d;\nmod e; // x", "src/a.rs": "", "src/b/mod.rs": "", "src/d.rs": "", "src/e.rs": ""}, "src/main.rs", ["src/a.rs", "src/b/mod.rs"]),
]


@pytest.mark.parametrize("given, src, deps", IMPORTS)
def test_imports(spark, given, src, deps):
    own = files(spark, given)
    links = imports.edges(own, own.select("repo_id", "path"))
    found = {r.path: r.deps for r in imports.adjacency(own.select("repo_id", "path"), links).collect()}
    assert found == {p: (deps if p == src else []) for p in given}


def test_imports_reach_pruned_directories(spark):
    own = files(spark, {"a.js": "x from './build/b'"})
    listing = spark.createDataFrame([("r", "a.js"), ("r", "build/b.js")], "repo_id string, path string")
    assert [r.dst for r in imports.edges(own, listing).collect()] == ["build/b.js"]


GRAPHS = [
    ("", "", ""), ("main.rs a b", "main.rs>a a>b", ""), ("x y", "", "x y"), ("a b", "a>b", "a b"), ("main.rs index.ts a b c", "main.rs>a index.ts>b", "c"),
    ("main.go a b", "main.go>a a>b b>a", ""), ("main.go a b", "a>b b>a", "a b"), ("main.go a", "main.go>out out>a", "a"), ("app.py app.py", "app.py>app.py", ""),
]


@pytest.mark.parametrize("nodes, edges, dead", GRAPHS)
def test_dead(spark, nodes, edges, dead):
    n = spark.createDataFrame([("r", x) for x in nodes.split()], "repo_id string, path string")
    e = spark.createDataFrame([("r", *x.split(">")) for x in edges.split()], "repo_id string, src string, dst string")
    assert sorted(r.path for r in graph.dead_files(n, e).collect()) == dead.split()


@pytest.mark.parametrize("local", [10**6, 0])
def test_reachability_of_groups(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    edges = [("x", "a", "b"), ("x", "b", "a"), ("x", "b", "c"), ("x", "c", "out"), ("y", "a", "c"), ("y", None, "b"), ("x", "c", None), ("x", "q", "q")]
    nodes = [(k, n) for k in "xyz" for n in "abcd"]
    n, e = spark.createDataFrame(nodes, "k string, node string"), spark.createDataFrame(edges, "k string, src string, dst string")
    found = graph.reachable(n, e, spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "gone"), ("w", "a")], "k string, node string"), ("k",))
    assert sorted(map(tuple, found.collect())) == [("x", "a"), ("x", "b"), ("x", "c"), ("y", "a"), ("y", "c")]
    assert graph.reachable(n.limit(0), e, n.limit(0), ("k",)).count() == 0


@pytest.mark.parametrize("local", [10**6, 0])
def test_reachability_against_plain_search(spark, monkeypatch, local):
    import random

    monkeypatch.setattr(graph, "LOCAL", local)

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, 60)] + [(i, i + 1) for i in range(60, 99)]
    seen, queue = {0}, [0]
    for x in queue:
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                queue.append(b)
    n = spark.createDataFrame([(i,) for i in range(100)], "node bigint")
    found = graph.reachable(n, spark.createDataFrame(edges, "src bigint, dst bigint"), n.where("node = 0"))
    assert sorted(r.node for r in found.collect()) == sorted(seen)


DECISIONS = [
    (["React", "Axum"], ["Redis"], ["Rust"], [], "Full-stack web application", "Frontend → API → Database"),
    (["React", "Axum"], [], [], [], "Full-stack web application (no detected database)", "Frontend → API"),
    (["Vue"], ["Redis"], [], [], "Frontend web application", "Frontend → Database"), (["Vue"], [], ["Solidity"], [], "Blockchain / Smart-contract project", "Frontend only"),
    (["Gin"], ["Redis"], ["Go"], [], "Go backend service", "API → Database"), (["Gin"], [], ["Go"], [], "Backend API service", "API only"),
    (["Flask"], ["Redis"], ["Python", "Go"], [], "Go backend service", "API → Database"), (["Axum"], [], ["Rust"], [], "Rust backend service", "API only"),
    (["Chi"], [], ["Go"], [], "Go application", "Monolithic / undetermined"), ([], [], ["Rust"], ["Docker"], "Rust library / CLI tool", "Monolithic / undetermined"),
    ([], ["Redis"], [], ["Docker"], "Containerised service", "Monolithic / undetermined"), ([], [], [], [], "Unknown / General-purpose project", "Monolithic / undetermined"),
]


@pytest.mark.parametrize("frameworks, databases, languages, infrastructure, project, shape", DECISIONS)
def test_decisions(spark, frameworks, databases, languages, infrastructure, project, shape):
    df = spark.createDataFrame([(frameworks, databases, languages, infrastructure)], "f array<string>, d array<string>, l array<string>, i array<string>")
    given = infer.flags(F.col("f"), F.col("d"), F.col("l"), F.col("i"))
    assert tuple(df.select(infer.project_type(given), infer.architecture(given)).first()) == (project, shape)


def slow_tree(entries, depth):
    out = []

    def show(parent, prefix, left):
        if left == 0:
            out.append(f"{prefix}    …")
            return
        own = sorted(((not d, p.split("/")[-1].lower(), p.split("/")[-1], p, d) for p, d in entries.items() if p.rpartition("/")[0] == parent))
        for k, (_, _, name, path, is_dir) in enumerate(own):
            last = k == len(own) - 1
            out.append(f"{prefix}{'└── ' if last else '├── '}{name}{'/' if is_dir else ''}")
            if is_dir:
                show(path, prefix + ("    " if last else "│   "), left - 1)

    show("", "", depth)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_tree(spark, depth):
    entries = {"src": True, "src/B": True, "src/B/c.rs": False, "src/a.rs": False, "README": False, "empty": True, "docs": True, "docs/x": True, "docs/x/y": True, "docs/x/y/z": False, "A.txt": False}
    df = spark.createDataFrame([("r", p, d) for p, d in entries.items()], "repo_id string, path string, is_dir boolean")
    assert [r.line for r in tree.tree_lines(df, depth).orderBy("line_no").collect()] == slow_tree(entries, depth)


def make(root, given):
    for p, c in given.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(c if isinstance(c, bytes) else c.encode())


WEB = {
    "package.json": '{"dependencies": {"react": "18", "pg": "8"}}', "src/index.ts": "import App from './App'\nApp()\n", "src/App.tsx": "export default 1\n", "src/unused.ts": "x\n",
    "node_modules/react/index.js": "y", ".github/workflows/ci.yml": "on: push\n", "__init__.py": "", "logo.png": b"\x00\x01", "build/x.ts": "",
}


def test_whole_tree(spark, tmp_path):
    make(tmp_path, WEB)
    own = repo.files(spark, str(tmp_path))
    assert sorted(r.path for r in own.select("path").collect()) == sorted(p for p in WEB if not p.startswith(("node_modules", "build")))
    row = analyze.analyze(own, repo.listing(spark, str(tmp_path)))
    r = row.drop("repo_id").first().asDict(recursive=True)
    assert r["frameworks"] == ["React"] and r["databases"] == ["PostgreSQL"] and r["infrastructure"] == ["GitHub Actions"]
    assert r["languages"] == {"TypeScript": 4, "JSON": 1, "YAML": 1, "Python": 0} and r["total_loc"] == 6
    assert r["architecture"] == "Frontend → Database" and r["project_type"] == "Frontend web application"
    assert r["dependency_graph"]["./src/index.ts"] == ["./src/App.tsx"] and len(r["dependency_graph"]) == 7
    assert "./src/unused.ts" in r["dead_code"] and "./src/App.tsx" not in r["dead_code"]
    assert [f["file"] for f in r["file_breakdown"]][0] == "./src/index.ts"
    back = analyze.from_json(analyze.to_json(row)).drop("repo_id").first().asDict(recursive=True)
    assert back == r
    assert json.loads(report.as_json(r, compact=True)) == r and "\n" not in report.as_json(r, compact=True) and "\n" in report.as_json(r)
    assert "Frontend → Database" in report.full(r) and "TOTAL" in report.files(r) and "TypeScript" in report.stack(r) and "unreachable" in report.dead_code(r)


def test_contents_are_read_once(spark, tmp_path, monkeypatch):
    make(tmp_path, WEB)
    plans, plain = [], analyze.stored
    monkeypatch.setattr(analyze, "stored", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, what))
    row = analyze.analyze(repo.files(spark, str(tmp_path)), repo.listing(spark, str(tmp_path)))
    plans.append(row._jdf.queryExecution().optimizedPlan().toString())
    # the facts scan the contents, the edges the listing, which opens no file, and the result nothing
    assert [p.count("RelationV2") for p in plans] == [1, 1, 0]


def test_links_unread_files_and_pushed_conditions(spark, tmp_path, monkeypatch):
    import os

    make(tmp_path, {"a/x.py": "1", "a/package.json": "{}", "b/package.json": "{}", "b/c/y.js": "from './z'", "b/c/d/e/f.py": "2", "target/q.py": "3"})
    os.symlink(tmp_path / "a" / "x.py", tmp_path / "b" / "link.py")
    os.symlink(tmp_path / "a", tmp_path / "b" / "dir_link")
    os.symlink(tmp_path / "none", tmp_path / "b" / "broken")
    for spread in (64, 1):
        monkeypatch.setattr(repo, "SPREAD", spread)
        root = str(tmp_path)
        assert sorted(r.path for r in repo.paths(spark, root).collect()) == ["a/package.json", "a/x.py", "b/c/d/e/f.py", "b/c/y.js", "b/package.json"]
        assert {"b/link.py", "target/q.py"} <= {r.path for r in repo.listing(spark, root).collect()} and repo.listing(spark, root).where("path like '%dir_link%' or path like '%broken'").count() == 0
        shown = {r.path: r.is_dir for r in repo.entries(spark, root).collect()}
        assert shown["b/link.py"] is shown["b/dir_link"] is shown["b/broken"] is False and shown["b/c"] is True and "target" not in shown
    assert repo.files(spark, f"file://{tmp_path}").count() == 5
    opened = repo._Reader({"path": str(tmp_path)})
    left = [*opened.pushFilters([repo.EqualTo(("name",), "package.json"), repo.EqualTo(("length",), 2)])]
    assert len(left) == 1
    rows = [r for p in opened.partitions() for r in opened.read(p)]
    assert sorted(r[1] for r in rows if not r[2]) == ["a/package.json", "b/package.json"]
    assert repo.files(spark, str(tmp_path)).where("name = 'package.json' and ext = 'json'").count() == 2
    monkeypatch.setattr(repo.Tree, "read", lambda self, path: (_ for _ in ()).throw(OSError("no")) if path == "a/x.py" else b"ok")
    own = repo._Reader({"path": str(tmp_path)})
    found = {r[1]: (r[4], r[7]) for p in own.partitions() for r in own.read(p)}
    assert found["a/x.py"] == (None, "no") and found["b/c/y.js"] == (b"ok", None)
    with pytest.raises(FileNotFoundError):
        lost = repo._Reader({"path": str(tmp_path / "nowhere")})
        [*lost.read(repo._Slice([("a", "file", 0, None)], []))]


def test_unread_files_are_nodes_without_edges(spark):
    own = spark.createDataFrame([("r", "main.py", b"from .a import x"), ("r", "a.py", None)], "repo_id string, path string, content binary")
    r = analyze.analyze(repo.from_table(own)).first()
    assert r.dependency_graph == {"./main.py": ["./a.py"], "./a.py": []} and [f.file for f in r.file_breakdown] == ["./main.py"]


def test_empty_and_missing_trees(spark, tmp_path):
    from arborlens import cli

    (tmp_path / "f").write_text("x")
    assert repo.files(spark, str(tmp_path / "none")).count() == 0 and repo.files(spark, str(tmp_path / "f")).count() == 0
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "a.py").write_text("x\n")
    assert repo.files(spark, str(tmp_path / "build")).count() == 1  # the root is never pruned
    (tmp_path / "e").mkdir()
    assert cli.result(spark, str(tmp_path / "e")) == analyze.empty()


def test_cli(spark, tmp_path):
    from arborlens import cli

    make(tmp_path, WEB)

    def out(*argv):
        return cli.run(spark, cli.parser().parse_args([*argv, str(tmp_path)]))

    assert out("scan").startswith("7 files\n") and "React" in out("stack") and out("framework", "react").startswith("No files use react")
    assert out("map", "--depth", "1").splitlines()[0] == f"{tmp_path.name}/" and json.loads(out("json", "--compact"))["total_loc"] == 6
    args = cli.parser().parse_args(["map"])
    assert args.depth == 6 and args.path == "."
    with pytest.raises(ValueError, match="Path not found"):
        repo.resolve_input(str(tmp_path / "nothing"))


def test_git_inputs():
    assert [repo.is_git_url(x) for x in ("http://a", "https://a", "git@a:b", "ssh://a", "./a", "ftp://a")] == [True] * 3 + [False] * 3
    assert repo.clone_error("error 404", "u") == "Repository not found or access denied: u"
    assert repo.clone_error("could not resolve host", "u").startswith("Network error")
    assert repo.clone_error("unsupported URL protocol", "u") == "Invalid repository URL: u"
    assert repo.clone_error("odd", "u") == "Failed to clone repository: odd"


def test_local_clone_is_shallow_and_cleaned(tmp_path, monkeypatch):
    import os
    import subprocess

    make(tmp_path, {"a.py": "x"})
    for cmd in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", *cmd], cwd=tmp_path, check=True)
    monkeypatch.setattr(repo, "is_git_url", lambda s: s.startswith("file://"))
    root, guard = repo.resolve_input(f"file://{tmp_path}")
    assert os.path.exists(f"{root}/a.py")
    guard.cleanup()
    assert not os.path.exists(root)


def test_section_keys(spark):
    df = spark.createDataFrame([('{"a": {"x": 1, "y": 2}, "b": {"x": 3}}',), ("[1]",), (None,), ('{"a": {}} ]',)], "t string")
    assert values(df, section_keys(("a", "b"))("t")) == [["x", "y", "x"], [], [], []]


def test_streaming(spark, tmp_path):
    from arborlens.streaming import files as stream

    src = tmp_path / "in"
    spark.createDataFrame([("r", "a.py", b"x\n\ny"), ("r", "b.rs", b"z")], "repo_id string, path string, content binary").write.parquet(str(src))
    df = spark.readStream.schema("repo_id string, path string, content binary").parquet(str(src))
    q = stream.language_loc(df).writeStream.outputMode("complete").format("memory").queryName("loc").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.language: r["loc"] for r in spark.table("loc").collect()} == {"Python": 2, "Rust": 1}


def test_release(spark):
    from arborlens import durable

    df = durable.stored(spark.range(3), "x")
    assert df.count() == 3
    import os

    place, other = (df._stored_at.removeprefix("file:"), durable.stored(spark.range(2), "y"))
    assert os.path.isdir(place) and durable.shared_dir(spark).startswith("file:/")
    durable.drop(other)
    assert not os.path.exists(other._stored_at.removeprefix("file:"))
    apart = durable.stored(spark.newSession().range(2), "z")
    durable.release(spark)
    assert not os.path.exists(place) and os.path.isdir(apart._stored_at.removeprefix("file:"))


def test_numbers_by_ranges(spark):
    from arborlens.operators import ranks

    rows = spark.createDataFrame([(f"g{i % 3}", (i * 37) % 101) for i in range(300)], "g string, x int").distinct()
    for keys in ((), ("g",)):
        found = [tuple(r) for r in ranks.numbered(rows.repartition(7), [F.desc("x"), F.col("g")], "n", keys).collect()]
        for g in ("g0", "g1", "g2") if keys else (None,):
            own = sorted((-x, k, n) for k, x, n in found if g in (None, k))
            assert [n for _, _, n in own] == [*range(1, len(own) + 1)]
    assert ranks.numbered(rows.limit(0), [F.col("x")], "n").count() == 0

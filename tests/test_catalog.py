"""Every catalog query against its SQL on the smallest tables."""

import os

import pytest

from arborlens import catalog

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(ROOT):
        place = f"{ROOT}/{f}" if os.path.isfile(f"{ROOT}/{f}") else f"{ROOT}/{f}/*.parquet"
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{place}')")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, ROOT)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert rows
    if name in catalog.ORACLES:
        found = duck.sql(catalog.ORACLES[name])
        want = duck.sql(f"SELECT {', '.join(sorted(found.columns))} FROM ({catalog.ORACLES[name]})").fetchall()
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_candidates_meet_all_customers(spark, monkeypatch):
    seen, plain = [], catalog.imports.resolved
    monkeypatch.setattr(catalog.imports, "resolved", lambda statements, listing: seen.append(listing) or plain(statements, listing))
    catalog.QUERIES["candidate_resolution"](spark, ROOT)
    assert seen[0].count() == spark.read.parquet(f"{ROOT}/customer.parquet").count()


def test_entry_misses_only_the_subpackage(tmp_path):
    """Without the subpackage the other queries are there; a module that is missing inside it is an error."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/arborlens", tmp_path / "arborlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(catalog.QUERIES)), "[]"]
    (tmp_path / "arborlens" / "llm").mkdir()
    (tmp_path / "arborlens" / "llm" / "__init__.py").write_text("")
    (tmp_path / "arborlens" / "llm" / "queries.py").write_text("import nothing_of_that_name")
    assert "nothing_of_that_name" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).stderr


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())

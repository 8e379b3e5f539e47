"""Every analytics query against its SQL, and the contract of __spark_entry__.py with and without the corpus subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from modaleda import catalog

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"


def same(rows):
    def plain(v):
        if isinstance(v, float):
            return None if v != v else f"{v:.8g}".replace("-0", "0") if v == 0 else f"{v:.8g}"
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def db():
    d = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        d.execute(f"create view {p.stem} as select * from '{p}'")
    return d


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query_agrees_with_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert same(got.collect()) == same(db.execute(f"select {columns} from ({catalog.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", [q for q in catalog.QUERIES if q not in catalog.ORACLE_SQL])
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).limit(50).collect()


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    for p in ROOT.glob("*.py"):
        if p.name != "corpus_pipeline.py":
            shutil.copy(p, tmp_path)
    shutil.copytree(ROOT / "modaleda", tmp_path / "modaleda", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "modaleda").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p

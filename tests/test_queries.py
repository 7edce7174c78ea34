"""Registered queries against their DuckDB SQL on the smallest tables, and the entry without the optional parts."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from lathework.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_packed_bins_hold_everything_once(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    bins = [r["members"].split(",") for r in registry.queries()["pack_ffd"](spark, DATA).collect()]
    members = [int(i) for b in bins for i in b]
    assert sorted(members) == sorted(r["doc_id"] for r in registry.table(spark, DATA, "documents").select("doc_id").collect())


def test_entry_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py",):
        if name.endswith(".py"):
            (tmp_path / name).symlink_to(REPO / name)
    (tmp_path / "lathework").mkdir()
    for p in (REPO / "lathework").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "lathework" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(registry.queries())), "False"], said.stderr

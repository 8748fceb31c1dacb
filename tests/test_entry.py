import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", ["query_page", "f_elem", "audit_replay_scalar", "audit_merge", "squash", "debounce", "debounce_cut", "audit_server", "audit_replay_full", "audit_replay_arrays", "audit_replay_base", "audit_update_with", "sd_requeue", "sd_ack", "sd_stream_sends", "sd_stream_state", "sub_many"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "supplier", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_corpus_subpackage(tmp_path):
    for p in ("quillon", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    if (tmp_path / "quillon/llm").exists():
        (tmp_path / "quillon/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; assert 'query_page' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"})

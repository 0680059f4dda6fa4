"""Every registered query of the reference's operators, held against its SQL; the others against properties."""

from __future__ import annotations

import pytest

from tests import oracle
from wrenchlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    oracle.same(registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_sliding_limit_against_loop(spark, duck):
    got = {r.event_id: r.accepted for r in registry.QUERIES["sliding_limit_exact"](spark, SF).collect()}
    held: dict = {}
    for i, user, ts in duck.sql("SELECT event_id, user_id, ts FROM events ORDER BY user_id, ts, event_id").fetchall():
        recent = held[user] = [t for t in held.get(user, []) if (ts - t).total_seconds() < 3600]
        ok = len(recent) < 3
        recent += [ts] * ok
        assert got[i] == ok


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "wrenchlake", tmp_path / "wrenchlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if (root / "corpus_pipeline.py").exists():  # it may stay, or be gone itself
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'knn_topk' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import assert_same

from sluice.operators import apply
from sluice.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(plans.QUERIES[name](spark, sf_dir), plans.ORACLES[name], sf_dir)


def test_bins_hold_all_unfit_files_up_to_the_target(spark, sf_dir):
    rows = plans.bin_pack_groups(spark, sf_dir).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["table_key"], r["bin"]), []).append(r["bytes"])
    assert rows and all(sum(x) <= 128 << 20 or len(x) == 1 for x in sizes.values()) and all(len(x) >= 10 for x in sizes.values())


def test_split_rows_is_greedy(spark, sf_dir):
    rows = plans.split_rows_by_limits(spark, sf_dir).collect()
    sizes = {r["o_orderkey"]: len(r["o_orderpriority"]) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    by = {}
    for r in sorted(rows, key=lambda r: r["o_orderkey"]):
        by.setdefault(r["o_custkey"], []).append((sizes[r["o_orderkey"]], r["chunk"]))
    for group in by.values():
        chunk, n, held = 0, 0, 0
        for size, got in group:
            if n and (n >= 5 or held + size > 40):
                chunk, n, held = chunk + 1, 0, 0
            n, held = n + 1, held + size
            assert got == chunk


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["k", "pos", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert apply.operation_name(1, 0) == "delete"


def test_registry_without_the_corpus_operators(tmp_path):
    """In a copy without their folders all else imports and is registered, whether or not the pipeline's file is left."""
    root = Path(__file__).parents[1]
    for name in ("sluice", "corpus_pipeline.py", "__spark_entry__.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'reduce_live_rows' in n and 'pipeline' not in n and set(e.oracle_sql()) <= set(n); print(len(n))"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        assert int(out.stdout.split()[-1]) == len(plans.QUERIES)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)

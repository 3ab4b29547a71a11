"""Every query of the core against its SQL, or at least run, on the smallest tables."""

import importlib

import pytest
from oracle import DATA, compare

import __spark_entry__ as entry

QUERIES, SQL = {}, {}
for subject in entry.SUBJECTS:
    module = importlib.import_module(f"troupe.plans.{subject}")
    QUERIES |= module.QUERIES
    SQL |= module.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(spark, name, f"{DATA}/sf0.001", QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_core_without_the_tokenizer_library():
    """The core's queries don't depend on what the training-data operators need."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 74 and not any(x.startswith('p1_') for x in q) and set(s) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], check=False).returncode == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from troupe.runtime import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_scratch_tables_go_with_their_block(spark):
    import glob

    from troupe.runtime import materialize, scratch, shared_dir

    with scratch(spark):
        assert materialize(spark.range(3), "scratch-test").count() == 3
        assert glob.glob(f"{shared_dir(spark).removeprefix('file://')}/troupe/scratch-test-*")
    assert not glob.glob(f"{shared_dir(spark).removeprefix('file://')}/troupe/scratch-test-*")

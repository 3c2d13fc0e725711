"""The library without its subpackage for training data, and its tables in the shared folder."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from spindrift.sources.shared import cut, discard, scope, shared_dir

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "spindrift").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", file.read_text(), re.MULTILINE), file


def test_tables_go_with_their_scope(spark):
    there = lambda t: os.path.exists(t.shared_path)
    free = cut(spark.range(3), "free")
    with scope():
        with scope():
            inner, outer = cut(spark.range(3), "inner"), cut(spark.range(4), "outer", outer=True)
            assert there(inner)
        assert not there(inner) and outer.count() == 4
    assert not there(outer) and there(free)
    with pytest.raises(ZeroDivisionError), scope():
        failed = cut(spark.range(1), "failed")
        1 / 0  # noqa: B018
    assert not there(failed)
    discard(free)
    assert not there(free)


def test_shared_folder():
    class Session:
        def __init__(self, master, folder=None):
            self.conf, self.sparkContext, self.master, self.folder = self, self, master, folder

        def get(self, name, default):
            return self.folder

    assert shared_dir(Session("spark://x", "s3://b/c/")) == "s3://b/c" and shared_dir(Session("local[4]")).startswith("/tmp")
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))

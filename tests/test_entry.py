"""The entry points, and that the library works without the corpus subpackage."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "n", "qty", "disc", "low", "high"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_corpus_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/ridgeline"):
        if not folder.endswith("/llm"):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"ridgeline\.llm|from ridgeline import .*llm", open(f"{folder}/{n}").read()), n


def test_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.stdout.split() == ["True", "False"], said.stderr


def test_works_without_a_library_of_the_corpus_queries():
    code = "import sys; sys.modules['pandas'] = None; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()) > 100, any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "False"], said.stderr

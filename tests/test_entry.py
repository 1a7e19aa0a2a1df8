import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["from_name", "to_name", "num_common", "num_kmers", "reverse", "estimated_containment"]
    assert rows.count() > 0


def test_the_rest_works_without_the_optional_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "strandmill"), tmp_path / "strandmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_containment' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_a_missing_library_is_no_missing_part(tmp_path):
    """Without a library that the optional part needs, its queries don't just go."""
    if not os.path.isdir(os.path.join(ROOT, "strandmill", "llm")):
        return
    (tmp_path / "sentencepiece.py").write_text("")
    (tmp_path / "ahocorasick.py").write_text("raise ModuleNotFoundError('no ahocorasick', name='ahocorasick')")
    code = "import __spark_entry__"
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}{os.pathsep}{ROOT}"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode and "no ahocorasick" in done.stderr

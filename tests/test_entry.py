import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert all(map(callable, queries.values()))
    assert set(sql) <= set(queries) and all(isinstance(x, str) and x.strip() for x in sql.values())


def test_without_the_optional_parts(tmp_path):
    """The rest works with the optional subpackage deleted, whether or not the pipeline's file is left."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "tests"))
    names = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (tmp_path / "copy" / name).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", names], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout.split()[0]) >= 90

"""The entry point without the optional training-data parts."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_parts(tmp_path):
    shutil.copytree(os.path.join(REPO, "gradebook"), tmp_path / "gradebook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(q) == set(s) and 'win_board' in q; "
            "assert not [n for n in q if n == 'pipeline' or n.startswith('op1_')]")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)

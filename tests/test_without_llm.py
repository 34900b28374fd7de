"""The library and its entry point without the llm subpackage, its tests and the pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rest_works_alone(tmp_path):
    shutil.copytree(f"{ROOT}/kelpgrid", tmp_path / "kelpgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(f"{ROOT}/kelpgrid"):
        if not folder.endswith("/llm") and "__pycache__" not in folder:
            for name in names:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "kelpgrid.llm" not in f.read(), name

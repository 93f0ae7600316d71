"""The library works without the training-data part."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copytree(f"{ROOT}/covenant", tmp_path / "covenant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), set(E.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    n, extra, covered = out.stdout.split()
    assert int(n) > 120 and extra == "False" and covered == "True"


def test_nothing_else_imports_the_training_data_part():
    for folder, _, names in os.walk(f"{ROOT}/covenant"):
        if f"{os.sep}llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "covenant.llm" not in f.read(), name

"""The entry file without the optional folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWN = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), set(s) <= set(q), any(n[:2] == 'op' or n == 'pipeline' for n in q))"


def shown(folder):
    done = subprocess.run([sys.executable, "-c", SHOWN], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copied(target, *left_out):
    gone = {os.path.join(ROOT, name) for name in left_out}
    shutil.copytree(
        ROOT, target, ignore=lambda at, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(at, n) in gone]
    )
    return target


def test_without_the_subpackage(tmp_path):
    for number, left_out in enumerate((["lendwell/llm", "tests/llm"], ["lendwell/llm", "tests/llm", "corpus_pipeline.py"])):
        count, known, optional = shown(copied(tmp_path / str(number), *left_out))
        assert int(count) > 90 and (known, optional) == ("True", "False")


def test_nothing_else_imports_the_subpackage():
    for at, _, names in os.walk(os.path.join(ROOT, "lendwell")):
        if os.path.basename(at) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(at, name), encoding="utf-8") as file:
                    assert "llm" not in file.read(), name

"""The engine works without the text-corpus subpackage."""

import os
import re
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{REPO}/sangam", tmp_path / "sangam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert "fine" in done.stdout, done.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{REPO}/sangam"):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, name)).read()), name

"""The entry point without the optional parts."""

import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(k.startswith(('op1_', 'pipeline')) for k in q))"


def test_queries_without_the_optional_folders(tmp_path):
    for gone in ((), ("corpus_pipeline.py",), ("selenite/llm", "corpus_pipeline.py"), ("selenite/llm",)):
        to = tmp_path / str(len(list(tmp_path.iterdir())))
        shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
        for g in gone:
            if (to / g).exists():
                (shutil.rmtree if (to / g).is_dir() else Path.unlink)(to / g)
        done = subprocess.run([sys.executable, "-c", CODE], cwd=to, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        there = "selenite/llm" not in gone and importlib.util.find_spec("selenite.llm") is not None
        assert done.stdout.split()[1] == str(there)

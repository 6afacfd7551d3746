import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_the_rest_works_without_the_corpus_folders(tmp_path):
    """A copy without both folders, with and without the pipeline, still registers the image queries."""
    root = Path(entry.__file__).resolve().parent
    for name in ("both", "neither"):
        copy = tmp_path / name
        shutil.copytree(root / "pixelloom", copy / "pixelloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for f in ("__spark_entry__.py", *(["corpus_pipeline.py"] if name == "both" else [])):
            shutil.copy(root / f, copy)
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        queries, sql, corpus = out.stdout.split(" ", 2)
        assert int(queries) > 100 and int(sql) > 100 and corpus.strip() == "[]", out.stderr

"""The entry point without the folders of the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASKED = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def asked(folder: Path) -> list[int]:
    said = subprocess.run([sys.executable, "-c", ASKED], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return [int(x) for x in said.stdout.split()]


def copied(folder: Path, *gone: str) -> Path:
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (REPO / name).exists():
            shutil.copy(REPO / name, folder / name)
    shutil.copytree(REPO / "kinetrace", folder / "kinetrace", ignore=shutil.ignore_patterns("__pycache__", *[g for g in gone if "." not in g]))
    return folder


def test_without_the_folder_the_pipeline_stays_away(tmp_path):
    total, sql, others = asked(copied(tmp_path, "llm"))
    assert total > 100 and sql > 100 and others == 0


def test_without_folder_and_pipeline(tmp_path):
    assert asked(copied(tmp_path, "llm", "corpus_pipeline.py"))[2] == 0

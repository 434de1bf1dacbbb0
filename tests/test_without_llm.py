"""The entry and its queries work without the training-data operators."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


def test_entry_without_the_subpackage():
    for gone in ("'corpus_pipeline', 'barflow.llm'", "'barflow.llm'"):
        code = f"import sys; sys.modules.update(dict.fromkeys([{gone}])); import __spark_entry__ as e; print(*e.queries())"
        done = run(code)
        assert done.returncode == 0, done.stderr
        assert "w06_rsi" in done.stdout and "pipeline" not in done.stdout


def test_other_missing_modules_are_errors():
    done = run("import sys; sys.modules['numpy'] = None; import __spark_entry__")
    assert done.returncode != 0 or not os.path.isdir(os.path.join(ROOT, "barflow", "llm"))


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "barflow")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "barflow.llm" not in open(os.path.join(folder, f)).read(), f

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


def ask(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}).stdout.split()


def without(tmp_path, *names):
    shutil.copytree(HERE, tmp_path, dirs_exist_ok=True, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *names))


@pytest.mark.parametrize("names", [(), ("corpus_pipeline.py",)])
def test_core_stands_alone(tmp_path, names):
    """With the two folders gone, and the pipeline's file left or gone as well."""
    without(tmp_path, *names)
    assert (tmp_path / "corpus_pipeline.py").exists() == (not names) and not (tmp_path / "quern/llm").exists()
    n, ops, pipeline = ask(tmp_path)
    assert int(n) >= 40 and ops == "0" and pipeline == "False"
    for f in (tmp_path / "quern").rglob("*.py"):
        assert "quern.llm" not in f.read_text()


def test_other_failed_imports_are_not_hidden(tmp_path):
    without(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    with pytest.raises(subprocess.CalledProcessError):
        ask(tmp_path)


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["track_id"] == r["capture_id"] for r in rows if r["capture_id"] < 100)

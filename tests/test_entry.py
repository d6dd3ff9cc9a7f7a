import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_flagship_query(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "ref", "score"] and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(ROOT / "attestor", tmp_path / "attestor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=100).returncode == 0


def test_nothing_else_imports_the_subpackage():
    for f in (*(ROOT / "attestor").rglob("*.py"), *(ROOT / "jobs").rglob("*.py")):
        if "llm" not in f.parts:
            assert "attestor.llm" not in f.read_text(), f

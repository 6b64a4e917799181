"""The entry point works with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(*q)"


def names(folder, before=""):
    return subprocess.run([sys.executable, "-c", before + NAMES], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_without_llm(tmp_path):
    for part in ("tidemill", "tests"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for file in ("__spark_entry__.py", "bench.py", "pytest.ini"):
        shutil.copy(ROOT / file, tmp_path)
    found = names(tmp_path)
    assert found and all(n.startswith("fx_") for n in found)
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and "test_fixtures.py" in said.stdout
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_fixtures.py", "tests/test_pages.py", "tests/test_contamination.py"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and " passed" in said.stdout, said.stdout[-2000:]


def test_without_a_library_of_llm():
    found = names(ROOT, "import sys; sys.modules['ahocorasick'] = None; ")
    assert found and all(n.startswith("fx_") for n in found)


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

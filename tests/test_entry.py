"""What the driver does with the repository: collect its tests, import its entry with parts missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
from veritable.catalog import QUERIES
queries, sql = entry.queries(), entry.oracle_sql()
assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
print(len(queries) - len(QUERIES), "pipeline" in queries)
"""


@pytest.mark.parametrize("chosen", [["tests"], ["tests", "--ignore=tests/llm"]])
def test_all_modules_are_collected(chosen):
    run = [sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", *chosen]
    done = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:]


@pytest.mark.parametrize("missing", ["veritable.llm", "corpus_pipeline", "public_tokenizers"])
def test_queries_register_without(missing):
    done = subprocess.run(
        [sys.executable, "-c", BLOCKED.format(name=missing)], cwd=ROOT, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    more, pipeline = done.stdout.split()
    if missing == "veritable.llm":
        assert (more, pipeline) == ("0", "False")
    if missing == "corpus_pipeline":
        assert pipeline == "False"

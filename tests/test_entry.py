"""The optional part of the entry never takes the other queries with it."""

import subprocess
import sys

import pytest

HIDE = """
import sys
sys.path.insert(0, {root!r})
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
print(len(entry.queries()), any(k.startswith("op") and k[2:3].isdigit() for k in entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))
"""


@pytest.mark.parametrize("hidden", [["xxhash"], ["corpus_pipeline"], ["tabulon.llm"]])
def test_core_stays(hidden):
    from tabulon.plans.queries import QUERIES

    root = __file__.rsplit("/tests/", 1)[0]
    run = subprocess.run([sys.executable, "-c", HIDE.format(root=root, hidden=hidden)], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split() == [str(len(QUERIES)), "False", "True"]

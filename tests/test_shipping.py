"""Python workers get the package from the session, not from the working folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from wakeline.session import local_session
spark = local_session("2", "elsewhere")
import __spark_entry__ as entry
rows = entry.queries()["t2_cohort_neighbours"](spark, "/root/testdata/sf0.001").count()
print("ROWS", rows)
"""

ROOT = Path(__file__).resolve().parents[1]


def test_neighbours_run_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]


def test_entry_works_without_the_optional_subpackage():
    """Whatever import of it fails, the other queries stay."""
    code = ("import sys; sys.modules['{}'] = None; sys.path.insert(0, {!r}); import __spark_entry__ as e; "
            "names = set(e.queries()); assert 'p1_vessel_id' in names and 'p1_vessel_id' in e.oracle_sql(); "
            "assert not any(n.startswith('op') or n == 'pipeline' for n in names)")
    for missing in ("wakeline.llm", "public_tokenizers", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(missing, str(ROOT))], check=True, timeout=100)

"""The entry without the training-data operators, or without a library that only they need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_missing_library():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, any_op, _ = done.stdout.split()
    assert int(n) > 200 and any_op == "False"


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from tessella.lineage import shared_dir

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    class Spark:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://x:7077", "_jsc": Jsc(), "applicationId": "a"})()

    with pytest.raises(ValueError):
        shared_dir(Spark())

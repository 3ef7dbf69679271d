"""Python functions run on executors that cannot see this checkout."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from fieldloom.session import local_session
from fieldloom.plans.queries import QUERIES
spark = local_session(2, 2, "1g")
assert QUERIES["lexical_bonus"](spark, {sf!r}).count() > 0
assert QUERIES["hungarian"](spark, {sf!r}).count() == 25
"""


def test_workers_get_the_package(sf, tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

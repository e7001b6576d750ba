"""The bench itself runs from a session of its own to one line of JSON."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
HERE = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_two_queries():
    code = "import bench; bench.HEADLINE = ['rank_best', 'feed_match', 'no_such_query']; bench.main()"
    env = os.environ | {"BENCH_SF_DIR": str(DATA), "BENCH_CPUS": "2"}
    done = subprocess.run([sys.executable, "-c", code], cwd=HERE, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    said = json.loads(done.stdout.strip().splitlines()[-1])
    assert set(said["queries"]) == {"rank_best", "feed_match"} and said["unit"] == "sec" and said["value"] > 0

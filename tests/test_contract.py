"""Driver contract: entry module and bench output format."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_QUERIES="sla_due,transcripts", BENCH_RUNS="1",
               BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and set(d["queries"]) == {"sla_due", "transcripts"}
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-6 and isinstance(d["metric"], str)


def test_entry_works_without_the_training_data_operators():
    code = ("import sys; sys.modules['corpus_pipeline'] = sys.modules['deskpark.llm'] = None; import __spark_entry__ as e; "
            "assert e.llm is None and len(e.queries()) == len(e.oracle_sql()) == 44, len(e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)

"""Driver contract: bench.py prints one JSON line; __spark_entry__ exposes matching queries/oracles."""

import json
import os
import subprocess
import sys

import __spark_entry__ as entry
from tabscore.plans import catalogue, oracle

from tests.conftest import ROOT, SF0001


def test_bench_prints_one_json_line(tmp_dir):
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_CPUS="2", BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "score_linear", "value_counts"],
                         cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=600)
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    assert out.returncode == 0 and len(lines) == 1, out.stderr[-2000:]
    result = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(result)
    assert result["unit"] == "sec" and set(result["queries"]) == {"score_linear", "value_counts"}
    assert result["value"] == round(sum(result["queries"].values()), 3)


def test_every_oracle_names_a_query():
    queries, oracles = catalogue.QUERIES, oracle.ORACLE
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(oracles) <= set(queries)
    assert set(queries) - set(oracles) == {"random_sample"}


def test_core_queries_survive_without_the_text_part(tmp_dir):
    """The folder gone, left empty, or one of its imports missing: the other queries are all there."""
    import shutil
    copy = os.path.join(tmp_dir, "repo")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), [k for k in q if k.startswith('op')])"

    def run(before=""):
        return subprocess.run([sys.executable, "-c", before + code], cwd=copy, capture_output=True, text=True, timeout=300,
                              env=dict(os.environ, PYTHONPATH=copy)).stdout.strip()

    want = f"{len(catalogue.QUERIES)} {len(oracle.ORACLE)} []"
    assert run() == want
    os.makedirs(os.path.join(copy, "tabscore", "llm", "__pycache__"))
    assert run() == want
    if os.path.isdir(os.path.join(ROOT, "tabscore", "llm")):
        shutil.rmtree(os.path.join(copy, "tabscore", "llm"))
        shutil.copytree(os.path.join(ROOT, "tabscore", "llm"), os.path.join(copy, "tabscore", "llm"))
        assert run("import sys; sys.modules['xxhash'] = None\n") == want
        os.remove(os.path.join(copy, "corpus_pipeline.py"))
        assert "op1_" in run() and "pipeline" not in run()

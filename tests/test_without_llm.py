"""The library, its queries and the entry without the llm folders and the pipeline."""

import shutil
import subprocess
import sys
import time

from tests.conftest import DATA, ROOT

CODE = f"""
import sys
if "--blocked" in sys.argv:
    sys.modules["ahocorasick"] = None
import __spark_entry__ as e
assert e.HAS_LLM is False and not any(n.startswith("op") or n == "pipeline" for n in [*e.queries(), *e.oracle_sql()])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
for name in ("book_hash", "wave_plan", "lww_merge"):
    assert e.queries()[name](spark, "{DATA}/sf0.001").count() > 0
"""


def run(folder, *how):
    shared = folder / "shared"
    done = subprocess.run([sys.executable, "-c", CODE, str(shared), *how], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return shared


def test_the_rest_works_alone(tmp_path):
    shutil.copytree(f"{ROOT}/folioflux", tmp_path / "folioflux", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shared = run(tmp_path)
    # what the queries kept goes when the session's process ends
    until = time.time() + 30
    while list(shared.glob("folioflux-*")) and time.time() < until:
        time.sleep(0.5)
    assert not list(shared.glob("folioflux-*"))


def test_a_package_that_only_llm_needs_may_be_missing(tmp_path):
    shutil.copytree(f"{ROOT}/folioflux", tmp_path / "folioflux", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    run(tmp_path, "--blocked")

"""Functions go to executors that have no copy of the package."""

import subprocess
import sys
from pathlib import Path

from serialis import llm

ROOT = Path(__file__).parents[2]


def test_functions_travel(travels):
    travels(llm)


def test_clips_where_workers_lack_the_package(tmp_path):
    """op1 with workers that start in another folder; only the driver can import the package."""
    script = tmp_path / "driver.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from serialis.llm.queries import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", len(QUERIES["op1_audio_features"](spark, "/root/testdata/sf0.001").collect()))
""")
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=180, check=False)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]

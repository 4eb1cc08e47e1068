import os
import subprocess
import sys
import tempfile

CODE = """
from pyspark.sql import SparkSession
from priceloom import session
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = session.shared_dir(spark)
assert first.startswith("file:///tmp/") and session.shared_dir(spark) == first and session.scratch(spark, "a").startswith(first)
assert session.keep(spark.range(3), "kept").count() == 3
print("fine")
"""


def test_a_session_without_a_checkpoint_folder():
    """With Spark's own defaults only."""
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="spark-")}
    got = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert got.stdout.endswith("fine\n"), got.stderr[-2000:]

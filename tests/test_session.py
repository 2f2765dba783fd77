import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, conf_dir):
    env = os.environ | {"SPARK_CONF_DIR": str(conf_dir), "PYTHONPATH": ROOT}
    r = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert r.returncode == 0, r.stderr[-2000:]
    return r.stdout


def test_queries_run_without_a_checkpoint_setting(tmp_path):
    out = run("""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
q = e.queries()
print(q["a3_count_per_visit"](s, "/root/testdata/sf0.001").count() > 0, q["w2_prior_snapshot"](s, "/root/testdata/sf0.001").count() > 0)
from wardspark.session import get_session
assert get_session() is s
""", tmp_path)
    assert "True True" in out


def test_a_folder_set_before_is_respected(tmp_path):
    out = run(f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setCheckpointDir("{tmp_path}/mine")
from wardspark.session import checkpoint_dir
print(checkpoint_dir(s))
""", tmp_path)
    assert f"{tmp_path}/mine" in out

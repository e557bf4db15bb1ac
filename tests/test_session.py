"""A session without a preset checkpoint folder, and tables that are gone after their work."""

import os
import subprocess
import sys

from millrace.session import Tables, shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
from millrace.session import local_session, shared_folder
from millrace.operators import ordering
spark = local_session(2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "i int, v int")
assert [r.v for r in ordering.ffill(df, "v", ["i"]).orderBy("i").collect()] == [5, 5, 7]
first = shared_folder(spark)
assert first == shared_folder(spark)
spark.sparkContext.setCheckpointDir("%s")
assert shared_folder(spark) != first
print("done")
"""


def test_a_fresh_process_without_a_configured_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROGRAM % tmp_path], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]


def test_tables_are_deleted_at_the_end(spark):
    folder = shared_folder(spark).removeprefix("file:")
    with Tables(spark) as tables:
        kept = tables.keep(spark.range(5), "once")
        assert kept.count() == 5 and any(n.startswith("once-") for n in os.listdir(folder))
        tables.keep(spark.range(3), "twice")
        tables.drop(but=1)
        assert not any(n.startswith("once-") for n in os.listdir(folder))
    assert not any(n.startswith(("once-", "twice-")) for n in os.listdir(folder))

"""The session where nothing is configured."""

import os
import subprocess
import sys
from pathlib import Path

from .conftest import DATA

SCRIPT = """
import __spark_entry__ as entry
from sparkkb.session import get_spark, shared_dir
spark = get_spark(cores=4)
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
assert entry.queries()["p2_found"](spark, "{data}").count() > 0
assert entry.queries()["event_window_stream"](spark, "{data}").count() > 0
print("folder", shared_dir(spark))
"""


def test_without_a_checkpoint_folder(tmp_path):
    """No spark-defaults: intermediate tables lie in a folder of our own, which is gone at the end."""
    root = str(Path(__file__).resolve().parent.parent)
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(data=DATA)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    folder = done.stdout.split("folder file://")[1].strip()
    assert not os.path.exists(folder)

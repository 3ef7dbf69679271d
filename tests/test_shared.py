"""Written tables go to a folder that all machines share, or the query says what is missing."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from fieldloom import shared

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
known = __spark_entry__.queries()
print("ROWS", *[name + "=" + str(known[name](spark, {sf!r}).count()) for name in {names!r} if name in known])
"""


def rows_without_a_folder(tmp_path, sf, names):
    """Rows of each query in a session for which nobody has set spark.checkpoint.dir."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=sf, names=names)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    return {k: int(v) for k, v in (x.split("=") for x in done.stdout.rpartition("ROWS")[2].split())}


def test_a_query_that_writes(tmp_path, sf):
    assert rows_without_a_folder(tmp_path, sf, ["stream_topk"])["stream_topk"] > 0


def session(conf, local, given=None):
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: given, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(isLocal=lambda: local)))
    return SimpleNamespace(sparkContext=context, conf=conf)


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def test_a_cluster_names_the_folder():
    assert shared.shared_dir(session(Conf({"spark.checkpoint.dir": "hdfs://x/c/"}), False)) == "hdfs://x/c"
    assert shared.shared_dir(session(Conf(), False, "hdfs://x/given")) == "hdfs://x/given"
    assert shared.shared_dir(session(Conf({"spark.sql.warehouse.dir": "hdfs://x/w"}), False)) == "hdfs://x/w/_fieldloom"
    for warehouse in ("", "/w", "file:/w"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(Conf({"spark.sql.warehouse.dir": warehouse}), False))

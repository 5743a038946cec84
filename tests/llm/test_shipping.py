"""Every corpus query in a driver started elsewhere: executors then have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
from outvote.staging import release_staged
sys.path.remove({repo!r})
spark = (SparkSession.builder.master("local-cluster[1,4,2048]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1").config("spark.executor.memory", "2g").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", "file://{folder}").config("spark.sql.warehouse.dir", "{folder}/warehouse").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        release_staged(spark)
        print("DONE", name, flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    script = SCRIPT.format(repo=str(REPO), folder=str(tmp_path))
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env | {"SPARK_SCALA_VERSION": "2.13"}, capture_output=True, text=True, timeout=1200)
    done = {line.split()[1] for line in ran.stdout.splitlines() if line.startswith("DONE")}
    sys.path.insert(0, str(REPO))
    import __spark_entry__

    wanted = {n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
    assert done == wanted, ran.stderr[-3000:]

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from askbook.plans import posts
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print(posts.SPARK["classify_reasons"](spark, sys.argv[2]).count(), posts.SPARK["page_parse"](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN, str(REPO), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(n) > 0 for n in done.stdout.split())

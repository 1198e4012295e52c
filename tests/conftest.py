import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def spoiled(path, target, kinds):
    """A copy of a folder whose blobs of `kinds` can't be opened."""
    from geoloom.sources import pbf

    os.makedirs(target)
    for name in sorted(os.listdir(path)):
        data = bytearray(open(f"{path}/{name}", "rb").read())
        for at, size, index, _ in pbf._blobs(f"{path}/{name}", 0, len(data), opened=False):
            if index and index[0] in kinds:
                data[at + size - 12 : at + size] = bytes(12)
        open(f"{target}/{name}", "wb").write(bytes(data))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

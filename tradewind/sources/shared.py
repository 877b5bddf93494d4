"""Tables of a session in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[tuple[SparkSession, str, str]] = []
#: Stands in for an unset spark.checkpoint.dir where all tasks run in this process.
_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='tradewind-')}")
        found = _LOCAL[0]
    return found.rstrip("/")


def new_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new table's name and place; both go when the driver ends."""
    table = f"{name}_{uuid.uuid4().hex}"
    _OWN.append((spark, table, f"{folder(spark)}/{table}"))
    return table, _OWN[-1][2]


@atexit.register
def _drop() -> None:
    for spark, table, place in _OWN:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            return

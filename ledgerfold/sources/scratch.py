"""Tables that live as long as the driver, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

from ..errors import InvalidInput

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the driver's Python ends. Where that is unset, a local master
    uses a folder of its machine, and any other is refused: executors would each write to their own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidInput("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file:///tmp/checkpoints"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _delete() -> None:
    for spark, path in _made:
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session has ended: the folder is left to its owner
            return

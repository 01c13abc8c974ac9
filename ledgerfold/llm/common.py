"""What the operators of this subpackage share: reading tables, the shared folder, shipping the package."""

from __future__ import annotations

import atexit
import os
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput

#: Only used where the session names no spark.checkpoint.dir (tests, one machine).
LOCAL_SHARED = "file:///tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_shipped: set[str] = set()
_files: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master uses
    LOCAL_SHARED, and any other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidInput("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_SHARED
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back.

    Unlike a cached or locally checkpointed frame, it stays readable when executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables that `written` made. Nothing that is still to be computed may read them."""
    for frame in frames:
        path = _path_of.pop(frame)
        _delete(frame.sparkSession, path)
        _written.remove((frame.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _delete_scratch() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder is left to its owner
            return


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(root, "ledgerfold")
    target = os.path.join(context._temp_dir, "ledgerfold-package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def ship_file(spark: SparkSession, path: str) -> str:
    """Gives a file of the driver to all executors. Returns the name that `shipped_file` finds it by in a worker."""
    key, name = (spark.sparkContext.applicationId, os.path.basename(path)), os.path.basename(path)
    if _files.setdefault(key, os.path.abspath(path)) != os.path.abspath(path):
        raise ValueError(f"another file named {name} was given to the executors before")
    spark.sparkContext.addFile(path)
    return name


def shipped_file(name: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def free_name(name: str, df: DataFrame) -> str:
    """name, with as many underscores after it as make it no column's name (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Rows of (id, `by`): of each value of `by` some `most` rows, or all if there are fewer. Which, the ids' hashes
    say. The values are a classifier's classes: the driver holds a number for each, as the model does."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows
    share = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(1.0, most / n))])
    unit = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(unit < F.element_at(share, F.col(by)))

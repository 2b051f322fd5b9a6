"""Session helpers: shipping the package to executors, shared work folders, tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_own_dir: str | None = None


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The package is zipped on the driver and served by Spark, so executors need no
    shared installation.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="sheaf-ship-")
    target = os.path.join(folder, "sheaf_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, path.relative_to(_ROOT.parent).as_posix())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; any other
    master is an error, since a machine-local folder would lose data there.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = Path(tempfile.mkdtemp(prefix="sheaf-shared-")).as_uri()
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder's owner cleans it then
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sheaf-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`new_path` before the driver's Python ends."""
    _delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without depending on any executor's local disk, and gives the
    optimizer real sizes for what follows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: Column | int, most: int = 32 << 20) -> DataFrame:
    """Marked for broadcast if the sizes of its rows add up to ``most`` bytes or less; a larger
    table is left to a shuffled join. Call it on a table that was materialized."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A row group is at most about this large, so a table of more for each core has enough.
ROW_GROUP = 1 << 30


def spread(df: DataFrame, least_rows: int = 64) -> DataFrame:
    """A table just read, over all cores even where its files are few large row groups.

    A row group is read by one task, however many splits its file has, so heavy work on each
    row would use few cores. Tables of over ROW_GROUP bytes for each core are taken as they
    are. Of smaller ones the rows of each task are counted, which reads footers only; they are
    dealt anew if fewer tasks than cores have any and each core would get ``least_rows``.
    Call it on a plain scan: anything above one would run for the count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * ROW_GROUP:
        return df
    per_task = df.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    tasks, rows = per_task.agg(F.count("*"), F.sum("count")).first()
    return df.repartition(3 * cores) if tasks < cores and (rows or 0) >= cores * least_rows else df


def require(df: DataFrame, names: list[str]) -> None:
    """An error at once, before any row is read, if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; there are {df.columns}")


def quoted(name: str) -> str:
    """A column name that Spark takes literally, dots and ticks included."""
    return "`" + name.replace("`", "``") + "`"

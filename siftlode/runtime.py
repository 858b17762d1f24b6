"""Sessions, table access and lineage cuts.

Lineage is cut by writing a Parquet table into the shared folder named by ``spark.checkpoint.dir``; every executor
can read it again after any other executor is lost. Only where the setting is absent and the master is local (tests on
one machine) a temporary folder is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WORK: set[str] = set()


def session(app: str = "siftlode", cores: str = "*", **conf: object) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the caller's own session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` if set, else one temporary folder per application."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="siftlode-")
        _LOCAL_DIRS[app] = path
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{_LOCAL_DIRS[app]}"


def work_dir(spark: SparkSession) -> str:
    """This application's own folder of intermediate tables in the shared folder; it is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/siftlode/{app}"
    if app not in _WORK:
        _WORK.add(app)
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    local = local_path(path)
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the cluster is gone already
        pass


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, nothing is recomputed later.

    With ``by`` the table has a folder for each value of that column, so that a filter on it reads those files only.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application; needed where it is not installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siftlode-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "siftlode.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A driver table, one Parquet file or folder per name. The first call of an application ships this package."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``, for fitting a model: a bounded, repeatable sample.

    A threshold on the hash keeps about twice that many before they are ordered, so tasks send few rows each.
    """
    n = df.count()
    h = F.xxhash64(key)
    rows = df if n <= 2 * most else df.where(h < -(1 << 63) + int((1 << 64) * (2 * most / n)))
    return rows.orderBy(h, key).limit(most)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy a row: an input of fewer partitions than tasks can run at once is dealt out evenly.

    A large input has more partitions than that and is read as it is, without a shuffle, and so is one that comes out
    of a join or aggregate (counting its partitions would run it). The rows are the same.
    """
    n = slots(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(k in plan.nodeName() for k in _SHUFFLING) or _any_node(plan):
        return df
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Logical operators that shuffle their input.
_SHUFFLING = ("Join", "Aggregate", "Window", "Sort", "Repartition", "Distinct", "CoGroup", "GroupsIn", "Limit")


def _any_node(plan) -> bool:
    """Whether an operator below shuffles."""
    children = plan.children()
    for k in range(children.size()):
        child = children.apply(k)
        if any(w in child.nodeName() for w in _SHUFFLING) or _any_node(child):
            return True
    return False


def pieces(total: float, each: float) -> int:
    """How many pieces of at most ``each`` cover ``total``; at least one."""
    return max(1, math.ceil(total / each))


def local_path(uri: str) -> str:
    """The file-system path of a ``file:`` URI or plain path."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri

"""Session defaults, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

BROADCAST_MAX_BYTES = 64 << 20


def build_session(app: str = "lumiray", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are tuned for; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # do not record a stack trace for every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folders: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _local_folders.setdefault(app, None) or tempfile.mkdtemp(prefix="lumiray-")
        _local_folders[app] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, so that later
    steps neither recompute them nor depend on the executor that made them."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that `cut_lineage` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_table(df: DataFrame) -> DataFrame:
    """Per-group statistics on their way back to the rows, as a written table.

    The planner then knows their true size: it broadcasts them below
    `spark.sql.autoBroadcastJoinThreshold` and shuffles beyond it. From an unwritten
    aggregate it would expect the size of its input, and shuffle all rows by keys
    of which there may be very few."""
    return cut_lineage(df)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Write the side, which is thereby worked out once, and hint a broadcast only if its rows take at most
    `max_bytes`; a larger side is left to a shuffled join, which AQE splits on skew.

    Numbers count 8 bytes, texts and lists what they hold."""

    def size(name: str, kind) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16 if isinstance(kind, (StringType, BinaryType)) else F.lit(8)

    side = cut_lineage(df)
    total = side.agg(F.sum(reduce(lambda a, b: a + b, [size(f.name, f.dataType) for f in df.schema.fields])).alias("n")).first()["n"]
    return F.broadcast(side) if (total or 0) <= max_bytes else side


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow
    functions find it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lumiray-"), "lumiray_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)

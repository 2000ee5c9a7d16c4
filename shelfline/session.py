"""Session helpers: runtime settings and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. All can be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows on their way to Python wait outside the heap, a batch at a time; 10,000 long texts are too large a batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": "6000000",
}

#: Tables that a thread has written inside :func:`settled`.
_WRITTEN = threading.local()

#: Fallback folders of local sessions, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "shelfline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    builder = builder.config("spark.ui.enabled", "false")
    return tune(builder.getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a missing setting is
    an error, because a machine-local folder would not survive the loss of that machine. Whether a
    folder that the setting names is shared is for the cluster to say.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="shelfline-checkpoint-")
    return _LOCAL_ROOTS[application]


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several later steps read, and continue from the written copy.

    Parquet in the shared checkpoint folder survives lost executors, keeps column pruning, and gives
    the optimizer a measured size to choose join strategies by.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    if getattr(_WRITTEN, "tables", None) is not None:
        _WRITTEN.tables.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more: what was made from them has been written.

    Frames that it did not make are left alone.
    """
    for table in tables:
        path = getattr(table, "_written_path", None)
        if path:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def settled(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """Write the table that ``make`` gives; then the tables it wrote on the way and its shuffle files are deleted.

    Tables that were there before stay, and so does the result.
    """
    outer = getattr(_WRITTEN, "tables", None)
    _WRITTEN.tables = []
    try:
        result = cut_lineage(make(), name)
        on_the_way = _WRITTEN.tables[:-1]
    finally:
        _WRITTEN.tables = outer
    if outer is not None:
        outer.append(result)
    discard(*on_the_way)
    release(result.sparkSession)
    return result


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark deletes shuffle files of plans that are done with.

    Spark does so by itself, but only when the driver's heap happens to fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

"""Spark session defaults and the folder where lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("brindle")
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


#: Tables written by ``cut`` in this process, by session; and the folder of local sessions that name none.
_WRITTEN: dict[str, list[str]] = {}
_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session, whose executors are this machine, may do
    without; on a cluster a missing setting is an error, for a folder of one machine can't hold what all must read."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: tables between stages are written there")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="brindle-"))


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives the loss of executors, keeps parquet column pruning, and can be read many times
    without recomputation. Unlike a cached or locally checkpointed frame it does not live on an executor. ``release``
    removes what was written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written in this session, once the results that read them are saved or collected.
    Returns how many there were. The rest goes when the process ends."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            release(spark)
        except Exception:  # the gateway may be gone already; the folder is the cluster's to clean
            pass

"""Session helpers: a tuned local session for tests and benches, and the
checkpoint folder taken from the session (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _driver_memory() -> str:
    """8 GiB, or 60 % of the machine's memory when that is less."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(8, int(total * 0.6 / 2**30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local session configured the way the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", _driver_memory()))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only when it is unset (local tests) a folder is made under /tmp.
    """
    conf = spark.sparkContext.getConf()
    master = spark.sparkContext.master
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not path:
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def drop_saved(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``saved`` wrote after its first ``since``, but for the last ``keep``.

    For use between steps, when no DataFrame still reads those tables;
    ``saved_count()`` at the start of the steps gives ``since``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(since, len(_written) - keep):
        if _written[k]:
            path = jvm.org.apache.hadoop.fs.Path(_written[k])
            path.getFileSystem(conf).delete(path, True)
            _written[k] = ""


def _drop_at_exit(spark: SparkSession) -> None:
    """Tables live as long as the driver; one whose session was stopped before leaves them to the folder's owner."""
    try:
        drop_saved(spark)
    except Exception:  # the session, or its JVM, is gone
        pass


def saved_count() -> int:
    return len(_written)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage without staging blocks on executors: the rows are
    computed once, and a lost executor loses none of them. The size of the
    result is known when later joins are planned. ``drop_saved`` deletes it, at the
    latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_at_exit, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that several branches read.

    Written once into the shared checkpoint folder, so the branches read the saved rows
    instead of recomputing them, and a lost executor does not send the job back to the
    source."""
    return saved(df, "step")

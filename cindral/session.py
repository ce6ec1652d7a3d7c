"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 * 1024 * 1024


_SHIPPED: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE); on a cluster use its own session."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package, once, to the session's Python workers, which need it wherever it is not installed there."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return spark
    _SHIPPED.add(spark.sparkContext.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="cindral-zip-")  # read by the driver alone, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "cindral.zip"), "w") as z:
        for base, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(base, n), os.path.relpath(os.path.join(base, n), os.path.dirname(home)))
    spark.sparkContext.addPyFile(os.path.join(folder, "cindral.zip"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a session on one machine may do without: it gets a temporary folder; elsewhere an unset folder raises."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = tempfile.mkdtemp(prefix="cindral-ck-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared checkpoint folder and reads it from there: what follows can be run again after the loss of any executor without computing df anew."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast if its counted rows times row_bytes stay within BROADCAST_BYTES; beyond, the join shuffles. df should be cheap to count or cut."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of tasks for `rows` rows: never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partitions df over the session's shuffle partitions (at least the cluster's cores) before costly Python work."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)

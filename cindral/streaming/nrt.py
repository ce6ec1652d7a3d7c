"""Near-real-time jobs on Structured Streaming: file ingest, tumbling and sliding windows, sessions, and events that keep their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindral.operators.linking import clustered, event_features
from cindral.session import checkpoint_dir, cut


def detections_stream(spark: SparkSession, path: str, schema: T.StructType, late: str = "24 hours", files: int | None = None) -> DataFrame:
    """Parquet files as they arrive; rows later than `late` behind the newest are dropped, repeated keys are dropped within it."""
    r = spark.readStream.schema(schema)
    d = (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)
    d = d.withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late)
    return d.dropDuplicatesWithinWatermark(["det_id"]) if "det_id" in d.columns else d


def hourly(stream: DataFrame, keys: list[str], value: str = "frp_mw", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and power by (sliding) window and keys."""
    w = F.window("t", width, slide) if slide else F.window("t", width)
    return stream.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("peak")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "peak")


def sessions(stream: DataFrame, keys: list[str], gap: str = "12 hours") -> DataFrame:
    """Runs of detections without a longer gap."""
    return stream.groupBy(F.session_window("t", gap), *keys).agg(F.count("*").alias("n"), F.max("frp_mw").alias("peak")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "peak")


def climatology_stream(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running mergeable state (n, mean, m2) of every series and hour: exactly once by the checkpoint."""
    from cindral.operators.series import climatology

    return climatology(stream, keys, value)


class EventTracker:
    """Keeps the events of the last hours in a table, batch by batch.

    A batch joins the kept detections, what is older than `lookback_s` behind the newest goes, the window is clustered again, and a
    cluster takes the identity that most of its known detections had (the smallest among equals), a new cluster that of its smallest key.
    The table is written under a new version and then pointed to, so a batch that is run again after a failure starts from the version
    before it and gives the same result. The last `versions` stay, older ones are removed once a newer one is complete. A batch costs
    the window, not the archive.
    """

    def __init__(self, spark: SparkSession, root: str, lookback_s: float = 86_400.0, max_gap_s: float = 43_200.0, extra_m: float = 2000.0, key: str = "det_id", versions: int = 3):
        self.spark, self.root, self.key = spark, root, key
        self.lookback_s, self.max_gap_s, self.extra_m, self.versions = lookback_s, max_gap_s, extra_m, versions
        checkpoint_dir(spark)

    def _path(self, batch: int) -> str:
        return f"{self.root}/v{batch:012d}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self) -> list[str]:
        """Names of the complete versions, oldest first."""
        path, fs = self._fs()
        root = path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS"))) if fs.exists(root) else []

    def state(self, before: int | None = None) -> DataFrame | None:
        """The newest complete version (of a batch before a number)."""
        names = [n for n in self._complete() if before is None or n < f"v{before:012d}"]
        return self.spark.read.parquet(f"{self.root}/{names[-1]}") if names else None

    def _tidy(self) -> None:
        path, fs = self._fs()
        for n in self._complete()[: -self.versions]:
            fs.delete(path(f"{self.root}/{n}"), True)

    def update(self, batch: DataFrame, number: int) -> DataFrame:
        """Runs one batch; gives the events that are new or changed: event_id, features, is_update."""
        old = self.state(number)
        batch = cut(batch)  # read by the clustering and by the report
        both = batch if old is None else old.drop("event_id").unionByName(batch.join(old.select(self.key), self.key, "left_anti"), allowMissingColumns=True)
        both = both.dropDuplicates([self.key])
        newest = F.broadcast(both.agg(F.max("t").alias("_new")))
        both = both.crossJoin(newest).where(F.unix_micros("t") >= F.unix_micros("_new") - int(self.lookback_s * 1e6)).drop("_new")
        c = clustered(both, self.key, max_gap_s=self.max_gap_s, extra_m=self.extra_m)
        if old is None:
            c = c.withColumn("event_id", F.col("root"))
        else:
            known = c.select(self.key, "root").join(old.select(self.key, "event_id"), self.key).groupBy("root", "event_id").agg(F.count("*").alias("n"))
            name = known.groupBy("root").agg(F.min_by("event_id", F.struct(-F.col("n"), "event_id")).alias("event_id"))
            # If an event split, the part with most of its rows keeps the name.
            heir = known.join(name, ["root", "event_id"]).groupBy("event_id").agg(F.min_by("root", F.struct(-F.col("n"), "root")).alias("root"))
            c = c.join(heir, "root", "left").withColumn("event_id", F.coalesce("event_id", "root"))
        c.drop("root").write.mode("overwrite").parquet(self._path(number))
        now = self.spark.read.parquet(self._path(number))
        self._tidy()
        touched = now.join(batch.select(self.key), self.key, "left_semi").select("event_id").distinct()
        before = (old.select("event_id").distinct() if old is not None else now.select("event_id").limit(0)).withColumn("_b", F.lit(True))
        return event_features(now.join(touched, "event_id", "left_semi"), "event_id").join(before, "event_id", "left").withColumn("is_update", F.coalesce("_b", F.lit(False))).drop("_b")

    def run(self, stream: DataFrame, checkpoint: str, sink: str, available_now: bool = True):
        """Starts the stream; events of each batch are written to sink/batch=N."""

        def step(batch: DataFrame, number: int) -> None:
            self.update(batch, number).write.mode("overwrite").parquet(f"{sink}/batch={number}")

        w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()

"""The detection archive: a partitioned Parquet store with a manifest, merge-writes, compaction and retention; label registry; JSON, CSV and KMZ sinks."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cindral.session import checked, cut

PARTS = ("year", "tile", "day")
DETECTIONS = T.StructType(
    [T.StructField("t", T.TimestampType()), T.StructField("tile_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "lon", "lat")]
    + [T.StructField("mask_code", T.ShortType())]
    + [T.StructField(c, T.FloatType()) for c in ("confidence", "frp_mw", "temp_k", "area_m2", "view_zenith_deg", "true_pixel_area_m2")]
    + [T.StructField("granule_key", T.StringType())]
)
MANIFEST = T.StructType([T.StructField("key", T.StringType()), T.StructField("scan_start", T.StringType()), T.StructField("status", T.StringType()), T.StructField("n_detections", T.LongType()), T.StructField("elapsed_s", T.DoubleType()), T.StructField("error", T.StringType())])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class DetectionStore:
    """root/detections/year=/tile=/day= and root/manifest; works on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root)
        self.rows, self.log, self.conf = f"{root}/detections", f"{root}/manifest", f"{root}/config.json"

    def check_config(self, config: dict) -> None:
        """Refuses to mix settings: the first call stores them, later ones must agree."""
        text = json.dumps(config, sort_keys=True, default=str)
        fs, p = _fs(self.spark, self.conf)
        if fs.exists(p):
            old = self.spark.read.text(self.conf, wholetext=True).first()[0]
            if json.loads(old) != json.loads(text):
                raise ValueError(f"store was built with {old}, not {text}")
            return
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self) -> DataFrame:
        if not _exists(self.spark, self.rows):
            return self.spark.createDataFrame([], T.StructType([*DETECTIONS.fields, T.StructField("year", T.IntegerType()), T.StructField("tile", T.StringType()), T.StructField("day", T.DateType())]))
        schema = T.StructType([*DETECTIONS.fields, T.StructField("year", T.IntegerType()), T.StructField("tile", T.StringType()), T.StructField("day", T.DateType())])
        return self.spark.read.schema(schema).parquet(self.rows)

    def manifest(self) -> DataFrame:
        """Last record of every key (a truncated line is ignored): that of the latest append, within one append the last line."""
        if not _exists(self.spark, self.log):
            return self.spark.createDataFrame([], MANIFEST)
        order = [T.StructField("batch", T.LongType()), T.StructField("line", T.LongType())]
        d = self.spark.read.schema(T.StructType([*MANIFEST.fields, *order])).option("mode", "DROPMALFORMED").json(self.log).where("key IS NOT NULL")
        return d.groupBy("key").agg(F.max_by(F.struct(*MANIFEST.names), F.struct("batch", "line")).alias("r")).select("r.*")

    def pending(self, keys: DataFrame, retry_failed: bool = True) -> DataFrame:
        """Keys not yet done."""
        done = self.manifest()
        done = done.where("status = 'ok'") if retry_failed else done
        return keys.join(done.select("key"), "key", "left_anti")

    def write(self, rows: DataFrame, records: DataFrame | None = None) -> None:
        """Merges a batch: rows of the partitions it touches are kept unless their granule is in the batch; rows first, manifest after.

        Partitions are compared null-safe: rows without time share one (year and day null), which is kept and merged like any other. Rows
        without granule are never replaced. Each append to the manifest gets a number above all before it.
        """
        tile = F.when(F.col("tile_id") == "", "outside_grid").otherwise(F.coalesce(F.translate("tile_id", "/", "_"), F.lit("unknown")))
        new = rows.select(*DETECTIONS.names).withColumn("year", F.year("t")).withColumn("tile", tile).withColumn("day", F.to_date("t"))
        new = cut(new)
        touched = cut(new.select(*PARTS).distinct())
        # The days of the batch are a static filter, so that only their partitions are read.
        n, timeless, lo, hi = touched.agg(F.count("*"), F.count_if(F.col("day").isNull()), F.min("day"), F.max("day")).first()
        if n:
            days = F.lit(False) if lo is None else F.col("day").between(lo, hi)
            old = self.read().where(days | F.col("day").isNull() if timeless else days)
            side = checked(touched.toDF(*(f"_{c}" for c in PARTS)))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTS]
            old = old.join(side, same, "left_semi").join(new.select("granule_key").distinct(), "granule_key", "left_anti").select(*new.columns)
            both = cut(old.unionByName(new))
            self._replace(both.repartition(*PARTS).sortWithinPartitions("t"))
        if records is not None:
            log = records.select(*MANIFEST.names).coalesce(1).withColumn("batch", F.lit(time.time_ns())).withColumn("line", F.monotonically_increasing_id())
            log.write.mode("append").json(self.log)

    def _replace(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PARTS).parquet(self.rows)

    def compact(self, min_files: int = 2, dry_run: bool = False) -> DataFrame:
        """Rewrites partitions of several files as one each, after counting the rows again on disk; a report of the partitions."""
        files = self.read().withColumn("_f", F.input_file_name()).groupBy(*PARTS).agg(F.count_distinct("_f").alias("files"), F.count("*").alias("rows"))
        todo = cut(files.where(F.col("files") >= min_files))
        if not dry_run and not todo.isEmpty():
            side = checked(todo.select(*(F.col(c).alias(f"_{c}") for c in PARTS)))
            rows = cut(self.read().join(side, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PARTS], "left_semi"))
            stage = f"{self.root}/.compact-{uuid.uuid4().hex}"
            rows.repartition("year", "tile", "day").sortWithinPartitions("t").write.option("compression", "zstd").partitionBy("year", "tile", "day").parquet(stage)
            want, got = todo.agg(F.sum("rows")).first()[0], self.spark.read.parquet(stage).count()
            fs, p = _fs(self.spark, stage)
            if want != got:
                fs.delete(p, True)
                raise RuntimeError(f"compaction wrote {got} rows of {want}; nothing was replaced")
            self._replace(self.spark.read.schema(self.read().schema).parquet(stage).repartition(*PARTS))
            fs.delete(p, True)
        return todo

    def prune(self, before: dt.date) -> int:
        """Drops the partitions of days before a date (by partition value, also compacted ones); their number."""
        old = self.read().where(F.col("day") < F.lit(before)).select("year", "tile", "day").distinct().collect()  # partitions, not rows
        for r in old:
            fs, p = _fs(self.spark, f"{self.rows}/year={r['year']}/tile={r['tile']}/day={r['day']}")
            fs.delete(p, True)
        return len(old)


def window_summary(det: DataFrame, pad_deg: float = 0.25) -> DataFrame:
    """One row: first and last day, days, padded box, rows."""
    d = det.agg(F.to_date(F.min("t")).alias("start_date"), F.to_date(F.max("t")).alias("end_date"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"), F.count("*").alias("n_detections"))
    return d.select("start_date", "end_date", (F.date_diff("end_date", "start_date") + 1).alias("n_days"), (F.col("w") - pad_deg).alias("west"), (F.col("s") - pad_deg).alias("south"), (F.col("e") + pad_deg).alias("east"), (F.col("n") + pad_deg).alias("north"), "n_detections")


def detection_rows(raw: DataFrame, region: str = "conus", filtered: bool = True, least_confidence: float = 0.0) -> DataFrame:
    """Rows of the store from decoded granule pixels (t, lon, lat, mask_code, frp_mw, ...): known codes, confidence by code, unreliable power nulled, projected, with tile."""
    from cindral.functions import codes
    from cindral.functions.grids import REGION_CRS, AnalysisGrid, project

    keep = codes.UNFILTERED_CODES + (codes.FILTERED_CODES if filtered else ())
    d = raw.where(F.col("mask_code").isin(*keep) & F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("confidence", codes.mask_confidence("mask_code").cast("float"))
    d = d.where(F.col("confidence") >= F.lit(least_confidence).cast("float")).withColumn("frp_mw", codes.reliable_frp("frp_mw", "mask_code"))
    x, y = project("lon", "lat", REGION_CRS[region])
    d = d.withColumn("x", x).withColumn("y", y)
    return d.withColumn("tile_id", AnalysisGrid(region).tile_id("x", "y"))


def brightness_temperature_channel(raw: DataFrame, saturation_k: float = 400.0) -> DataFrame:
    """Channel pixels with bad quality and saturated values nulled: bt_k, saturated. raw: bt, dqf."""
    good = F.when(F.col("dqf") <= 1, F.col("bt").cast("double"))
    return raw.withColumn("saturated", F.coalesce(good >= saturation_k, F.lit(False))).withColumn("bt_k", F.when(good < saturation_k, good))


def stacked(channels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """One column for each band of rows (keys, band, bt_k); pixels without all bands are dropped."""
    return channels.groupBy(*keys).pivot("band", bands).agg(F.first("bt_k", True)).dropna(subset=bands)


def grouped_by_time(keys: DataFrame, bands: list[str], tolerance_s: float = 120.0, reference: str | None = None) -> DataFrame:
    """For each file of the reference band the nearest file of every other band within the tolerance (earlier wins ties); incomplete ones are dropped. keys: key, band, t."""
    ref, w = reference or bands[0], int(tolerance_s * 1e6)
    k = keys.where(F.col("band").isin(*bands) & F.col("t").isNotNull()).withColumn("u", F.unix_micros("t"))
    r = k.where(F.col("band") == ref).select(F.col("key").alias("ref_key"), F.col("u").alias("ru")).withColumn("b", F.explode(F.sequence(F.floor(F.col("ru") / w) - 1, F.floor(F.col("ru") / w) + 1)))
    gap = F.abs(F.col("u") - F.col("ru"))
    p = k.withColumn("b", F.floor(F.col("u") / w)).join(r, "b").where(gap <= w)
    best = p.groupBy("ref_key", "ru", "band").agg(F.min_by("key", F.struct(gap.alias("g"), "u", "key")).alias("key"))
    return best.groupBy("ref_key", "ru").agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("files")).where(F.size("files") == len(bands)).select("ref_key", F.timestamp_micros("ru").alias("t"), "files")


# --- registry, JSON, CSV, KMZ ---

# Quality of label sources.
SOURCE_QUALITY = {
    "cbi": "field", "nirops": "airborne_ir", "copernicus_ems": "vhr_human", "mtbs": "analyst_qc", "effis": "analyst_qc", "nbac": "highres_auto", "landsat_c2_l3_ba": "highres_auto",
    "feds": "coarse_auto", "mcd64a1": "coarse_auto", "globfire": "coarse_auto", "wfigs": "administrative", "welty_jeffries": "administrative", "cnfdb": "administrative", "fpa_fod": "administrative",
}


def source_quality(source: Column) -> Column:
    from cindral.functions._num import lookup

    return lookup(F.lower(source), SOURCE_QUALITY)


def write_registry(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry with ISO dates as dates and attributes parsed."""
    d = spark.read.parquet(path)
    for c in ("ignition_date", "containment_date"):
        if c in d.columns:
            d = d.withColumn(c, F.try_to_date(F.col(c).cast("string")))
    return d.withColumn("attributes", F.from_json("attributes", "map<string,string>")) if "attributes" in d.columns else d


def registry_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("region", "source").agg(F.count("*").alias("n")).orderBy("region", "source")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def feature_rows(events: DataFrame, properties: list[str], ring: str = "ring") -> DataFrame:
    """One GeoJSON feature (text) for each event."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.col(ring)).alias("coordinates"))
    return events.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def _shown(events: DataFrame, limit: int, strength: str, key: str) -> tuple[DataFrame, int]:
    """The `limit` strongest events (nulls last, ties by key where there are such columns), and how many are left out."""
    order = [F.desc_nulls_last(strength)] if strength in events.columns else []
    order += [F.col(key)] if key in events.columns else [F.xxhash64(*events.columns)]
    return events.orderBy(*order).limit(limit), max(0, events.count() - limit)


def feature_collection(events: DataFrame, properties: list[str], limit: int = 5000, strength: str = "frp_max", key: str = "event_id") -> str:
    """A FeatureCollection of the `limit` strongest events, what one web page can show; `omitted` is the number of the others."""
    rows, omitted = _shown(events, limit, strength, key)
    features = ",".join(r["feature"] for r in feature_rows(rows, properties).collect())
    return f'{{"type":"FeatureCollection","omitted":{omitted},"features":[{features}]}}'


def write_kmz(events: DataFrame, path: str, name: str = "name", color: str = "color", ring: str = "ring", limit: int = 5000, strength: str = "frp_max", key: str = "event_id") -> tuple[int, int]:
    """Zipped KML of the `limit` strongest polygons; (written, left out), also named in the document."""
    shown, omitted = _shown(events, limit, strength, key)
    rows = shown.select(name, color, ring).collect()
    marks = []
    for r in rows:
        c = (r[color] or "#8A8F98").lstrip("#")
        xy = " ".join(f"{p[0]:.5f},{p[1]:.5f},0" for p in r[ring])
        style = f"<Style><PolyStyle><color>99{c[4:6]}{c[2:4]}{c[0:2]}</color></PolyStyle></Style>"
        area = f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{xy}</coordinates></LinearRing></outerBoundaryIs></Polygon>"
        marks.append(f"<Placemark><name>{escape(str(r[name]))}</name>{style}{area}</Placemark>")
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    note = f"<description>{omitted} weaker events are left out</description>" if omitted else ""
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", head + note + "".join(marks) + "</Document></kml>")
    return len(rows), omitted


def parse_current_weather(text: Column) -> Column:
    """Struct (temp_c, rh_pct, wind_ms) of a weather service's JSON reply."""
    s = F.from_json(text, "current struct<temperature_2m:double,relative_humidity_2m:double,wind_speed_10m:double>")
    return F.struct(s["current"]["temperature_2m"].alias("temp_c"), s["current"]["relative_humidity_2m"].alias("rh_pct"), s["current"]["wind_speed_10m"].alias("wind_ms"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class ClimatologyStore:
    """A climatology that grows: root/states (keys, bin, n, mean, m2; one file set a version) and root/done (keys of processed granules).

    A batch is added once: granules already in a version are left out, and each version holds its states and its granules together, so a
    batch that is run again after a failure finds what was complete and nothing else. The last `versions` stay.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], value: str, versions: int = 2):
        self.spark, self.root, self.keys, self.value, self.versions = spark, str(root), keys, value, versions

    def _complete(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if _exists(self.spark, f"{s.getPath()}/done/_SUCCESS")) if fs.exists(p) else []

    def _read(self, part: str) -> DataFrame | None:
        names = self._complete()
        return self.spark.read.parquet(f"{self.root}/{names[-1]}/{part}") if names else None

    def states(self) -> DataFrame | None:
        return self._read("states")

    def done(self) -> DataFrame | None:
        return self._read("done")

    def add(self, rows: DataFrame, granule: str = "granule_key", t: str = "t") -> int:
        """Adds the rows of granules that are not in yet; the number of such granules."""
        from cindral.operators.series import climatology, merged_climatology

        old, done = self.states(), self.done()
        rows = rows.where(F.col(granule).isNotNull())
        rows = cut(rows if done is None else rows.join(done, granule, "left_anti"))
        new = cut(rows.select(granule).distinct())
        n = new.count()
        if not n:
            return 0
        states = climatology(rows, self.keys, self.value, t)
        states = states if old is None else merged_climatology(old.unionByName(states), self.keys)
        names = self._complete()
        path = f"{self.root}/v{(int(names[-1][1:]) if names else 0) + 1:09d}"
        states.write.mode("overwrite").parquet(f"{path}/states")
        (new if done is None else done.unionByName(new)).write.mode("overwrite").parquet(f"{path}/done")  # last, as the mark of a complete version
        for name in self._complete()[: -self.versions]:
            fs, p = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(p, True)
        return n


def read_sqlite(spark: SparkSession, path: str, table: str, columns: dict[str, str], rows: int = 100_000) -> DataFrame:
    """A table of a SQLite file that every machine can read: columns (name -> Spark type), read by ranges of its row numbers in parallel."""
    import sqlite3

    quote = lambda n: '"' + n.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        last = c.execute(f"SELECT coalesce(max(rowid), 0) FROM {quote(table)}").fetchone()[0]
    sql = f"SELECT {', '.join(quote(c) for c in columns)} FROM {quote(table)} WHERE rowid > ? AND rowid <= ?"
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def run(batches):
        import sqlite3

        import pandas as pd

        for b in batches:
            for k in b["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                    got = c.execute(sql, (int(k) * rows, (int(k) + 1) * rows)).fetchall()
                yield pd.DataFrame({n: pd.Series([r[i] for r in got], dtype=object) for i, n in enumerate(columns)})

    parts = max(1, -(-last // rows))
    return spark.range(parts).repartition(parts).mapInPandas(run, schema)


def write_occurrences(df: DataFrame, path: str) -> None:
    """Normalised fire occurrences as Parquet, in parts by year."""
    df.repartition("year").sortWithinPartitions("id").write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)

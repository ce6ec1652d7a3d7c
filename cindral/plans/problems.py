"""Queries of the general problems (2, 4, 5) over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindral.frames import read
from cindral.functions.sphere import EARTH_M
from cindral.operators.drift import drift, file_schemas, lineages, unified
from cindral.operators.regions import points_in_regions
from cindral.operators.spikes import implausible


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of fields from file to file: file_id, field_name, change_kind."""
    lines = read(spark, sf_dir, "raw_lines", "feed_id", "file_no", "file_id", "body")
    return drift(lines)["changes"].select("file_id", "field_name", "change_kind")


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as one table of the fields that the feeds know under some name."""
    lines = read(spark, sf_dir, "raw_lines", "feed_id", "file_no", "file_id", "line_no", "body")
    got = drift(lines)
    return unified(lines, got["schemas"], lineages(got["schemas"], got["renames"]), ["file_id", "line_no"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections within a point site's radius or inside an area site: site_id, det_id."""
    det = read(spark, sf_dir, "detections", "det_id", "lon", "lat")
    return points_in_regions(det, read(spark, sf_dir, "sites"), "det_id", "site_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings: det_id, field_name."""
    det = read(spark, sf_dir, "detections", "det_id", "pixel_id", "t", "frp_mw", "temp_k", "view_zenith_deg")
    return implausible(det).select("det_id", "field_name")


def p5_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible readings and stuck runs, the parts of p5_found that need no model: det_id, field_name, impossible, stuck."""
    det = read(spark, sf_dir, "detections", "det_id", "pixel_id", "t", "frp_mw", "temp_k", "view_zenith_deg")
    return implausible(det).where("impossible OR stuck").select("det_id", "field_name", "impossible", "stuck")


def p2_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused schema of every file: file_id, field_name, kind, n (values of that JSON type, `null` included)."""
    lines = read(spark, sf_dir, "raw_lines", "feed_id", "file_no", "file_id", "body")
    return file_schemas(lines, "feed_id", "file_no", "file_id", "body").select("file_id", F.col("path").alias("field_name"), F.explode("alternatives").alias("kind", "n"))


def p2_new_and_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p2_found says of fields that are new or gone, renamed or not: file_id, new (names), gone (names)."""
    lines = read(spark, sf_dir, "raw_lines", "feed_id", "file_no", "file_id", "body")
    got = drift(lines)
    changes = got["changes"].where("change_kind <> 'retyped'")
    gone = F.when(F.col("change_kind") == "removed", F.col("field_name")).otherwise(F.col("old_name"))
    new = F.when(F.col("change_kind") != "removed", F.col("field_name"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return changes.groupBy("file_id").agg(listed(new).alias("new"), listed(gone).alias("gone"))


QUERIES = {"p2_found": p2_found, "p2_unified": p2_unified, "p2_schemas": p2_schemas, "p2_new_and_gone": p2_new_and_gone, "p4_found": p4_found, "p5_found": p5_found, "p5_certain": p5_certain}

# Leaves of the readable lines by the JSON functions, three levels deep: arrays are leaves, empty objects are none.
_LEAVES = """
l AS (SELECT DISTINCT feed_id, file_no, file_id, body FROM raw_lines WHERE feed_id IS NOT NULL AND file_no IS NOT NULL AND json_valid(body)),
j AS (SELECT feed_id, file_no, file_id, body::JSON AS j FROM l WHERE json_type(body::JSON) = 'OBJECT'),
k1 AS (SELECT feed_id, file_no, file_id, unnest(json_keys(j)) AS p, unnest(list_transform(json_keys(j), lambda k: j -> ('$."' || k || '"'))) AS v FROM j),
k2 AS (SELECT feed_id, file_no, file_id, p, v FROM k1 WHERE json_type(v) <> 'OBJECT' UNION ALL
       SELECT feed_id, file_no, file_id, p || '.' || unnest(json_keys(v)), unnest(list_transform(json_keys(v), lambda k: v -> ('$."' || k || '"'))) FROM k1 WHERE json_type(v) = 'OBJECT'),
k3 AS (SELECT feed_id, file_no, file_id, p, v FROM k2 WHERE json_type(v) <> 'OBJECT' UNION ALL
       SELECT feed_id, file_no, file_id, p || '.' || unnest(json_keys(v)), unnest(list_transform(json_keys(v), lambda k: v -> ('$."' || k || '"'))) FROM k2 WHERE json_type(v) = 'OBJECT'),
leaf AS (SELECT feed_id, file_no, file_id, p, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM k3)"""

SQL = {
    "p2_schemas": f"WITH {_LEAVES} SELECT file_id, p AS field_name, kind, count(*) AS n FROM leaf GROUP BY 1, 2, 3",
    "p2_new_and_gone": f"""
WITH {_LEAVES},
h AS (SELECT DISTINCT feed_id, file_no, file_id, p FROM leaf), f AS (SELECT DISTINCT feed_id, file_no, file_id FROM h),
b AS (SELECT *, lag(file_id) OVER (PARTITION BY feed_id ORDER BY file_no) AS before FROM f),
n AS (SELECT b.file_id, h.p FROM b JOIN h ON h.file_id = b.file_id WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h o WHERE o.file_id = b.before AND o.p = h.p)),
g AS (SELECT b.file_id, h.p FROM b JOIN h ON h.file_id = b.before WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.file_id = b.file_id AND o.p = h.p)),
e AS (SELECT file_id FROM n UNION SELECT file_id FROM g)
SELECT file_id, coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM n WHERE n.file_id = e.file_id), '') AS new,
  coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM g WHERE g.file_id = e.file_id), '') AS gone FROM e
""",
    "p5_certain": """
WITH d AS (SELECT DISTINCT det_id, pixel_id, t, frp_mw, temp_k, view_zenith_deg FROM detections WHERE pixel_id IS NOT NULL AND det_id IS NOT NULL),
r AS (SELECT det_id, pixel_id, t, 'frp_mw' AS f, frp_mw AS v, 0 AS lo, 100000 AS hi FROM d UNION ALL SELECT det_id, pixel_id, t, 'temp_k', temp_k, 20, 2000 FROM d UNION ALL SELECT det_id, pixel_id, t, 'view_zenith_deg', view_zenith_deg, 0, 90 FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, f ORDER BY t, det_id) - row_number() OVER (PARTITION BY pixel_id, f, v ORDER BY t, det_id) AS run FROM r WHERE v IS NOT NULL AND t IS NOT NULL),
c AS (SELECT det_id, f, f <> 'view_zenith_deg' AND count(*) OVER (PARTITION BY pixel_id, f, v, run) >= 5 AS stuck FROM s)
SELECT r.det_id, r.f AS field_name, v < lo OR v > hi AS impossible, coalesce(stuck, false) AS stuck FROM r LEFT JOIN c ON c.det_id = r.det_id AND c.f = r.f
WHERE v IS NOT NULL AND (v < lo OR v > hi OR coalesce(stuck, false))
""",
    "p4_found": f"""
WITH d AS (SELECT DISTINCT det_id, lon, lat FROM detections WHERE lon IS NOT NULL AND lat IS NOT NULL),
p AS (SELECT s.site_id, d.det_id FROM sites s JOIN d
      ON d.lat BETWEEN s.lat - s.radius_m / 111000.0 AND s.lat + s.radius_m / 111000.0
      WHERE s.radius_m IS NOT NULL
        AND 2 * {EARTH_M} * asin(sqrt(least(1.0, pow(sin(radians(d.lat - s.lat) / 2), 2)
            + cos(radians(s.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - s.lon) / 2), 2)))) <= s.radius_m),
e AS (SELECT site_id, unnest(range(1, len(ring_lon) + 1)) AS i, ring_lon, ring_lat FROM sites WHERE ring_lon IS NOT NULL),
g AS (SELECT site_id, ring_lon[i] AS x1, ring_lat[i] AS y1, ring_lon[i % len(ring_lon) + 1] AS x2, ring_lat[i % len(ring_lon) + 1] AS y2 FROM e),
a AS (SELECT g.site_id, d.det_id FROM g JOIN d ON d.lat BETWEEN least(y1, y2) AND greatest(y1, y2)
      WHERE (y1 > d.lat) <> (y2 > d.lat) AND d.lon < x1 + (x2 - x1) / (y2 - y1) * (d.lat - y1)
      GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT site_id, det_id FROM p UNION SELECT site_id, det_id FROM a
""",
}

"""Queries of the problems tagged llm over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindral.frames import read
from cindral.functions.sphere import EARTH_M
from cindral.llm.bpe import encoded
from cindral.llm.components import components, event_links
from cindral.llm.mojibake import garbled, restored
from cindral.llm.nearest_time import nearest_in_time
from cindral.llm.overlap import overlap_report, overlaps
from cindral.llm.packing import packed
from cindral.sources import firms as firms_csv


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection nearest in time to each FIRMS record within 2,000 m and 900 s: det_id, firms_id."""
    det = read(spark, sf_dir, "detections", "det_id", "t", "lon", "lat")
    firms = read(spark, sf_dir, "firms", "firms_id", "latitude", "longitude", "acq_date", "acq_time")
    lon, lat = firms_csv.position(F.col("longitude"), F.col("latitude"))
    firms = firms.select("firms_id", lon.alias("lon"), lat.alias("lat"), firms_csv.acquired(F.col("acq_date"), F.col("acq_time")).alias("t"))
    return nearest_in_time(firms, det, "firms_id", "det_id", 900, 2000).select("det_id", "firms_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every detection linked by a match or an event: det_id, group_id."""
    pairs = read(spark, sf_dir, "match_pairs", "det_a", "det_b", "verdict").where("verdict = 'match'").select(F.col("det_a").alias("a"), F.col("det_b").alias("b"))
    events = event_links(read(spark, sf_dir, "event_responses", "event_id", "det_ids"))
    return components(pairs.unionByName(events), "a", "b", "det_id")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found by small grid cells (2,000 edges), so that rounds over a grid of several cells run at any size."""
    pairs = read(spark, sf_dir, "match_pairs", "det_a", "det_b", "verdict").where("verdict = 'match'").select(F.col("det_a").alias("a"), F.col("det_b").alias("b"))
    events = event_links(read(spark, sf_dir, "event_responses", "event_id", "det_ids"))
    return components(pairs.unionByName(events), "a", "b", "det_id", cell_edges=2_000)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one fire in the train part and in another part of a fold: fold, split_name, uid_a, uid_b."""
    got = overlaps(read(spark, sf_dir, "example_units"), read(spark, sf_dir, "leave_year_out", "fold", "split_name", "uid"))
    return got.select("fold", "split_name", "uid_a", "uid_b").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per fold, part and label source, with how much of the records the other covers."""
    return overlap_report(read(spark, sf_dir, "example_units"), read(spark, sf_dir, "leave_year_out", "fold", "split_name", "uid"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token identifiers (byte_bpe_50k) of every document: doc_id, ids."""
    return encoded(read(spark, sf_dir, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens of every document or piece: doc_id, piece, start, n, bin_id."""
    sizes = encoded(read(spark, sf_dir, "documents", "doc_id", "text"), counts_only=True)
    return packed(sizes)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which any stretch was decoded wrongly: doc_id."""
    return garbled(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with verified originals in place: doc_id, restored, left."""
    return restored(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_grid": p3_grid, "p6_found": p6_found, "p6_report": p6_report, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_restored": p9_restored}

SQL = {
    # Numbers are written out here, so that a change of the operator's constants shows.
    "p6_found": """
WITH m AS (SELECT DISTINCT fold, split_name, uid FROM leave_year_out WHERE fold IS NOT NULL AND uid IS NOT NULL AND split_name IN ('train', 'val', 'test')),
u0 AS (SELECT DISTINCT uid, (lon + 180) - 360 * floor((lon + 180) / 360) AS x, lat AS y, regexp_replace(regexp_replace(lower(fire_name), '[^\\p{L}\\p{N}]', '', 'g'), '(.)fire$', '\\1') AS n,
         CASE WHEN area_ha > 0 THEN area_ha END AS area, when_date AS day, group_id AS g, lower(ecoregion) AS eco FROM example_units WHERE lon IS NOT NULL AND lat IS NOT NULL),
u AS (SELECT *, nullif(n, '') AS name FROM u0),
p AS (SELECT a.uid AS t, b.uid AS o, least(abs(a.x - b.x), 360 - abs(a.x - b.x)) AS dx, abs(a.y - b.y) AS dy, a.name AS n1, b.name AS n2, least(length(a.name), length(b.name)) AS n,
        a.area IS NOT NULL AND b.area IS NOT NULL AS ab, greatest(a.area, b.area) AS big, least(a.area, b.area) AS small,
        coalesce(a.g = b.g, false) AS g, coalesce(strftime(a.day, '%m%d') = strftime(b.day, '%m%d'), false) AS md,
        a.day IS NOT NULL AND b.day IS NOT NULL AS db, abs(date_diff('day', a.day, b.day)) AS apart,
        abs(dayofyear(a.day) - dayofyear(b.day)) AS doy, coalesce(a.eco = b.eco, false) AS eco, a.eco IS NULL OR b.eco IS NULL AS noeco
      FROM u a JOIN u b ON a.uid <> b.uid AND b.y BETWEEN a.y - 0.0178 AND a.y + 0.0178 AND least(abs(a.x - b.x), 360 - abs(a.x - b.x)) <= 0.0178),
q AS (SELECT *, ab AND (small >= 0.968 * big OR big - small <= 0.5) AS size, small >= 0.995 * big OR big - small <= 0.5 AS eqsize,
        g AND db AND NOT md AND apart <= 31 AS part, least(doy, 365 - doy) <= 31 AS season,
        n1 = n2 OR (n >= 5 AND (levenshtein(n1, n2) <= CASE WHEN n >= 9 THEN 3 ELSE 2 END
          OR (levenshtein(n1[:n], n2[:n]) <= 2 AND abs(length(n1) - length(n2)) <= 8))) AS sim FROM p),
v AS (SELECT t, o FROM q WHERE
   (n1 IS NOT NULL AND n2 IS NOT NULL AND dx <= 0.011 AND dy <= 0.011
     AND ((size AND sim AND ((dx <= 0.0066 AND dy <= 0.0066 AND eqsize) OR NOT part))
       OR (NOT ab AND sim AND (coalesce(season, true) OR g) AND (dx + dy = 0 OR NOT part))))
   OR ((n1 IS NULL OR n2 IS NULL)
     AND ((size AND ((g AND (dx + dy = 0 OR NOT part)) OR (NOT g AND CASE WHEN db THEN season AND (eco OR noeco) ELSE eco END)))
          OR (NOT ab AND g AND md))))
SELECT DISTINCT a.fold, b.split_name, least(a.uid, b.uid) AS uid_a, greatest(a.uid, b.uid) AS uid_b
FROM m a JOIN m b ON a.fold = b.fold AND a.split_name = 'train' AND b.split_name <> 'train'
WHERE a.uid = b.uid OR EXISTS (SELECT 1 FROM v WHERE v.t = a.uid AND v.o = b.uid)
""",
    "p3_found": """
WITH RECURSIVE ev AS (SELECT DISTINCT lower(trim(event_id)) AS e, unnest(det_ids) AS d FROM event_responses WHERE event_id IS NOT NULL),
lk AS (SELECT det_a AS a, det_b AS b FROM match_pairs WHERE verdict = 'match' AND det_a <> det_b
       UNION SELECT d, m FROM ev JOIN (SELECT e, min(d) AS m FROM ev GROUP BY e) USING (e) WHERE d <> m),
bi AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
cc(det_id, group_id) USING KEY (det_id) AS (
  SELECT a, min(least(a, b)) FROM bi GROUP BY a
  UNION
  SELECT n.det_id, n.g FROM (SELECT b.a AS det_id, min(c.group_id) AS g FROM cc c JOIN bi b ON b.b = c.det_id GROUP BY b.a) n
  JOIN recurring.cc r ON r.det_id = n.det_id WHERE n.g < r.group_id)
SELECT det_id, group_id FROM cc
""",
    "p1_found": f"""
WITH f0 AS (SELECT DISTINCT firms_id, TRY_CAST(trim(longitude) AS DOUBLE) AS x, TRY_CAST(trim(latitude) AS DOUBLE) AS y,
              replace(replace(trim(acq_date), '/', ''), '-', '') AS d, trim(acq_time) AS c FROM firms),
f1 AS (SELECT firms_id, CASE WHEN x > 180 THEN x - 360 ELSE x END AS lon, y AS lat, d,
              CASE WHEN c LIKE '%:%' THEN lpad(replace(c, ':', ''), 4, '0') WHEN regexp_full_match(c, '[0-9]{{1,4}}') THEN lpad(c, 4, '0') END AS hm
       FROM f0 WHERE x BETWEEN -180 AND 360 AND y BETWEEN -90 AND 90),
f AS (SELECT firms_id, lon, lat, TRY_STRPTIME(d || hm, '%Y%m%d%H%M') AS t FROM f1 WHERE regexp_full_match(hm, '([01][0-9]|2[0-3])[0-5][0-9]')),
d AS (SELECT DISTINCT det_id, t, lon, lat FROM detections WHERE t IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL),
p AS (SELECT f.firms_id, d.det_id, abs(epoch_us(d.t) - epoch_us(f.t)) AS gap FROM f JOIN d
      ON d.t BETWEEN f.t - INTERVAL 900 SECOND AND f.t + INTERVAL 900 SECOND
      WHERE 2 * {EARTH_M} * asin(sqrt(least(1.0, pow(sin(radians(d.lat - f.lat) / 2), 2)
            + cos(radians(f.lat)) * cos(radians(d.lat)) * pow(sin(radians(d.lon - f.lon) / 2), 2)))) <= 2000)
SELECT det_id, firms_id FROM (SELECT *, row_number() OVER (PARTITION BY firms_id ORDER BY gap, det_id) AS i FROM p) WHERE i = 1
""",
}

SQL["p3_grid"] = SQL["p3_found"]

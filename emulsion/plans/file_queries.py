"""Queries over files and saved state: listing, pairing, neighbours, numbering, restoring, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, relate
from ..sources import session
from . import views
from .registry import query

STEM = r"regexp_extract(name, '(?s)^(.+?)(\.[^.]*)?$', 1)"
SUFFIX = r"lower(regexp_extract(name, '(?s)^.+?(\.[^.]*)$', 1))"
RAWS = "('.arw', '.raw', '.dng', '.cr2', '.cr3', '.nef', '.raf', '.orf', '.rw2')"
SUPPORTED = views.FILES + f", su AS (SELECT * FROM fl WHERE {SUFFIX} IN {RAWS} AND NOT regexp_matches(lower({STEM}), '(_positive|-positive| positive)$'))"
PLACED = SUPPORTED + ", po AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY lower(name), name, file_id) - 1 AS pos, count(*) OVER (PARTITION BY folder) AS total FROM su)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.positions(relate.supported(views.files(spark, sf_dir)))


@query("supported_files", f"WITH {SUPPORTED} SELECT file_id, folder, name FROM su")
def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.supported(views.files(spark, sf_dir))


@query("file_positions", f"WITH {PLACED} SELECT file_id, folder, name, pos, total, (pos + 1) || ' / ' || total AS status FROM po")
def file_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir)


@query("nearby_files", f"WITH {PLACED}, ap AS (SELECT folder, pos AS at_pos FROM po) SELECT folder, at_pos, file_id, pos, row_number() OVER (PARTITION BY folder, at_pos ORDER BY abs(pos - at_pos), pos) AS near FROM po JOIN ap USING (folder) WHERE pos <> at_pos AND abs(pos - at_pos) <= 3")
def nearby_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    return ordered.nearby(p, p, 3)


@query(
    "next_after_removal",
    f"""WITH {PLACED}, k AS (SELECT *, CASE WHEN pos % 3 <> 1 THEN file_id END AS kept FROM po)
SELECT file_id, coalesce(first_value(kept IGNORE NULLS) OVER (PARTITION BY folder ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), last_value(kept IGNORE NULLS) OVER (PARTITION BY folder ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS show_id
FROM k QUALIFY pos % 3 = 1""",
)
def next_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.next_kept(placed(spark, sf_dir), F.col("pos") % 3 == 1).select("file_id", "show_id")


@query("selected_range", f"WITH {PLACED} SELECT file_id, folder, pos FROM po WHERE pos BETWEEN 2 AND 7")
def selected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.selected_range(placed(spark, sf_dir), F.lit(7), F.lit(2)).select("file_id", "folder", "pos")


@query("export_names", f"WITH {SUPPORTED}, n AS (SELECT file_id, folder, folder || '_' || printf('%03d', row_number() OVER (PARTITION BY folder ORDER BY lower(name), name, file_id)) AS output FROM su) SELECT file_id, output FROM n WHERE file_id % 4 <> 0")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are given before the outputs that exist are skipped."""
    s = relate.supported(views.files(spark, sf_dir))
    return ordered.sequence_names(s, F.concat("folder", F.lit("_"))).filter("file_id % 4 != 0").select("file_id", "output")


RANK = f"(CASE {SUFFIX} WHEN '.png' THEN 0 WHEN '.tif' THEN 1 WHEN '.tiff' THEN 1 WHEN '.jpg' THEN 2 WHEN '.jpeg' THEN 2 WHEN '.webp' THEN 3 WHEN '.bmp' THEN 4 END)"


@query(
    "paired_files",
    f"""WITH {SUPPORTED}, ra AS (SELECT folder, {STEM} AS stem, min(file_id) AS negative_id FROM su GROUP BY ALL HAVING count(*) = 1),
im AS (SELECT folder, {STEM} AS stem, {RANK} AS rk, file_id FROM fl WHERE {RANK} IS NOT NULL), bg AS (SELECT folder, stem, rk, count(*) AS n, min(file_id) AS positive_id FROM im GROUP BY folder, stem, rk), bs AS (SELECT * FROM bg QUALIFY row_number() OVER (PARTITION BY folder, stem ORDER BY rk) = 1)
SELECT folder, stem, negative_id, positive_id FROM ra JOIN bs USING (folder, stem) WHERE n = 1 AND stem >= 'IMG_0010' AND stem <= 'IMG_0650'""",
)
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.pair_files(views.files(spark, sf_dir), "IMG_0010", "IMG_0650")


@query(
    "files_without_partner",
    f"""WITH {views.FILES}, by_ AS (SELECT folder, {STEM} AS stem, count(*) FILTER ({SUFFIX} IN {RAWS}) AS r, count(*) FILTER ({RANK} IS NOT NULL) AS i FROM fl GROUP BY ALL)
SELECT folder, count(*) FILTER (r > 0 AND i = 0) AS raws_alone, count(*) FILTER (r = 0 AND i > 0) AS images_alone, count(*) FILTER (r > 1) AS ambiguous FROM by_ GROUP BY folder""",
)
def files_without_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.without_partner(views.files(spark, sf_dir))


STATS = views.FILES + ", fs AS (SELECT file_id, folder, name, CASE WHEN file_id % 11 = 0 THEN NULL ELSE file_id * 100 END AS size, file_id * 1000003 AS mtime_ns FROM fl)"


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).withColumns({"size": F.when(F.col("file_id") % 11 != 0, F.col("file_id") * 100), "mtime_ns": F.col("file_id") * 1000003})


@query(
    "restored_state",
    f"WITH {STATS}, sv AS (SELECT folder, name, CASE WHEN file_id % 3 = 0 THEN size + 1 ELSE size END AS size, mtime_ns, file_id % 9 AS rating FROM fs) SELECT fs.file_id, sv.rating AS rating FROM fs JOIN sv ON fs.folder || fs.name = sv.folder || sv.name AND fs.size IS NOT DISTINCT FROM sv.size AND fs.mtime_ns IS NOT DISTINCT FROM sv.mtime_ns",
)
def restored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null sizes match null sizes; changed ones don't."""
    f = stated(spark, sf_dir).withColumn("name", F.concat("folder", "name"))
    saved = f.select("name", F.when(F.col("file_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime_ns", (F.col("file_id") % 9).alias("rating"))
    return relate.restored(f, saved).select("file_id", F.col("saved_rating").alias("rating"))


@query("excluded_files", f"WITH {SUPPORTED} SELECT s.file_id, s.name FROM su s WHERE NOT EXISTS (SELECT 1 FROM su x WHERE x.file_id % 5 = 0 AND x.folder = s.folder AND x.name = s.name)")
def excluded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relate.supported(views.files(spark, sf_dir))
    return s.join(s.filter("file_id % 5 = 0").select("folder", "name"), ["folder", "name"], "left_anti").select("file_id", "name")


@query("filmstrip_badges", f"WITH {SUPPORTED} SELECT file_id, coalesce(file_id % 2 = 0 AND file_id % 3 = 0, false) AS positive FROM su")
def filmstrip_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relate.supported(views.files(spark, sf_dir))
    state = s.filter("file_id % 3 = 0").select(F.col("file_id").alias("_id"), (F.col("file_id") % 2 == 0).alias("active"))
    return s.join(state, F.col("file_id") == F.col("_id"), "left").select("file_id", F.coalesce("active", F.lit(False)).alias("positive"))


@query("overlaid_registry", f"WITH {views.FILES}, a AS (SELECT file_id AS id, name, folder FROM fl WHERE file_id % 3 <> 0), o AS (SELECT file_id AS id, upper(name) AS name, NULL::VARCHAR AS folder FROM fl WHERE file_id % 2 = 0) SELECT coalesce(o.id, a.id) AS id, coalesce(o.name, a.name) AS name, coalesce(o.folder, a.folder) AS folder FROM a FULL JOIN o ON a.id = o.id")
def overlaid_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select(F.col("file_id").alias("id"), "name", "folder")
    over = f.filter("id % 2 = 0").select("id", F.upper("name").alias("name"), F.lit(None).cast("string").alias("folder"))
    return relate.overlaid(f.filter("id % 3 != 0"), over, "id", ["name", "folder"])


@query("merged_state", f"WITH {views.FILES}, a AS (SELECT file_id AS id, name, folder FROM fl WHERE file_id % 3 <> 0), n AS (SELECT file_id AS id, lower(name) AS name, CASE WHEN file_id % 4 = 0 THEN 'new' END AS folder FROM fl WHERE file_id % 2 = 0) SELECT coalesce(a.id, n.id) AS id, coalesce(a.name, n.name) AS name, coalesce(n.folder, a.folder) AS folder FROM a FULL JOIN n ON a.id = n.id")
def merged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select(F.col("file_id").alias("id"), "name", "folder")
    new = f.filter("id % 2 = 0").select("id", F.lower("name").alias("name"), F.when(F.col("id") % 4 == 0, "new").alias("folder"))
    return relate.merged_state(f.filter("id % 3 != 0"), new, "id", ["name"], ["folder"])


@query("composed_mask", f"WITH {views.RASTER} SELECT frame_id, y, x FROM rs WHERE (g > 0.8 OR r < 0.1) AND NOT (b > 0.9)")
def composed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.raster(spark, sf_dir)
    return relate.composed_mask(p.filter("g > 0.8"), p.filter("r < 0.1"), p.filter("b > 0.9"), ["frame_id", "y", "x"])


@query(
    "label_reasons",
    "WITH l AS (SELECT p_partkey AS id, p_size AS inliers, (p_retailprice - floor(p_retailprice / 10) * 10) / 10 AS ratio FROM part), c AS (SELECT *, CASE WHEN inliers < 12 THEN 'too_few_inliers' WHEN ratio < 0.2 THEN 'low_inlier_ratio' WHEN inliers > 45 THEN 'out_of_bounds' ELSE 'ok' END AS reason FROM l) SELECT reason, count(*) AS n, CAST(sum(CASE WHEN ratio >= 0.95 THEN 100 WHEN ratio >= 0.85 THEN 72 WHEN ratio >= 0.70 THEN 42 ELSE 20 END) AS BIGINT) AS weight FROM c GROUP BY reason",
)
def label_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing test names the reason; weights come from the confidence."""
    price = F.col("p_retailprice")
    d = views.table(spark, sf_dir, "part").select(F.col("p_size").alias("inliers"), ((price - F.floor(price / 10) * 10) / 10).alias("ratio"))
    d = d.withColumn("reason", relate.first_reason((F.col("inliers") < 12, "too_few_inliers"), (F.col("ratio") < 0.2, "low_inlier_ratio"), (F.col("inliers") > 45, "out_of_bounds")))
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint(relate.label_weight(F.col("ratio")) * 100).cast("long")).alias("weight"))


@query("percent_values", "WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 100) || '%' WHEN 1 THEN CAST((event_id % 100) / 100.0::DOUBLE AS VARCHAR) WHEN 2 THEN CAST(event_id % 100 AS VARCHAR) WHEN 3 THEN 'x' END AS t FROM events), n AS (SELECT event_id, try_cast(regexp_replace(trim(t), '%$', '') AS DOUBLE) AS n FROM v) SELECT event_id, CAST(round_even(CASE WHEN n >= 0 AND n <= 1 THEN n * 100 ELSE n END, 0) AS INTEGER) AS percent FROM n")
def percent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.concat((i % 100).cast("string"), F.lit("%"))).when(i % 5 == 1, ((i % 100) / 100.0).cast("string")).when(i % 5 == 2, (i % 100).cast("string")).when(i % 5 == 3, "x")
    return views.table(spark, sf_dir, "events").select("event_id", relate.percent_value(text).alias("percent"))


@query("dominant_event", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS dominant FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def dominant_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.dominant(views.table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", "dominant")


@query("json_defaults", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 20) AS k, coalesce(json_extract_string(props, '$.mode'), 'standard') AS mode, '{"k":' || coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 20) || ',"mode":"standard"}' AS key FROM events""")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records from JSON with a default for each field, and their canonical text as a key."""
    d = session.with_defaults(views.table(spark, sf_dir, "events"), "props", "k int, mode string", {"k": 20, "mode": "standard"})
    return d.select("event_id", "k", "mode", session.canonical_key("k", "mode").alias("key"))

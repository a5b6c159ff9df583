"""Queries that write a source's files and read them back: sessions, labels, samples, profiles, masks, the journal; and keys of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, relate
from ..operators.scratch import place
from ..sources import profiles, session
from ..streaming import journal
from . import views
from .file_queries import RAWS, SUFFIX
from .registry import query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, file_name, state: a made-up state of every document."""
    i = F.col("doc_id")
    rect = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), (i % 5).cast("int").alias("width"), F.lit(4).alias("height"), F.lit(0.5).alias("angle"))
    sliders = F.struct(F.when(i % 3 != 0, (i % 50).cast("int")).alias("exposure"), F.when(i % 4 == 0, F.lit(40)).alias("auto_cmy_strength"))
    offsets = F.when(i % 2 == 0, F.array(i / 1000.0, F.lit(0.25), F.lit(0.5)))
    state = F.struct(i.alias("file_size"), (i * 1000003).alias("mtime_ns"), rect.alias("film_rect"), sliders.alias("adjustments"), offsets.alias("lab_print_cmy_offsets"), F.lit(65).alias("lab_print_cmy_strength"))
    typed = F.from_json(F.to_json(state), session.STATE)
    return views.table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.floor(i / 500)).alias("folder"), F.concat(F.lit("f"), i, F.lit(".cr3")).alias("file_name"), typed.alias("state"))


@query(
    "stored_sessions",
    "SELECT 'r' || doc_id // 500 AS folder, 'f' || doc_id || '.cr3' AS file_name, doc_id AS size, doc_id * 1000003 AS mtime_ns, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 50 AS INTEGER) ELSE 0 END AS exposure, CASE WHEN doc_id % 4 = 0 THEN 40 ELSE 65 END AS strength, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN round(doc_id / 1000.0::DOUBLE, 6) END AS offset_r, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 5 AS INTEGER) END AS rect_width FROM documents",
)
def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as a document a folder, read back with their defaults."""
    path = place(spark)
    d = documents(spark, sf_dir)
    session.write_documents(session.session_documents(d, d.filter("state.file_size % 7 = 0").select("folder", "file_name")), path)
    a = session.adjusted(session.read_sessions(spark, path))
    return a.select(F.regexp_replace("folder", "^folder=", "").alias("folder"), "file_name", "size", "mtime_ns", "exposure", F.col("auto_cmy_strength").alias("strength"), F.round("cmy_offsets.r", 6).alias("offset_r"), F.col("film_rect.width").alias("rect_width"))


@query("stored_exclusions", "SELECT 'f' || doc_id || '.cr3' AS file_name FROM documents WHERE doc_id % 7 = 0")
def stored_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    d = documents(spark, sf_dir)
    session.write_documents(session.session_documents(d, d.filter("state.file_size % 7 = 0").select("folder", "file_name")), path)
    return session.excluded(spark, path)


LABELLED = "lb AS (SELECT 'n' || p_partkey AS name, p_partkey % 3 <> 0 AS accepted, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 50.0::DOUBLE END AS confidence, CASE WHEN p_partkey % 6 = 0 THEN 'low_inlier_ratio' WHEN p_partkey % 9 = 0 THEN 'too_few_inliers' END AS reason, CASE WHEN p_partkey % 5 = 0 THEN '66' WHEN p_partkey % 2 = 0 THEN '135' END AS format FROM part)"


def stored(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("p_partkey")
    d = views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), k).alias("name"), (k % 3 != 0).alias("accepted"), F.when(k % 4 != 0, F.col("p_size") / 50.0).alias("confidence"), F.struct(F.when(k % 6 == 0, "low_inlier_ratio").when(k % 9 == 0, "too_few_inliers").alias("reason")).alias("quality"),
        F.when(k % 5 == 0, "66").when(k % 2 == 0, "135").alias("format"),
    )
    path = place(spark)
    d.write.json(path)
    return path


@query("stored_labels", f"WITH {LABELLED} SELECT name, round(coalesce(confidence, 1), 6) AS confidence, coalesce(format, 'auto') AS format FROM lb WHERE accepted AND coalesce(confidence, 1) >= 0.4")
def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.read_labels(spark, stored(spark, sf_dir), least=0.4).select("name", F.round("confidence", 6).alias("confidence"), "format")


@query(
    "label_summary",
    f"""WITH {LABELLED} SELECT count(*) AS total, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, round(avg(coalesce(confidence, 1)) FILTER (accepted), 6) AS mean_confidence, round(median(coalesce(confidence, 1)) FILTER (accepted), 6) AS median_confidence,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce(reason, 'unknown') AS k, count(*) AS n FROM lb WHERE NOT accepted GROUP BY 1)) AS reasons, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce(format, 'auto') AS k, count(*) AS n FROM lb WHERE accepted GROUP BY 1)) AS formats FROM lb""",
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.schema(session.LABELS).json(stored(spark, sf_dir))
    rows = rows.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "format": F.coalesce("format", F.lit("auto"))})
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return session.label_summary(rows).select("total", "accepted", "rejected", "mean_confidence", "median_confidence", text("rejection_reasons").alias("reasons"), text("formats").alias("formats"))


@query("stored_samples", f"WITH {views.PIXELS} SELECT 'image ' || frame_id AS image, count(*) AS n, round(avg(r), 6) AS density_r, round(avg(b), 6) AS reference_b, round(max(g), 6) AS match_score FROM px GROUP BY frame_id")
def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.pixels(spark, sf_dir)
    path = place(spark)
    session.write_samples(p.select(F.concat(F.lit("image "), "frame_id").alias("image"), *(F.col(n).alias(f"{kind}_{n}") for kind in ("reference", "density") for n in "rgb"), F.col("g").alias("match_score")), path)
    s = session.read_samples(spark, path)
    return s.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("density_r"), 6).alias("density_r"), F.round(F.avg("reference_b"), 6).alias("reference_b"), F.round(F.max("match_score"), 6).alias("match_score"))


def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile a supplier: radial, flat, of an unknown kind, or without what it needs."""
    k = F.col("s_suppkey")
    params = F.when(k % 7 != 0, F.struct(F.when(k % 2 == 0, True).alias("enabled"), (k % 90).cast("int").alias("strength"), F.when(k % 3 == 0, (k % 60).cast("int")).alias("radius")))
    d = views.table(spark, sf_dir, "supplier").select(
        F.lit(1).alias("schema_version"), F.concat(F.lit("lens "), k).alias("name"), F.when(k % 5 == 0, "flat_frame").when(k % 11 == 0, "cubic").when(k % 2 == 0, "radial").alias("type"), params.alias("params"),
        F.when(k % 5 == 0, 1.5 + k % 4 * 0.25).alias("max_gain"), F.when((k % 5 == 0) & (k % 3 != 0), F.concat(F.lit("map-"), k, F.lit(".npy"))).alias("map_file"),
    )
    path = place(spark)
    profiles.write_profiles(d, path)
    return profiles.read_profiles(spark, path)


@query(
    "lens_profiles",
    """WITH l AS (SELECT 'lens ' || s_suppkey AS name, s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'flat_frame' WHEN s_suppkey % 11 = 0 THEN 'cubic' ELSE 'radial' END AS kind FROM supplier)
SELECT name, kind, CASE WHEN kind = 'flat_frame' THEN true ELSE k % 7 <> 0 AND k % 2 = 0 END AS enabled, CASE WHEN kind = 'flat_frame' THEN kind WHEN k % 7 <> 0 AND k % 2 = 0 THEN 'radial' ELSE 'off' END AS mode, CAST(CASE WHEN kind <> 'flat_frame' AND k % 7 <> 0 THEN k % 90 ELSE 0 END AS INTEGER) AS strength,
  CAST(CASE WHEN kind <> 'flat_frame' AND k % 7 <> 0 AND k % 3 = 0 THEN k % 60 ELSE 100 END AS INTEGER) AS radius, CAST(CASE WHEN kind = 'flat_frame' THEN 150 + k % 4 * 25 ELSE 200 END AS INTEGER) AS max_gain,
  CASE WHEN kind = 'flat_frame' THEN CASE WHEN k % 3 = 0 THEN 'no gain map' END WHEN kind = 'cubic' THEN 'unknown kind: cubic' WHEN k % 7 = 0 THEN 'no parameters' END AS problem FROM l""",
)
def lens_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens(spark, sf_dir).select("name", "kind", "enabled", "mode", "strength", "radius", "max_gain", "problem")


@query(
    "flat_gains",
    f"""WITH {views.RASTER} SELECT 'lens ' || frame_id AS name, count(*) AS n, round(avg(least(greatest(0.8 + g * 1.5::DOUBLE, 1), 1.5::DOUBLE + frame_id % 4 * 0.25::DOUBLE)), 6) AS gain FROM rs WHERE frame_id % 5 = 0 AND frame_id % 3 <> 0 AND frame_id % 2 = 1 GROUP BY frame_id""",
)
def flat_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain maps of every other profile, stored and applied; a profile whose map isn't there has none."""
    r = views.raster(spark, sf_dir).filter("frame_id % 2 = 1")  # the maps that exist
    path = place(spark)
    profiles.write_gain_maps(r.select(F.concat(F.lit("map-"), "frame_id", F.lit(".npy")).alias("map_file"), "y", "x", (0.8 + F.col("g") * 1.5).alias("gain")), path)
    g = profiles.effective_gain(lens(spark, sf_dir), spark.read.parquet(path))
    return g.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gain"), 6).alias("gain"))


@query("stored_masks", f"WITH {views.RASTER}, m AS (SELECT 'IMG.' || frame_id || '_dust_auto' AS mask, frame_id, y, x FROM rs WHERE CASE WHEN frame_id % 4 = 0 THEN false WHEN frame_id % 2 = 0 THEN g > 0.9 ELSE g > 0.7 END) SELECT mask, count(*) AS n, CAST(sum(y) AS BIGINT) AS y_sum, CAST(sum(x) AS BIGINT) AS x_sum FROM m GROUP BY mask")
def stored_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks stored, then every other one replaced, half of these by nothing."""
    file_name = F.concat(F.lit("IMG."), "frame_id", F.lit(".cr3"))
    r = views.raster(spark, sf_dir).withColumn("mask", profiles.mask_name(file_name, "auto"))
    first, second = place(spark), place(spark)
    profiles.write_masks(r.filter("g > 0.7").select("mask", "y", "x"), first)
    changed = r.filter("frame_id % 2 = 0")
    profiles.write_masks(profiles.replaced_masks(profiles.read_masks(spark, first), changed, changed.filter("g > 0.9 and frame_id % 4 != 0")), second)
    return profiles.read_masks(spark, second).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y_sum"), F.sum("x").alias("x_sum"))


LINES = "ln AS (SELECT ts AS tm, ['batch_start', 'item_start', 'item_done', 'item_failed', 'batch_finish', 'other'][event_id % 6 + 1] AS event, user_id AS source, event_id FROM events WHERE event_id % 6 <> 5)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of a journal, some of an unknown kind."""
    i = F.col("event_id")
    kinds = F.array(*(F.lit(e) for e in (*journal.EVENTS, "other")))
    d = views.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.get(kinds, (i % 6).cast("int")).alias("event"), F.col("user_id").cast("string").alias("source"), F.format_string("%012d", i).alias("output"))
    path = place(spark)
    d.write.mode("append").json(path)
    return journal.read(spark, path)


@query("journal_progress", f"WITH {LINES} SELECT strftime(date_trunc('day', tm), '%Y-%m-%d') AS day, event, count(*) AS n FROM ln GROUP BY ALL")
def journal_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = journal.progress(lines(spark, sf_dir), window="1 day")
    return p.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event", "n")


@query("journal_state", f"WITH {LINES} SELECT CAST(source AS VARCHAR) AS source, event, event = 'item_done' AS done FROM ln QUALIFY row_number() OVER (PARTITION BY source ORDER BY tm DESC, event DESC, event_id DESC) = 1")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.last_state(lines(spark, sf_dir)).select("source", "event", "done")


@query("plan_keys", "SELECT p_partkey AS id, md5('p' || p_partkey || '|' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE 'roll' END || '|' || printf('%.7f', p_size / 7.0::DOUBLE) || ',' || printf('%.7f', 1 / 3.0::DOUBLE) || '|' || printf('%.7f', p_partkey / 11.0::DOUBLE) || '|' || p_size) AS key FROM part")
def plan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = views.table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("p"), k).alias("path"), F.when(k % 3 != 0, "roll").alias("color_action"), F.array(F.col("p_size") / 7.0, F.lit(1 / 3.0)).alias("gains"), (k / 11.0).alias("strength"), F.col("p_size").alias("size"))
    return d.select("id", F.md5(session.rounded_key(d, ["path", "color_action", "gains", "strength", "size"])).alias("key"))


STAGES = ("RAW decode", "Prepare film", "Saturation", "TIFF write", "Lab Print")


@query(
    "export_timings",
    f"""WITH t AS (SELECT p_partkey AS id, i, {list(STAGES)}[i] AS name, (p_partkey * i % 89) / 7.0::DOUBLE AS s FROM part, range(1, 6) r(i) WHERE p_partkey % 10 > 0 AND i <= p_partkey % 6)
SELECT p.p_partkey AS id, coalesce(string_agg(name || ' ' || printf('%.1fs', s), ', ' ORDER BY i) || ', total ' || printf('%.1fs', coalesce(sum(s) FILTER (i <> 3), 0)), '') AS text FROM part p LEFT JOIN t ON t.id = p.p_partkey GROUP BY p.p_partkey""",
)
def export_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    every = F.array(*(F.struct(F.lit(n).alias("name"), (k * i % 89 / 7.0).alias("seconds")) for i, n in enumerate(STAGES, 1)))
    some = F.slice(every, F.lit(1), F.when(k % 10 > 0, k % 6).otherwise(0).cast("int"))
    return views.table(spark, sf_dir, "part").select(k.alias("id"), layout.timings_text(some).alias("text"))


FILE_STATES = f"{views.FILES}, st AS (SELECT file_id, {SUFFIX} AS suffix, file_id % 3 = 0 AS completed, file_id % 2 = 0 AS known FROM fl)"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("file_id")
    return views.files(spark, sf_dir).select("file_id", relate.suffix(F.col("name")).alias("suffix"), (i % 3 == 0).alias("completed"), (i % 2 == 0).alias("known"))


@query("automatic_frames", f"WITH {FILE_STATES} SELECT file_id, file_id % 13 <> 0 AND suffix IN {RAWS} AND NOT file_id % 5 = 0 AND NOT completed AS frames, suffix IN {RAWS} AND file_id <> 12 AND NOT known AND NOT completed AS preinverts FROM st")
def automatic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files get a frame by themselves, and which are inverted ahead."""
    d = states(spark, sf_dir)
    i = F.col("file_id")
    ahead = layout.to_preinvert(d, d.filter("file_id = 12"), [d.filter("known"), d.filter("completed")], relate.RAW_SUFFIXES)
    frames = layout.frames_itself(F.lit(True), i % 13 != 0, F.col("suffix").isin(*relate.RAW_SUFFIXES), i % 5 == 0, F.col("completed"))
    return d.join(ahead.select(i.alias("_id")), i == F.col("_id"), "left").select("file_id", frames.alias("frames"), F.col("_id").isNotNull().alias("preinverts"))


@query("scoped_files", f"WITH {FILE_STATES} SELECT 'all' AS scope, file_id FROM st UNION ALL SELECT CASE WHEN completed THEN 'completed' ELSE 'unprocessed' END, file_id FROM st")
def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = states(spark, sf_dir)
    out = [layout.in_scope(d, d, s).select(F.lit(s).alias("scope"), "file_id") for s in ("all", "completed", "unprocessed", "none")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("planned_states", f"WITH {FILE_STATES} SELECT file_id, CASE WHEN file_id % 4 = 0 THEN CASE WHEN file_id % 8 <> 0 THEN 'new ' || file_id END WHEN known THEN 'old' END AS plan, file_id % 4 = 0 OR completed AS corrected FROM st")
def planned_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New plans replace old ones, null ones too."""
    d = states(spark, sf_dir)
    old = d.select("file_id", F.when(F.col("known"), "old").alias("plan"), F.col("completed").alias("corrected"))
    new = d.filter("file_id % 4 = 0").select("file_id", F.when(F.col("file_id") % 8 != 0, F.concat(F.lit("new "), "file_id")).alias("plan"))
    return layout.with_plans(old, new)

"""Roll sessions, labels, registries and settings: JSON that is typed on reading, with defaults, and written whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of session and label files.
POINT = "struct<x:int,y:int>"
RECT = "struct<x:int,y:int,width:int,height:int,angle:double>"
STATE = (
    f"struct<file_size:bigint,mtime_ns:bigint,mask_point:{POINT},white_balance_point:{POINT},film_rect:{RECT},"
    "adjustments:struct<invert_mode:string,print_curve:string,auto_wb:boolean,auto_cmy_strength:int,exposure:int,highlights:int,shadows:int,contrast:int,saturation:int,"
    "camera_color_strength:int,soft_highlights:boolean,soft_shadows:boolean,analysis_inset_percent:int,black_point:int,mid_point:int,white_point:int,"
    "printer_balance:struct<red_cyan:int,green_magenta:int,blue_yellow:int>>,"
    "lab_print_log_floors:array<double>,lab_print_log_ceils:array<double>,lab_print_cmy_offsets:array<double>,lab_print_cmy_strength:int,tone_mid_anchor:double,"
    "negative_preview_active:boolean,auto_levels_pending:boolean,preview_flip_horizontal:boolean,preview_flip_vertical:boolean,preview_rotation_quarters:int>"
)
SESSION = f"schema_version int, app string, images map<string,{STATE}>, excluded_files array<string>, _broken string"
LABELS = (
    "name string, accepted boolean, negative_path string, positive_path string, source_size array<int>, preview_size array<int>, "
    f"frame_rect_preview {RECT}, frame_rect_source {RECT}, format string, confidence double, "
    "quality struct<accepted:boolean,reason:string,confidence:double,inliers:int,inlier_ratio:double,good_matches:int,area_ratio:double,aspect:double,aspect_score:double,format:string>"
)
#: Defaults of the sliders where a session has none.
ADJUSTMENTS = {"auto_wb": True, "auto_cmy_strength": 65, "analysis_inset_percent": 5, "black_point": 0, "mid_point": 50, "white_point": 100, "exposure": 0, "highlights": 0, "shadows": 0, "contrast": 0, "saturation": 0}


def read_sessions(spark: SparkSession, *paths: str) -> DataFrame:
    """folder, file_name and state of each image of the sessions; a broken file or another version gives no rows."""
    raw = spark.read.schema(SESSION).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(list(paths))
    raw = raw.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/(?:\.[^/]+/)?[^/]+$", 1))
    good = raw.filter("_broken is null and schema_version = 1")
    return good.select("folder", F.explode("images").alias("file_name", "state"))


def excluded(spark: SparkSession, *paths: str) -> DataFrame:
    raw = spark.read.schema(SESSION).option("multiLine", True).json(list(paths)).filter("schema_version = 1")
    return raw.select(F.explode("excluded_files").alias("file_name")).distinct().orderBy("file_name")


def triple(c: Column) -> Column:
    """A list of exactly three numbers as r, g, b; any other length is null."""
    return F.when(F.size(c) == 3, F.struct(F.get(c, 0).alias("r"), F.get(c, 1).alias("g"), F.get(c, 2).alias("b")))


def adjusted(states: DataFrame) -> DataFrame:
    """The sliders of ``read_sessions`` with defaults; offsets of another strength than the slider's are void."""
    a = F.col("state.adjustments")
    sliders = {k: F.coalesce(a[k], F.lit(v)) for k, v in ADJUSTMENTS.items()}
    offsets = F.when(F.col("state.lab_print_cmy_strength") == sliders["auto_cmy_strength"], triple(F.col("state.lab_print_cmy_offsets")))
    floors, ceils = triple(F.col("state.lab_print_log_floors")), triple(F.col("state.lab_print_log_ceils"))
    both = floors.isNotNull() & ceils.isNotNull()
    return states.select(
        "folder", "file_name", F.col("state.file_size").alias("size"), F.col("state.mtime_ns").alias("mtime_ns"), F.coalesce(a["print_curve"], F.lit("standard")).alias("print_curve"),
        *(v.alias(k) for k, v in sliders.items()), offsets.alias("cmy_offsets"), F.when(both, floors).alias("log_floors"), F.when(both, ceils).alias("log_ceils"),
        F.when((F.col("state.film_rect.width") > 0) & (F.col("state.film_rect.height") > 0), F.col("state.film_rect")).alias("film_rect"),
    )


def write_sessions(states: DataFrame, path: str) -> None:
    """One JSON object a line for each image, under its folder; Spark's commit makes the whole appear at once."""
    states.write.mode("overwrite").partitionBy("folder").json(path)


def read_labels(spark: SparkSession, path: str, files: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Accepted labels of ``least`` confidence by name; with ``files``, only those whose raw file is there."""
    rows = spark.read.schema(LABELS).json(path).filter("name is not null")
    rows = rows.withColumns({"accepted": F.coalesce("accepted", F.lit(True)), "confidence": F.coalesce("confidence", F.lit(1.0)), "format": F.coalesce("format", F.lit("auto"))})
    rows = rows.filter(F.col("accepted") & (F.col("confidence") >= least))
    if files is not None:
        rows = rows.join(files.select(F.col("name").alias("_n")), F.regexp_extract("negative_path", r"([^/\\]+)$", 1) == F.col("_n"), "left_semi")
    return rows.orderBy("name")


def label_summary(labels: DataFrame) -> DataFrame:
    """total, accepted, rejected, counts by reason and format, mean and median confidence of the accepted."""
    n = labels.agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), F.round(F.avg(F.when(F.col("accepted"), F.col("confidence"))), 6).alias("mean_confidence"), F.round(F.median(F.when(F.col("accepted"), F.col("confidence"))), 6).alias("median_confidence"))
    reasons = labels.filter(~F.col("accepted")).groupBy(F.coalesce("quality.reason", F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    formats = labels.filter("accepted").groupBy(F.col("format").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    as_map = lambda d, name: d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))
    return n.withColumn("rejected", F.col("total") - F.col("accepted")).crossJoin(as_map(reasons, "rejection_reasons")).crossJoin(as_map(formats, "formats"))  # one row each


def with_defaults(df: DataFrame, column: str, schema: str, defaults: dict) -> DataFrame:
    """``df`` plus the fields of a JSON column; what is missing, null or of another type takes its default."""
    parsed = F.from_json(column, schema)
    return df.withColumn("_j", parsed).withColumns({k: F.coalesce(F.col("_j")[k], F.lit(v)) for k, v in defaults.items()}).drop("_j")


def canonical_key(*fields: str) -> Column:
    """The fields as compact JSON in the order of their names; nulls are written out."""
    return F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})


def session_documents(states: DataFrame, excluded_files: DataFrame | None = None, app: str = "emulsion") -> DataFrame:
    """folder and document: a whole session of each folder as one JSON text, keys in order, null fields left out.

    ``states`` has folder, file_name and state (of type STATE), ``excluded_files`` folder and file_name. A folder is a roll, some
    hundreds of files at most. What ``read_sessions`` reads of these texts are the same states.
    """
    images = states.groupBy("folder").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_name", F.to_json("state").alias("state"))))).alias("_states"))
    if excluded_files is None:
        out = images.withColumn("_out", F.array().cast("array<string>"))
    else:
        left_out = excluded_files.groupBy("folder").agg(F.array_sort(F.collect_set("file_name")).alias("_out"))
        out = images.join(left_out, "folder", "full_outer").withColumn("_out", F.coalesce("_out", F.array().cast("array<string>")))
    typed = F.transform_values(F.coalesce("_states", F.create_map().cast("map<string,string>")), lambda _, v: F.from_json(v, STATE))
    return out.select("folder", F.to_json(F.struct(F.lit(app).alias("app"), F.col("_out").alias("excluded_files"), typed.alias("images"), F.lit(1).alias("schema_version"))).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Each folder's document as a file of its own under ``folder=...``; the commit makes them appear at once."""
    documents.repartition("folder").write.mode("overwrite").partitionBy("folder").text(path)


def rounded_key(df: DataFrame, fields: list[str], places: int = 7) -> Column:
    """The fields, in this order, as one text in which numbers with a point have ``places`` decimals: equal texts, equal plans."""
    kinds = dict(df.dtypes)
    number = lambda c: F.format_string(f"%.{places}f", F.bround(c, places) + F.lit(0.0))

    def text(name: str) -> Column:
        c = F.col(name)
        shown = number(c) if kinds[name] == "double" else F.array_join(F.transform(c, number), ",") if kinds[name] == "array<double>" else c.cast("string")
        return F.coalesce(shown, F.lit("null"))

    return F.concat_ws("|", *(text(n) for n in fields))


# The head of a file of samples.
SAMPLES = "image string, density_r double, density_g double, density_b double, reference_r double, reference_g double, reference_b double, match_score double"


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as CSV with a head, its columns in the order of SAMPLES."""
    names = [f.split(" ")[0] for f in SAMPLES.split(", ")]
    samples.select(*names).write.mode("overwrite").option("header", True).csv(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).option("header", True).csv(path)

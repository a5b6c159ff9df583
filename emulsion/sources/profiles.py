"""Lens profiles and masks as tables: JSON profiles with gain maps as rows, and masks as the cells that are set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import clip
from ..operators.relate import stem

# Field names, kinds and defaults of lens profiles.
PARAMS = "struct<enabled:boolean,mode:string,strength:int,radius:int,center_x:int,center_y:int,smoothness:int,max_gain:int,flat_profile_path:string,flat_strength:int>"
PROFILE = f"schema_version int, type string, name string, params {PARAMS}, source_raw string, source_resolution array<int>, map_resolution array<int>, blur_radius int, map_mode string, max_gain double, map_file string"
DEFAULTS = {"enabled": False, "mode": "off", "strength": 0, "radius": 100, "center_x": 50, "center_y": 50, "smoothness": 200, "max_gain": 200, "flat_strength": 100}
RADIAL, FLAT = "radial", "flat_frame"
MASK_KINDS = ("auto", "add", "protect")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles (columns of PROFILE, those that are missing are null) as JSON lines."""
    profiles.write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """name, kind and the parameters of each profile; problem says why one can't be used, else it is null.

    A radial profile takes defaults for what it leaves out, and its mode from whether it is on. A flat one is on in full, its
    limit being the profile's in percent. A profile without a kind is radial.
    """
    raw = spark.read.schema(PROFILE).json(path)
    kind = F.coalesce("type", F.lit(RADIAL))
    flat = kind == FLAT
    enabled = F.coalesce("params.enabled", F.lit(DEFAULTS["enabled"]))
    own = {k: F.coalesce(F.col(f"params.{k}"), F.lit(v)) for k, v in DEFAULTS.items()}
    own["mode"] = F.coalesce(F.nullif("params.mode", F.lit("")), F.when(enabled, RADIAL).otherwise(DEFAULTS["mode"]))
    set_by_map = {"enabled": F.lit(True), "mode": F.lit(FLAT), "max_gain": F.bround(F.coalesce("max_gain", F.lit(2.0)) * 100.0).cast("int"), "flat_strength": F.lit(100)}
    problem = (
        F.when(flat & (F.coalesce("map_file", F.lit("")) == ""), "no gain map").when(~flat & (kind != RADIAL), F.concat(F.lit("unknown kind: "), kind)).when(~flat & F.col("params").isNull(), "no parameters")
    )
    return raw.select("name", kind.alias("kind"), *(F.when(flat, set_by_map.get(k, F.lit(DEFAULTS[k]))).otherwise(v).alias(k) for k, v in own.items()), "map_file", problem.alias("problem"))


def write_gain_maps(maps: DataFrame, path: str) -> None:
    """map_file, y, x, gain; a folder for each map."""
    maps.repartition("map_file").sortWithinPartitions("map_file", "y", "x").write.mode("overwrite").partitionBy("map_file").parquet(path)


def effective_gain(profiles: DataFrame, maps: DataFrame) -> DataFrame:
    """name, y, x, gain of usable flat profiles: the map to the power of the strength, between 1 and the profile's limit.

    A profile whose map isn't there gives no rows.
    """
    p = profiles.filter((F.col("kind") == FLAT) & F.col("problem").isNull()).select("name", "map_file", "max_gain", "flat_strength")
    j = maps.join(p, "map_file")
    strength = clip(F.col("flat_strength") / 100.0, 0.0, 2.0)
    raised = F.when(strength <= 0.0, 1.0).otherwise(F.pow(F.greatest(F.col("gain"), F.lit(1e-5)), strength))
    return j.select("name", "y", "x", clip(raised, 1.0, F.greatest(F.lit(1.0), F.col("max_gain") / 100.0)).alias("gain"))


def mask_name(name: Column, kind: str) -> Column:
    """The mask of a kind (of MASK_KINDS) of a file, by the file's name without its suffix."""
    return F.concat(F.translate(stem(name), "/\\", "__"), F.lit(f"_dust_{kind}"))


def replaced_masks(stored: DataFrame, changed: DataFrame, cells: DataFrame) -> DataFrame:
    """The stored masks (mask, y, x) with those named in ``changed`` (mask) taken from ``cells``; one without cells is deleted."""
    names = changed.select("mask").distinct()
    kept = stored.join(names, "mask", "left_anti").select("mask", "y", "x")
    return kept.unionByName(cells.select("mask", "y", "x").join(names, "mask", "left_semi").distinct())


def write_masks(masks: DataFrame, path: str) -> None:
    """All masks as a new table; the one that was read stays until the new one is there, so write to another path than that."""
    masks.repartition("mask").sortWithinPartitions("mask", "y", "x").write.mode("errorifexists").parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

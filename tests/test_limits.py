"""Rows on the limit of a quantile, values in the middle of two roundings, and plans that must not gather many rows in one place."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from emulsion.operators import areas, detect, fits, grids, regions, relate, stats, tiles
from emulsion.operators.scratch import settled
from emulsion.plans import catalog, roll
from pyspark.sql import functions as F

TABLES = ("lineitem", "supplier", "nation")


@pytest.fixture(scope="module")
def limits(tmp_path_factory):
    """Frames of the tables at 0.1 whose limits differ in the last bit if they are not weighed as SQL does."""
    folder = tmp_path_factory.mktemp("limits")
    con = duckdb.connect()
    for name in TABLES:
        some = " WHERE l_suppkey IN (73, 74, 202, 251, 266, 364, 447, 683)" if name == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/{name}.parquet'{some}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ("cast_metrics", "neutral_gains", "tone_residuals", "frame_candidates"))
def test_rows_on_a_limit_are_those_of_sql(spark, limits, name):
    folder, con = limits
    got = catalog.QUERIES[name](spark, folder)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    place = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in place) for r in cursor.fetchall())


def test_a_rounded_value_is_rounded_by_the_number_itself(spark):
    got = spark.createDataFrame([(0.5055,), (0.5065,), (0.25,)], "v double").select(roll.binary_round(F.col("v"), 3)).collect()
    assert [r[0] for r in got] == [round(v, 3) for v in (0.5055, 0.5065, 0.25)]


def test_targets_do_not_hang_on_the_last_bit(spark):
    row = (1, 7, "normal", 0.50427499999999996 - 1.2e-16, 0.8)
    work = spark.createDataFrame([row], "roll_id long, frame_id long, exposure_class string, p50 double, p95 double")
    kept = spark.createDataFrame([(7,)], "frame_id long")
    assert roll.exposure_targets(work, kept).first()["target_p50"] == 0.50428


def below(df, node: str) -> list[str]:
    """The lines of the physical plan under each ``node``."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            out.append(line)
            continue
        depth = at if node in line else None
    return out


def test_samples_of_sides_are_not_broadcast(spark, tmp_path):
    """Rectangles are few and their samples many; the samples' size isn't known when the join is planned."""
    spark.range(40).selectExpr("id % 4 AS frame_id", "id AS cand_pos", "0 AS x", "0 AS y", "100 AS width", "80 AS height", "0.0D AS angle").write.parquet(f"{tmp_path}/rects")
    spark.range(4000).selectExpr("id % 4 AS frame_id", "cast(id / 4 AS int) AS y", "0 AS x").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    sizes = edges.groupBy("frame_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    got = areas.side_support(edges, sizes, spark.read.parquet(f"{tmp_path}/rects"))
    assert got.count() == 40
    assert not any("Generate" in line for line in below(got, "BroadcastExchange"))


def test_a_grid_is_made_where_its_guess_is(spark):
    guess = spark.createDataFrame([(1, 100, 90, 300, 200, 3.0), (None, 1, 1, 50, 50, 0.0)], "frame_id long, x int, y int, width int, height int, angle double")
    got = grids.prior_grid(guess, 640, 480, 120)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Exchange", "Sort", "Window"))
    rows = got.collect()
    assert [r["place"] for r in rows] == list(range(1, 121)) and len({r[1:6] for r in rows}) == 120
    assert tuple(rows[0])[:6] == (1, 100, 90, 300, 200, 3.0)


def frame_of(spark, n: int):
    return spark.range(n).selectExpr("1L AS frame_id", "cast(id / 24 AS int) AS y", "cast(id % 24 AS int) AS x", "id / 1000.0D AS r", "id / 900.0D AS g", "0.5D AS b")


def test_pixels_are_not_copied_for_each_rectangle(spark):
    rects = spark.createDataFrame([(1, 5, 2, 3, 6, 5), (1, 6, 100, 100, 6, 5)], "frame_id long, cand_pos long, x0 long, y0 long, width long, height long")
    got = regions.rectangle_features(frame_of(spark, 600), rects)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert [(r["cand_pos"], r["in_n"], r["out_n"]) for r in rows] == [(5, 30, 60)]


def test_pixels_are_not_copied_for_each_patch(spark):
    size = spark.createDataFrame([(1, 24, 25)], "frame_id long, width int, height int")
    got = detect.base_patches(frame_of(spark, 600), detect.edge_points(size))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() > 0


def test_a_fit_reads_its_pixels_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v: float) -> float:
        read.add(1)
        return v

    d = spark.range(400).selectExpr("0.1D + id % 20 / 40.0D AS r", "0.1D + id % 7 / 20.0D AS g", "0.1D + id % 11 / 30.0D AS b")
    d = d.withColumn("r", F.udf(seen, "double")("r")).withColumns({"tr": F.col("r") * 0.9, "tg": F.col("g") * 0.8, "tb": F.col("b") * 0.7})
    m = fits.colour_matrix(d, ["r", "g", "b"], ["tr", "tg", "tb"])
    assert read.value == 400
    assert abs(m[0][0] - 0.9) < 1e-9 and abs(m[2][2] - 0.7) < 1e-9 and abs(m[1][0]) < 1e-9


def test_alternatives_of_a_frame_are_not_rows(spark, tmp_path):
    """Each pixel under each alternative was a row of a window; here they are tried inside the group of the frame's pixels."""
    frame_of(spark, 600).write.parquet(f"{tmp_path}/pixels")
    spark.range(3).selectExpr("id AS frame_id", "1.1D AS a_r", "1.0D AS a_g", "0.9D AS a_b").write.parquet(f"{tmp_path}/work")
    pixels, work = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("pixels", "work"))
    alternatives = {"a": roll.gains_of("a"), "b": roll.gains_of("a").map(lambda c: c * 0.97)}
    got = roll.cast_after(roll.dealt(pixels), work, alternatives)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Window", "Generate", "Join"))
    assert plan.count("Exchange") == 2  # the pixels and the gains, once each
    rows = got.collect()
    assert [r["frame_id"] for r in rows] == [1] and 0 < rows[0]["after_b"] < 1 and rows[0]["after_a"] != rows[0]["after_b"]


def test_casts_take_one_exchange_and_no_window(spark):
    frame = frame_of(spark, 600)
    for got in (stats.cast_metrics(frame, ["frame_id"]), stats.neutral_gains(frame, ["frame_id"])):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1
    odd = frame.unionByName(frame.selectExpr("frame_id", "y", "x", "cast(NULL AS double) AS r", "cast('NaN' AS double) AS g", "cast('Infinity' AS double) AS b"))
    whole, more = (stats.cast_metrics(d, ["frame_id"]).first() for d in (frame, odd))
    assert more["sampled"] == 2 * whole["sampled"] and more["magnitude"] == whole["magnitude"] and more["neutral_pixels"] == whole["neutral_pixels"]


def test_equal_gains_are_compared_once(spark, tmp_path):
    """Of 6,000 rows with three different values nine pairs are compared, not 36,000,000."""
    spark.range(6000).selectExpr("1 AS k", "id AS pos", "id % 3 * 0.15D AS r", "0.0D AS g", "0.0D AS b", "0.5D AS w").write.parquet(f"{tmp_path}/gains")
    got = relate.gain_cluster(spark.read.parquet(f"{tmp_path}/gains"), ["k"], "pos", ["r", "g", "b"], "w")
    keys = [n.split("keys=[")[1].split("]")[0] for n in below(got, "Join") if "keys=[" in n]
    assert any(all(f"{c}#" in n for c in "krgb") for n in keys)
    rows = got.collect()
    assert len(rows) == 6000 and all(r["in_cluster"] for r in rows)


def test_small_tiles_and_components_share_a_call(spark, monkeypatch):
    """A call of Python for each tile of eight cells and for each speck cost more than its work."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(tiles, "settled", seen)
    cells = spark.range(900).selectExpr("id % 3 AS frame_id", "cast(id / 30 AS int) AS y", "cast(id % 30 AS int) AS x").filter("(y * 7 + x * x) % 5 < 2 or y = 9")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small, whole = (sorted(map(tuple, tiles.components(cells, side).collect())) for side in (4, 64))
        shapes = tiles.shapes(tiles.components(cells, 4))
        plans.append(shapes._jdf.queryExecution().executedPlan().toString())
        got = {(r["frame_id"], r["component"]): (r["major"], r["minor"]) for r in shapes.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == whole and len(small) == cells.count()
    assert not any("FlatMapGroups" in p for p in plans)
    members = {}
    for frame, y, x, c in small:
        members.setdefault((frame, c), []).append((y, x))
    assert got == {k: tiles.least_rectangle(*np.array(v).T) for k, v in members.items()}


def test_summed_areas_are_not_dealt_out(spark):
    """The seven sums of each cell were written and dealt out three times."""
    rects = spark.createDataFrame([(1, 5, 2, 3, 6, 5), (1, 6, 100, 100, 6, 5), (1, None, 0, 0, 5, 4), (1, 7, None, 0, 5, 4), (2, 8, 0, 0, 5, 4)], "frame_id long, cand_pos long, x0 long, y0 long, width long, height long")
    got = areas.rectangle_statistics(frame_of(spark, 599), rects, F.col("r"), F.col("g"), F.col("b") > 0.4, 2.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and not any(n in plan for n in ("Join", "Window", "FileScan"))
    rows = {r["cand_pos"]: r for r in got.collect()}
    assert {k: (r["in_n"], r["out_n"]) for k, r in rows.items()} == {5: (30, 60), 6: (0, 0), None: (20, 22), 7: (0, 0)}
    assert rows[5]["in_valid"] == 30 / 600 and rows[6]["in_black"] == 1.0 and rows[5]["in_edges"] == 1.0


def test_pairs_of_gains_are_dealt_to_all_cores(spark, tmp_path):
    """All near pairs of a few rows, 4,000,000 here, were one task's."""
    spark.range(2000).selectExpr("1 AS k", "id AS pos", "id * 1e-6D AS r", "0.0D AS g", "0.0D AS b", "0.5D AS w").write.parquet(f"{tmp_path}/gains")
    got = relate.gain_cluster(spark.read.parquet(f"{tmp_path}/gains"), ["k"], "pos", ["r", "g", "b"], "w")
    cores = spark.sparkContext.defaultParallelism
    assert any("hashpartitioning(pos#" in n and f", {cores}), REPARTITION_BY_NUM" in n for n in below(got, "Join"))
    assert all(r["in_cluster"] for r in got.collect())


def test_a_frame_is_measured_with_its_candidate_in_one_exchange(spark):
    """Exposure, cast and candidate had three exchanges of the pixels; they are as by the operators apart."""
    pixels = settled(frame_of(spark, 600))
    frames = settled(spark.createDataFrame([(1, 7)], "frame_id long, roll_id long"))
    got = roll.frame_work(pixels, frames)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("hashpartitioning(frame_id") == 1 and "percentile(" not in plan
    row, exposure, cast, gains = got.first(), *(f(pixels, ["frame_id"]).first() for f in (stats.exposure_metrics, stats.cast_metrics, stats.neutral_gains))
    assert all(row[n] == exposure[n] for n in ("p05", "p25", "p50", "p75", "p95", "shadow_clip", "highlight_clip"))
    assert row["cast"] == cast["magnitude"] and row["neutral_pixels"] == cast["neutral_pixels"] and gains["gain_r"] is not None
    most = 0.90 if row["cast"] >= 0.04 else 0.62
    limited = spark.range(1).select(*roll.from_logs(roll.logs(roll.RGB(*(F.lit(gains[f"gain_{c}"]) for c in "rgb"))))).first()
    own = roll.drawn_in([gains[f"gain_{c}"] for c in "rgb"], most)
    assert max(abs(a - b) for a, b in zip(own, limited, strict=True)) < 1e-12
    assert roll.drawn_in([4.0, 1.0, 0.2], 0.62) != roll.drawn_in([4.0, 1.0, 0.2], 0.90)


def test_exposure_in_numpy_is_that_of_spark(spark):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.integers(0, 40, 3) / 39)) for k in range(12) for _ in range(1 + 37 * k)]
    rows += [(90, None, 0.5, 0.5), (90, float("nan"), 0.5, 0.5), (90, float("inf"), 0.5, 0.5), (91, 0.2, 0.3, 0.4), (91, None, 0.1, 0.1)]
    d = settled(spark.createDataFrame(rows, "frame_id long, r double, g double, b double"))
    want = sorted(map(tuple, stats.exposure_metrics(d, ["frame_id"]).collect()))
    assert sorted(map(tuple, stats.by_group(d, ["frame_id"], stats.EXPOSURE, stats.exposure_of).collect())) == want

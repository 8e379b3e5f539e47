"""Array queries take all points and frames of their tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from modaleda import catalog
from modaleda.operators import cloud, distance, video

FOLDER = "/root/testdata/sf0.001"


def test_nearest_neighbours_are_those_of_all_points(spark):
    rng = np.random.default_rng(1)
    shapes = {
        "even": rng.random((12_000, 3)), "far": np.vstack([rng.normal(size=(1500, 3)), [[90.0, 0, 0], [0, -500, 3]]]), "steps": rng.integers(0, 9, (3000, 3)).astype(float),
        "line": np.outer(np.arange(1300.0) ** 2, [1, 0, 0]), "one": np.ones((1, 3)), "same": np.ones((1200, 3)),
    }
    rows = pd.concat([pd.DataFrame(p, columns=["x", "y", "z"]).assign(cloud_id=k) for k, p in shapes.items()])
    got = {r.cloud_id: r[1:] for r in cloud.nearest_neighbours(spark.createDataFrame(rows).select("cloud_id", "x", "y", "z")).collect()}
    assert set(got) == set(shapes)
    for k, p in shapes.items():
        d = np.zeros(len(p))
        for i in range(len(p) if len(p) > 1 else 0):
            s = ((p - p[i]) ** 2).sum(axis=1)
            s[i] = np.inf
            d[i] = np.sqrt(s.min())
        assert got[k] == pytest.approx((d.mean(), np.median(d), d.std()), abs=1e-12), k


@pytest.mark.parametrize("name", ["cloud_nearest_neighbours", "cloud_records"])
def test_clouds_of_both_tables(spark, name):
    want = {r.n_points for r in catalog.QUERIES["cloud_extent"](spark, FOLDER).select("n_points").collect()}
    got = catalog.QUERIES[name](spark, FOLDER).collect()
    assert {"A", "N", "R", "0"} <= {r.cloud_id for r in got}
    assert name != "cloud_records" or {r.n_points for r in got} == want and all((r.r_mean is None) == (r.cloud_id in "ANR") for r in got)


def test_video_records_take_every_frame(spark):
    got = {r.video_id: r for r in catalog.QUERIES["video_records"](spark, FOLDER).collect()}
    want = {r.video_id: r for r in catalog.QUERIES["video_motion_summary"](spark, FOLDER).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k].sampled_frames == got[k].n_frames and all(got[k][c] == pytest.approx(r[c]) for c in r.asDict()), k


def test_video_records_have_no_last_frame(spark):
    rows = [("v", i, 0, 0, 200 if i == 1700 else 100) for i in range(1800)]
    got = video.records(spark.createDataFrame(rows, "video_id string, frame_idx int, y int, x int, gray int")).collect()[0]
    assert (got.sampled_frames, got.scene_change_count) == (1800, 2)


def test_nearest_neighbours_across_many_tiles_and_with_copies(spark):
    rng = np.random.default_rng(2)
    shapes = {
        "even": rng.random((3000, 3)), "far": np.vstack([rng.normal(size=(900, 3)), [[90.0, 0, 0], [0, -500, 3]]]), "copies": np.repeat(rng.random((700, 3)), rng.integers(1, 40, 700), axis=0),
        "line": np.outer(np.arange(800.0) ** 2, [1, 0, 0]), "one": np.ones((1, 3)), "same": np.ones((900, 3)), None: rng.random((600, 3)),
    }
    rows = [(k, *map(float, q)) for k, p in shapes.items() for q in p]
    points = spark.createDataFrame(rows, "cloud_id string, x double, y double, z double")
    trees, n = cloud._tree_of_each(points, 100)
    assert {"even", "far", "line", None} <= set(trees) and n > 50
    got = {r.cloud_id: r[1:] for r in cloud.nearest_neighbours(points, size=100).collect()}
    assert set(got) == set(shapes)
    for k, p in shapes.items():
        d = np.zeros(len(p))
        for i in range(len(p) if len(p) > 1 else 0):
            s = ((p - p[i]) ** 2).sum(axis=1)
            s[i] = np.inf
            d[i] = np.sqrt(s.min())
        assert got[k] == pytest.approx((d.mean(), np.median(d), d.std()), abs=1e-12), k


def test_nearest_neighbours_hold_no_pairs_of_tiles_in_the_plan(spark):
    """Copies are counted before points meet, and no join goes over a whole cloud."""
    points = spark.range(60_000).selectExpr("'c' as cloud_id", "double(id % 600) as x", "0d as y", "0d as z")
    plan = cloud.nearest_neighbours(points)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert cloud.nearest_distances(points).selectExpr("sum(zeros)").collect()[0][0] == 60_000


@pytest.mark.parametrize("of", [cloud.radial, cloud.attributes, cloud.xy_density, cloud.height_histogram])
def test_points_are_not_shuffled_by_cloud(spark, of):
    """A cloud may hold most points: what is known of each cloud is brought to them, also where tables are not small."""
    points = spark.range(1000).selectExpr("string(id div 900) as cloud_id", "double(id) as x", "0d as y", "double(id % 7) as z", "0d as intensity", "1d as r", "1d as g", "1d as b")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = of(points)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan


def test_distances_read_their_items_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    items = spark.range(12).selectExpr("id", "double(id * id) as v").repartition(3).mapInPandas(counted, "id long, v double")
    assert len(distance.euclidean(items, "id", ["v"]).collect()) == 66 and seen.value == 12

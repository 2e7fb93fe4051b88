"""Small cases with known answers."""

import numpy as np
import pytest
from facetlake.operators import audit as A
from facetlake.operators import evaluate as E
from facetlake.operators import geometry as G
from facetlake.operators import instances as I
from facetlake.operators import manifest as M
from facetlake.operators import overlap as O
from facetlake.operators import records as C
from facetlake.operators import runs as R
from facetlake.operators import stencils as T
from facetlake.operators import views as V
from facetlake.operators.components import connected_components
from pyspark.sql import functions as F


def square(scene, inst, y0, y1, x0, x1, score=1.0, label=1):
    return [(scene, inst, label, score, y, x0, x1) for y in range(y0, y1)]


RUN = "scene long, inst long, label int, score double, y int, x0 int, x1 int"


def cells(runs, *keys):
    return {(tuple(r[k] for k in keys), r.y, x) for r in runs.collect() for x in range(r.x0, r.x1)}


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlapping_detections_merge_to_the_best(spark):
    runs = spark.createDataFrame(square(1, 1, 10, 40, 10, 40, 0.95) + square(1, 2, 12, 38, 12, 38, 0.80), RUN)
    got = I.merge_instances(runs, ["scene", "label"], "score", 0.5).select("cluster", "members", "score").distinct().collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.95)]


def test_weighted_merge_has_an_area(spark):
    runs = spark.createDataFrame(square(1, 1, 8, 32, 8, 32, 0.90) + square(1, 2, 16, 40, 16, 40, 0.85), RUN)
    got = I.merge_instances(runs, ["scene", "label"], "weighted", 0.2)
    assert cells(got, "cluster") == {((1,), y, x) for y in range(8, 32) for x in range(8, 32)}
    with pytest.raises(ValueError):
        I.vote_runs(runs, ["scene"], "other")


def test_touching_boxes_do_not_overlap(spark):
    runs = spark.createDataFrame(square(1, 1, 0, 4, 0, 4) + square(1, 2, 0, 4, 4, 8), RUN)
    assert O.instance_overlap(runs, runs, ["scene"], between=F.col("a.inst") < F.col("b.inst")).count() == 0


def test_morphology_equals_dense_windows(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((12, 15)) < 0.6
    px = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "k int, y int, x int")
    runs, frames = R.to_runs(px, ["k"]), spark.createDataFrame([(1,)], "k int")

    def window(m, f, fill, r):
        p = np.pad(m, r, constant_values=fill)
        return np.array([[f(p[y : y + 2 * r + 1, x : x + 2 * r + 1]) for x in range(m.shape[1])] for y in range(m.shape[0])])

    for r in (1, 2):
        grown, shrunk = window(mask, np.any, False, r), window(mask, np.all, True, r)
        for got, want in ((R.dilate(runs, ["k"], 12, 15, r), grown), (R.erode(runs, frames, ["k"], 12, 15, r), shrunk), (R.gradient(runs, frames, ["k"], 12, 15, r), grown & ~shrunk)):
            assert cells(got) == {((), int(y), int(x)) for y, x in zip(*np.nonzero(want), strict=True)}
    assert cells(R.complement(runs, frames, ["k"], 12, 15)) == {((), int(y), int(x)) for y, x in zip(*np.nonzero(~mask), strict=True)}


def test_overlay_lets_the_later_layer_win(spark):
    layers = spark.createDataFrame([(1, 0, 0, 6, 1, 0), (1, 0, 2, 4, 3, 1), (1, 0, 4, 8, 2, 2)], "k int, y int, x0 int, x1 int, v int, z int")
    got = sorted((r.x0, r.x1, r.v) for r in R.overlay(layers, ["k"], "v", ["z"]).collect())
    assert got == [(0, 2, 1), (2, 4, 3), (4, 8, 2)]


def test_rasterized_triangle_covers_its_inside_and_outline(spark):
    ring = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 6.0, 0.0), (1, 2, 0.0, 6.0)], "k int, ord int, x double, y double")
    assert cells(R.rasterize(ring, ["k"], 20, 20)) == {((), y, x) for y in range(7) for x in range(7 - y)}


def test_corner_touching_cells_are_one_component(spark):
    runs = spark.createDataFrame([("s", 0, 0, 2), ("s", 1, 2, 3), ("s", 3, 0, 1)], "k string, y int, x0 int, x1 int")
    got = R.run_components(runs, ["k"]).collect()
    assert len({r.component for r in got if r.y < 2}) == 1 and len({r.component for r in got}) == 2


def test_error_analysis_of_two_samples(spark):
    gt = R.merge_runs(spark.createDataFrame(square(1, 1, 8, 24, 8, 24) + square(2, 1, 10, 22, 10, 22), RUN), ["scene"])
    pred = R.merge_runs(spark.createDataFrame(square(1, 1, 8, 24, 8, 24) + square(2, 1, 0, 10, 0, 10), RUN), ["scene"])
    frames = spark.createDataFrame([(1,), (2,), (3,)], "scene long")
    m = E.foreground_iou(pred, gt, frames, ["scene"]).join(E.boundary_f1(pred, gt, frames, ["scene"], 32, 32), "scene")
    m = m.select(F.col("scene").alias("sample_id"), "roof_iou", E.hard_score(F.col("roof_iou"), F.col("f1")).alias("hard_score"))
    assert [r.sample_id for r in E.mine_hard(m, 1).collect()] == [2]
    assert {r.sample_id: r.roof_iou for r in m.collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    assert E.mine_hard(m, 0).count() == 3 and E.mine_hard(m, 5, 0.5).count() == 1


def test_precision_and_recall_at_the_edges(spark):
    p = spark.createDataFrame(square(1, 1, 0, 4, 0, 4) + square(2, 2, 0, 4, 0, 4), RUN)
    g = spark.createDataFrame(square(1, 11, 0, 4, 0, 4) + square(3, 12, 0, 4, 0, 4), RUN)
    frames = spark.createDataFrame([(i,) for i in range(1, 5)], "scene long")
    got = {r.scene: (r.precision, r.recall) for r in E.instance_precision_recall(O.instance_overlap(p, g, ["scene"]), p, g, frames, ["scene"]).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 1.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}


def test_plane_is_found_among_outliers(spark):
    rng = np.random.default_rng(1)
    pts = [(1, float(x), float(y), 0.1 * x + 0.2 * y + 5 + float(rng.normal(0, 0.05)) + (15 if x < 5 and y < 5 else 0)) for x in range(30) for y in range(30)]
    got = G.fit_plane(spark.createDataFrame([*pts, (2, 0.0, 0.0, 0.0)], "facet int, x double, y double, z double"), "facet").collect()
    assert len(got) == 1 and got[0].inliers > 500
    want = np.array([-0.1, -0.2, 1.0]) / np.linalg.norm([-0.1, -0.2, 1.0])
    assert np.dot([got[0].nx, got[0].ny, got[0].nz], want) > 0.98


def test_quality_flags(spark):
    ring = spark.createDataFrame([(i, o, x, y) for i in (1, 2, 3) for o, (x, y) in enumerate([(30.0, 20.0), (109.0, 20.0), (109.0, 89.0), (30.0, 89.0)])], "f int, ord int, x double, y double")
    facets = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 180.0), (2, None, None, None, None, None), (3, 0.0, 0.0, 0.5, 95.0, 360.0), (4, 0.0, 0.0, 1.0, 0.0, 0.0)], "f int, nx double, ny double, nz double, slope double, azimuth double")
    got = {r.f: (r.qa_polygon, r.qa_normal, r.qa_slope, r.qa_azimuth, r.qa_ok) for r in G.qa_flags(facets, ring, ["f"], 128, 128).collect()}
    assert got == {1: (True,) * 5, 2: (True, False, False, False, False), 3: (True, False, False, False, False), 4: (False, True, True, True, False)}


def test_normals_turn_with_the_picture(spark):
    rx, ry = G.rotate(F.col("x"), F.col("y"), 90)
    got = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "x double, y double").select(F.round(rx, 6), F.round(ry, 6)).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (0.0, 1.0)]


def test_rectangle_lines_make_a_graph_and_corners_snap(spark):
    box = [(10.0, 10.0), (50.0, 10.0), (50.0, 40.0), (10.0, 40.0)]
    seg = spark.createDataFrame([(1, i, *box[i], *box[(i + 1) % 4]) for i in range(4)], "scene int, seg long, x1 double, y1 double, x2 double, y2 double")
    node, edge = G.line_graph(seg, "scene", 5.0)
    assert (node.count(), edge.count()) == (4, 4)
    v = spark.createDataFrame([(1, 0, 11.5, 12.0), (1, 1, 30.0, 25.0)], "scene int, ord int, x double, y double")
    got = {r.ord: (r.x, r.y) for r in G.snap_to_lines(v, seg, "scene", 2.5).collect()}
    assert got == {0: (10.0, 12.0), 1: (30.0, 25.0)}


def test_near_right_corners_become_right(spark):
    ring = spark.createDataFrame([(1, o, x, y) for o, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.3), (10.2, 8.0), (0.1, 8.1)])], "k int, ord int, x double, y double")
    straight = G.vertex_angles(G.align_dominant(ring, ["k"]), ["k"]).collect()
    assert all(abs(r.angle - 90) < 1e-6 for r in straight)
    once = G.square_corners(ring, ["k"])
    assert once.count() == 4 and abs(G.vertex_angles(once, ["k"]).where("ord = 3").first().angle - 90) < 1e-6


def test_simplified_ring_stays_near(spark):
    a = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    ring = spark.createDataFrame([(1, i, float(50 + 40 * np.cos(t)), float(50 + 40 * np.sin(t))) for i, t in enumerate(a)], "k int, ord int, x double, y double")
    got = sorted((r.ord, r.x, r.y) for r in G.simplify(ring, ["k"], 0.02).collect())
    assert 4 <= len(got) < 30
    tolerance = 0.02 * 80 * 2 * 40 * np.sin(np.pi / 80)
    for x, y in zip(50 + 40 * np.cos(a), 50 + 40 * np.sin(a), strict=True):
        near = []
        for (_, x1, y1), (_, x2, y2) in zip(got, got[1:] + got[:1], strict=True):
            d = np.array([x2 - x1, y2 - y1])
            t = np.clip(np.dot([x - x1, y - y1], d) / np.dot(d, d), 0, 1)
            near.append(np.hypot(x - x1 - t * d[0], y - y1 - t * d[1]))
        assert min(near) <= tolerance + 1e-9


def test_sharp_pictures_rank_first(spark):
    grid = [("sharp", y, x, float(255 * (x % 8 == 0 or y % 8 == 0))) for y in range(32) for x in range(32)]
    soft = [("soft", y, x, 127 + 20 * float(np.sin(x / 9) + np.cos(y / 9))) for y in range(32) for x in range(32)]
    q = T.image_quality(spark.createDataFrame(grid + soft, "c string, y int, x int, z double"), ["c"]).withColumn("scene", F.lit(1))
    assert [r.c for r in T.rank_candidates(q, "scene", "c").orderBy("rank").collect()] == ["sharp", "soft"]


def test_sources_balance_and_hard_ids_repeat(spark):
    ids = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("b", "b2")], "source string, sample_id string")
    got = M.balance_sources(ids)
    assert {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 2}
    hard = M.hard_oversample(ids, spark.createDataFrame([("b1",)], "sample_id string"), 3)
    assert {r.sample_id: r.n for r in hard.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {"a1": 1, "b1": 3, "b2": 1}
    with pytest.raises(ValueError):
        M.hard_oversample(ids, ids, 0)
    assert M.balance_sources(ids.limit(0)).count() == 0


def test_source_descriptions_have_defaults(spark):
    s = M.describe_sources(spark.createDataFrame([("/data/one/", "train.txt")], "root string, split string")).first()
    assert (s.source, s.split, s.image_suffix, s.mask_dir, s.allow_missing_normal) == ("one", "/data/one/train.txt", ".jpg", "masks", True)
    with pytest.raises(ValueError):
        M.describe_sources(spark.createDataFrame([("x",)], "root string"))


def test_holdout_is_disjoint_unless_legacy(spark):
    ids = spark.createDataFrame([(f"i{k:02}",) for k in range(25)], "sample_id string")
    parts = [(r.part, r.sample_id) for r in M.holdout(ids).collect()]
    assert [p for p, _ in parts].count("val") == 2 and len(parts) == 25
    assert M.holdout(ids, legacy=True).count() == 27
    assert M.holdout(ids.limit(5), legacy=True).count() == 10 and M.holdout(ids.limit(5)).count() == 5


def test_gate_and_registry(spark):
    r = spark.createDataFrame([(1, "a", {"mIoU": 86.0, "AP50": 91.0, "BFScore": 81.0}), (2, "b", {"mIoU": 99.0}), (3, "", {"mIoU": 86.0, "AP50": 91.0, "BFScore": 81.0})], "seq int, checkpoint string, metrics map<string,double>")
    gated = C.kpi_gate(r)
    assert [x.status for x in gated.orderBy("seq").collect()] == ["promoted", "rejected", "promoted"]
    assert [x.checkpoint for x in C.last_promoted(gated.withColumn("run", F.lit(1)), ["run"]).collect()] == ["a"]


def test_unknown_labels_go(spark):
    got = A.map_labels(spark.createDataFrame([("panels",), ("tree",), ("property roof",)], "title string"), A.TITLE_CLASS, "title").collect()
    assert {r.title: r.cls for r in got} == {"panels": 3, "property roof": 2}


def test_tile_origins_cover_the_frame(spark):
    for size, want in ((1024, [0]), (2000, [0, 800, 976]), (2624, [0, 800, 1600]), (500, [0])):
        assert spark.range(1).select(R.tile_origins(F.lit(size), 1024, 800).alias("o")).first().o == want


def test_prompt_points_follow_raster_order(spark):
    runs = spark.createDataFrame(square(1, 1, 0, 10, 0, 10), RUN)
    ring = spark.createDataFrame(square(1, 1, 20, 24, 20, 24), RUN)
    got = sorted((not r.positive, r.k, r.y, r.x) for r in V.prompt_points(runs, ring, ["inst"]).collect())
    inside = [(False, 0, 4.5, 4.5)] + [(False, k + 1, k * 12 // 10, k * 12 % 10) for k in range(8)]
    assert got == inside + [(True, k, 20 + k // 4, 20 + k % 4) for k in range(16)]


def test_straight_lines_are_found(spark):
    line = spark.createDataFrame([(1, 20, x) for x in range(5, 60)] + [(1, 20, x) for x in range(80, 110)], "scene int, y int, x int")
    got = [(r.y1, r.y2, min(r.x1, r.x2), max(r.x1, r.x2)) for r in V.line_segments(line, "scene").where("theta = 90").collect()]
    assert sorted(got) == [(20, 20, 5, 59), (20, 20, 80, 109)]


def test_rings_of_a_mask_with_a_hole_and_a_corner_contact(spark):
    rows = [(1, y, 0, 6) for y in range(6) if y not in (2, 3)] + [(1, y, a, b) for y in (2, 3) for a, b in ((0, 2), (4, 6))] + [(1, 6, 6, 8), (1, 7, 6, 8)]
    runs = spark.createDataFrame(rows, "k int, y int, x0 int, x1 int")
    got = {}
    for r in R.rings(R.outline(runs, ["k"]), ["k"]).collect():
        got.setdefault(r.ring, []).append((r.ord, r.x, r.y))
    corners = [[p[1:] for p in sorted(v)] for _, v in sorted(got.items())]
    assert corners == [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)], [(6, 6), (8, 6), (8, 8), (6, 8)]]
    signed = {r.ring: r.signed for r in G.polygon_measures(R.rings(R.outline(runs, ["k"]), ["k"]), ["k", "ring"]).collect()}
    assert signed == {0: 36.0, 1: -4.0, 2: 4.0}


def test_polygon_of_a_slanted_mask(spark):
    # a right triangle with a step in each row, a spot that is too small, and a hole that does not count
    rows = [(1, y, 10, 10 + y) for y in range(10, 50)] + [(1, 5, 60, 62)]
    runs, frames = spark.createDataFrame(rows, "k int, y int, x0 int, x1 int"), spark.createDataFrame([(1,)], "k int")
    got = sorted((r.ord, r.x, r.y) for r in G.polygons_of_masks(runs, frames, ["k"], 64, 64, least_area=100.0).collect())
    assert 4 <= len(got) <= 6
    area = abs(sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(got, got[1:] + got[:1], strict=True))) / 2
    # the tolerance is 0.015 of the perimeter of about 170, along the longest side of about 57
    assert abs(area - sum(r[3] - r[2] for r in rows[:-1])) < 0.015 * 170 * 57
    assert G.polygons_of_masks(runs.limit(0), frames, ["k"], 64, 64).count() == 0


def test_percentiles_of_hot_keys_are_exact(spark):
    rng = np.random.default_rng(3)
    values = [(1, float(v)) for v in rng.normal(size=3000)] + [(2, 5.0)] * 2000 + [(2, 7.0)] * 2001 + [(3, 1.0), (3, 4.0), (4, None)]
    got = {r.k: (r.p0, r.p1, r.p2) for r in E.percentiles(spark.createDataFrame(values, "k int, v double"), ["k"], "v", [0.5, 0.95, 0.0]).collect()}
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(tuple(np.percentile([v for i, v in values if i == k], [50, 95, 0])))
    assert got[4] == (None, None, None)


def test_boxes_that_only_meet_do_not_make_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [r for i in range(60) for y, x, h, w in [rng.integers(0, 90, 2).tolist() + rng.integers(1, 40, 2).tolist()] for r in square(i % 2, i, y, y + h, x, x + w)]
    runs = spark.createDataFrame(rows, RUN)
    held = {}
    for s, i, _, _, y, x0, x1 in rows:
        held.setdefault((s, i), set()).update((y, x) for x in range(x0, x1))
    want = {(a[1], b[1]): len(held[a] & held[b]) for a in held for b in held if a[0] == b[0] and a[1] < b[1] and held[a] & held[b]}
    got = O.instance_overlap(runs, runs, ["scene"], between=F.col("a.inst") < F.col("b.inst")).collect()
    assert {(r.a, r.b): r.inter for r in got} == want


def test_first_rows_of_an_order(spark):
    ids = spark.createDataFrame([(f"s{i:03d}",) for i in range(500)], "sample_id string")
    assert sorted(r[0] for r in M.first_rows(ids, 123, F.desc("sample_id")).collect()) == [f"s{i:03d}" for i in range(377, 500)]


def test_refined_plane_has_the_least_orthogonal_distance(spark):
    rng = np.random.default_rng(2)
    normal = np.array([0.9, 0.2, 0.3]) / np.linalg.norm([0.9, 0.2, 0.3])  # steep
    pts = rng.uniform(-10, 10, (400, 3))
    pts = pts - (pts @ normal)[:, None] * normal + rng.normal(0, 0.05, (400, 1)) * normal
    r = G.fit_plane(spark.createDataFrame([(1, *map(float, p)) for p in pts], "facet int, x double, y double, z double"), "facet").first()
    want = np.linalg.svd(pts - pts.mean(axis=0))[2][2]
    assert abs(np.dot([r.nx, r.ny, r.nz], want)) > 1 - 1e-9 and r.inliers == 400

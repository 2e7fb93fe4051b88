"""Readers and writers on small files."""

import json

import pytest
from facetlake.sources import readers as S
from facetlake.sources import writers as K
from pyspark.sql import functions as F


def test_split_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a\n \tb \n\nc\n")
    path = str(tmp_path / "s.txt")
    assert [r.sample_id for r in S.read_split(spark, path).orderBy("line_no").collect()] == ["a", "b", "c"]
    assert [r.sample_id for r in S.read_split(spark, path, drop_blank=False).orderBy("line_no").collect()] == ["a", "b", "", "c"]
    assert S.read_split(spark, str(tmp_path / "none.txt")).count() == 0


def test_coco_documents(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 64, "height": 64}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "segmentation": [16, 16, 48, 16, 48, 48, 16, 48]},
            {"id": 2, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 4, 0, 4, 4], [1, 1, 2, 2]]},
            {"id": 3, "image_id": 1, "category_id": 1, "segmentation": {"counts": "x", "size": [4, 4]}},
            {"id": 4, "category_id": 1, "segmentation": [[0, 0, 4, 0, 4, 4]]},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    images, rings = S.read_coco(spark, str(tmp_path / "c.json"))
    assert images.count() == 1
    assert sorted((r.ann_no, r.ring_no, len(r.verts)) for r in rings.collect()) == [(0, 0, 4), (1, 0, 3)]
    assert [(r.x, r.y) for r in S.ring_vertices(rings).where("ann_no = 1").orderBy("ord").collect()] == [(0, 0), (4, 0), (4, 4)]


def test_yolo_labels(spark, tmp_path):
    (tmp_path / "p.txt").write_text("14 0.5 0.5 0.2 0.1\n\n99 0.5 0.5 0.2 0.1\n2 0.1 0.1 0.5 0.1 0.5 0.5\n")
    got = S.read_yolo(spark, str(tmp_path / "p.txt"), {14: 3, 2: 4}, 100, 200).orderBy("line_no").collect()
    assert [(r.image, r.cls, r.kind) for r in got] == [("p", 3, "box"), ("p", 4, "polygon")]
    assert got[0].coords == [80, 45, 120, 55] and got[1].coords == [20, 10, 100, 10, 100, 50]


def test_meshes(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# x\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1/1 2/2/2 3/3/3 4/4/4\nf 1 2 3\nf 1 2\n")
    v, f = S.read_obj(spark, str(tmp_path / "m.obj"))
    assert [(r.vid, r.x, r.y) for r in v.orderBy("vid").collect()] == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)]
    assert [(r.fid, r.a, r.b, r.c) for r in f.orderBy("fid", "part").collect()] == [(0, 0, 1, 2), (0, 0, 2, 3), (1, 0, 1, 2)]


def test_a_mesh_in_a_folder_of_its_own(spark, tmp_path):
    for name in ("left", "right"):
        (tmp_path / f"mesh={name}").mkdir()
        (tmp_path / f"mesh={name}" / "part-0.txt").write_text("v 0 0 0\nv 1 0 0\nv 1 1 2\nf 1 2 3\n")
    v, f = S.read_obj(spark, str(tmp_path))
    assert sorted((r.mesh, r.vid, r.z) for r in v.collect()) == [(m, i, z) for m in ("left", "right") for i, z in ((0, 0.0), (1, 0.0), (2, 2.0))]
    assert sorted((r.mesh, r.a, r.b, r.c) for r in f.collect()) == [("left", 0, 1, 2), ("right", 0, 1, 2)]


def test_bitmaps_and_candidates(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"size": {"height": 9, "width": 8}, "objects": [{"classTitle": "panels", "bitmap": {"origin": [2, 3], "data": "aGk="}}, {"classTitle": "panels"}]}))
    got = S.read_bitmap_json(spark, str(tmp_path / "b.json")).collect()
    assert [(r.image, r.title, r.origin_x, r.origin_y, bytes(r.data), r.height, r.width) for r in got] == [("b", "panels", 2, 3, b"hi", 9, 8)]
    (tmp_path / "list.json").write_text('{"inputs": ["a.png", " ", "b.png"]}')
    (tmp_path / "list.txt").write_text("a.png\n\n")
    (tmp_path / "none.txt").write_text("\n")
    assert [r.path for r in S.read_candidates(spark, str(tmp_path / "list.json")).orderBy("idx").collect()] == ["a.png", "b.png"]
    assert [r.path for r in S.read_candidates(spark, str(tmp_path / "list.txt")).collect()] == ["a.png"]
    with pytest.raises(ValueError):
        S.read_candidates(spark, str(tmp_path / "none.txt"))


def test_metrics_registry_and_logs(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sample_id,hard_score\na,0.5\n,0.9\nb,x\nc,0.1\n")
    assert [tuple(r) for r in S.read_metrics(spark, str(tmp_path / "m.csv")).orderBy("sample_id").collect()] == [("a", 0.0, 0.0, 0.5), ("c", 0.0, 0.0, 0.1)]
    (tmp_path / "r.json").write_text('[{"checkpoint": "a", "metrics": {"mIoU": 1}, "status": "promoted"}, {"checkpoint": "b", "status": "rejected"}]')
    (tmp_path / "o.json").write_text('{"x": 1}')
    assert [(r.seq, r.checkpoint) for r in S.read_registry(spark, str(tmp_path / "r.json")).orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    assert S.read_registry(spark, str(tmp_path / "o.json")).count() == 0
    (tmp_path / "l.json").write_text('{"iter": 5, "loss": 0.5}\nbroken\n[1]\n{"step": 6, "mode": "val", "mIoU": 0.7}\n')
    assert sorted((r.iter, r.mode, r.key, r.value) for r in S.read_log(spark, str(tmp_path / "l.json")).collect()) == [(5, "train", "loss", 0.5), (6, "val", "mIoU", 0.7)]


def test_a_document_of_too_many_features_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "ONE_DOCUMENT", 2)
    facets = spark.createDataFrame([(i, 1) for i in range(3)], "instance_id long, class_id int")
    ring = spark.createDataFrame([(i, o, x, y) for i in range(3) for o, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])], "instance_id long, ord int, x double, y double")
    with pytest.raises(ValueError, match="line by line"):
        K.write_features(facets, ring, "instance_id", str(tmp_path / "f"), one_document=True)
    K.write_features(facets, ring, "instance_id", str(tmp_path / "g"))
    assert S.read_feature_lines(spark, str(tmp_path / "g")).count() == 3


def test_features_round_trip(spark, tmp_path):
    facets = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.25)], "instance_id long, class_id int, confidence double")
    ring = spark.createDataFrame([(1, o, x, y) for o, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0)], "instance_id long, ord int, x double, y double")
    K.write_features(facets, ring, "instance_id", str(tmp_path / "f"), one_document=True)
    got = S.read_features(spark, str(tmp_path / "f")).collect()
    assert [(r.facet, r.class_id, r.confidence) for r in got] == [(1, 1, 0.5)]


def test_file_listing(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("a.JPG", "d/b.png", "d/e/c", "d/.hidden"):
        (tmp_path / name).write_text("x")
    got = {r.name: (r.ext, r.depth, r.stem) for r in S.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.JPG": (".jpg", 0, "a"), "b.png": (".png", 1, "b"), "c": ("no_ext", 2, "c")}


def test_splits_metrics_and_manifests(spark, tmp_path):
    ids = spark.createDataFrame([(f"i{k:02}",) for k in range(20)], "sample_id string")
    K.write_split(ids, str(tmp_path / "split"))
    assert S.read_split(spark, str(tmp_path / "split/val")).count() == 2
    assert S.read_split(spark, str(tmp_path / "split/train")).count() == 18
    m = spark.createDataFrame([("a", 0.9, 0.8, 0.15), ("b", 0.2, 0.1, 0.85)], "sample_id string, roof_iou double, bfscore double, hard_score double")
    K.write_metrics(m, str(tmp_path / "out"), 1)
    assert [r.sample_id for r in S.read_split(spark, str(tmp_path / "out/hard_ids")).collect()] == ["b"]
    report = K.error_report(m, spark.createDataFrame([(0, 0.5)], "cls int, iou double")).collect()
    assert ("summary", "roof_iou", "55.00") in [tuple(r) for r in report] and ("hardest", "b", "0.8500") in [tuple(r) for r in report]
    files = spark.read.format("binaryFile").load(str(tmp_path / "split/val"))
    assert K.run_manifest(files, tiles="9").where("kind = 'fact'").first().value == "9"
    assert K.adjacency(spark.createDataFrame([(1, 2, 3)], "scene int, a int, b int")).count() == 2
    K.write_runs(spark.createDataFrame([("s", 0, 0, 2, "train")], "sample_id string, y int, x0 int, x1 int, split string"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where(F.col("split") == "train").count() == 1

"""Archives that lie, logs, pipelines and views, beyond what the queries show."""

import pytest
from pyspark.sql import functions as F

from orbisight.operators import regions as R, reproject as P
from orbisight.plans.pipeline import Pipeline, Stage
from orbisight.sources import archive

H, W = 64, 128


def lattice(spark, panos=2):
    y, x = F.floor(F.col("id") / W).cast("int").alias("y"), (F.col("id") % W).cast("int").alias("x")
    return spark.range(panos * H * W).select(y, x, (100 + F.sin(F.col("id") % W / 20.0) * 10 + F.col("id") / W / 8).alias("value"), F.lit(True).alias("valid"))


def test_archive_is_checked(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    archive.save_archive(str(tmp_path / "a"), {"nodes": a})
    assert sorted(archive.load_archive(spark, str(tmp_path / "a"))["nodes"].collect()) == sorted(a.collect())
    a.limit(1).write.mode("append").parquet(str(tmp_path / "a" / "nodes"))
    with pytest.raises(ValueError, match="not what was saved"):
        archive.load_archive(spark, str(tmp_path / "a"))


def test_replay_leaves_the_last_entry(spark):
    log = spark.createDataFrame([(1, 1, "put", 5), (1, 2, "put", 6), (2, 1, "put", 7), (2, 3, "drop", None), (3, 1, "drop", None), (3, 2, "put", 8)], "id int, seq int, op string, v int")
    assert sorted((r.id, r.v) for r in archive.replay(log, ["id"], ["seq"], F.col("op") == "drop").collect()) == [(1, 6), (3, 8)]


def test_identity_follows_rows_and_parameters(spark):
    a, b = spark.range(5), spark.range(6)
    assert archive.identity({"k": 1}, a) == archive.identity({"k": 1}, a.repartition(3)) != archive.identity({"k": 1}, b)
    assert archive.identity({"k": 1}, a) != archive.identity({"k": 2}, a)
    made = []
    for _ in range(2):
        archive.kept({"test": id(made)}, lambda df: made.append(1) or df, a)
    assert made == [1]


def test_pipeline_round_trip(spark, tmp_path):
    p = Pipeline.of(Stage("box_blur", {"size": 3}), Stage("rotate", {"axis": [0.0, 1.0, 0.0], "radians": 0.0}), Stage("area_average"))
    p.save(spark, str(tmp_path / "p"))
    again = Pipeline.load(spark, str(tmp_path / "p"))
    assert again == p and again(lattice(spark)).first().cells == 2 * H * W
    with pytest.raises(ValueError, match="unknown"):
        Stage("nothing")


def test_all_stages_run(spark):
    c = lattice(spark, 1).withColumn("label", F.col("x") % 3)
    extra = {"filter2d": {"kernel": [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]]}, "rotate": {"axis": [1.0, 0.0, 0.0], "radians": 0.1}, "area_histogram": {"low": 0.0, "high": 500.0, "bins": 5}, "threshold": {"least": 1.0}, "select": {"column": "x"}}
    for name in ("filter2d", "gaussian_blur", "median_blur", "max_pool", "sobel", "gradient", "laplacian", "bilateral", "dilate", "erode", "rotate", "area_histogram", "analyze_regions", "threshold", "select"):
        assert Stage(name, extra.get(name, {}))(c).count() > 0, name
    same = Stage("filter2d", extra["filter2d"])(c).join(c.withColumnRenamed("value", "was"), ["y", "x"]).where(F.abs(F.col("value") - F.col("was")) > 1e-9)
    assert same.count() == 0


def test_cubemap_brings_a_smooth_panorama_back(spark):
    c = lattice(spark)
    faces = P.extract(c, P_CUBE, 92.0, 96, H, W)
    back = P.reconstruct(faces, P_CUBE, 92.0, 96, H, W, "closest")
    both = back.join(c.withColumnRenamed("value", "was"), ["y", "x"])
    worst, n = both.agg(F.max(F.abs(F.col("value") - F.col("was"))), F.count(F.lit(1))).first()
    assert n == 2 * H * W and worst < 3


from orbisight.operators.views import CUBE as P_CUBE  # noqa: E402


def test_panoramas_do_not_touch(spark):
    c = lattice(spark).withColumn("label", F.lit("a"))
    assert R.label_components(c, H, W).select("component").distinct().count() == 2
    assert R.label_components(c, H, W, connectivity=8).select("component").distinct().count() == 2


def test_components_raise_where_they_do_not_settle(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    edges = nodes.where("node > 0").select(F.col("node").alias("a"), (F.col("node") - 1).alias("b"))
    with pytest.raises(RuntimeError):
        R.components(nodes, edges, most_rounds=1)


def test_suppression_and_merging_match_plain_loops(spark):
    import random

    rng = random.Random(6)
    masks = {k: {rng.randrange(30) for _ in range(rng.randint(3, 14))} for k in range(40)}
    score = {k: rng.randrange(8) / 8 for k in masks}
    rows = spark.createDataFrame([(k, c) for k, m in masks.items() for c in m], "region long, cell long")
    scores = spark.createDataFrame(list(score.items()), "region long, score double")
    iou = lambda a, b: len(masks[a] & masks[b]) / len(masks[a] | masks[b])
    kept = []
    for k in sorted(masks, key=lambda k: (-score[k], k)):
        if all(iou(k, o) <= 0.3 for o in kept):
            kept.append(k)
    got = R.suppressed(scores, R.overlaps(rows).where("iou > 0.3").select("a", "b")).collect()
    assert sorted(r.region for r in got) == sorted(kept) and len(kept) > 3
    label = {k: k for k in masks}
    for _ in masks:
        for a in masks:
            for b in masks:
                if iou(a, b) >= 0.35:
                    label[a] = label[b] = min(label[a], label[b])
    want = {}
    for k, root in label.items():
        want.setdefault(root, []).append(k)
    want = sorted((min(g, key=lambda k: (-score[k], k)), len(g), len(set().union(*[masks[k] for k in g]))) for g in want.values())
    assert sorted(tuple(r) for r in R.merged(rows, scores, 0.35).collect()) == want
    assert R.suppressed(scores.limit(0), R.overlaps(rows).select("a", "b")).count() == 0


def test_typed_rows_refuse_another_kind(spark):
    from orbisight.sources import fields

    rows = spark.createDataFrame([(1, None, [1.5])], "a int, b string, c array<double>")
    told = fields.encoded(rows, "x")
    assert fields.decoded(told, "x", "a int, b string, c array<double>").collect() == rows.collect()
    with pytest.raises(Exception, match="kind"):
        fields.decoded(told, "y", "a int, b string, c array<double>").collect()


def test_arrays_become_cells(spark):
    import numpy as np

    from orbisight.sources import fields

    got = fields.from_array(spark, np.array([[1.0, np.nan], [3.0, 4.0]])).orderBy("y", "x").collect()
    assert [r.valid for r in got] == [True, False, True, True] and got[2].value == 3.0
    assert fields.constant(spark, 1, 2, 3, 7.0).where("value = 7").count() == 6

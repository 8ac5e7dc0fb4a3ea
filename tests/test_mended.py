"""Digests that tell tables apart, results kept by what makes them, suppression with nulls, gradients as surveyed."""

import uuid

import pytest

from orbisight.operators import match, regions, stencil
from orbisight.sources import archive
from orbisight.sources.lineage import shared_folder


def told(df):
    return archive.schema_of(df), *archive.digest(df).first()


def test_digests_tell_tables_apart(spark):
    frame = lambda rows, schema="p string, q string": spark.createDataFrame(rows, schema)
    tables = [
        frame([("a|b", "c")]), frame([("a", "b|c")]), frame([(None, "c")]), frame([("~", "c")]), frame([("", "c")]), frame([("c", None)]), frame([("a|b", "c")] * 2),
        frame([("1", 2)], "p string, q int"), frame([("1", 2)], "p string, q long"), frame([(["a", "b"], "c")], "p array<string>, q string"), frame([(["a, b"], "c")], "p array<string>, q string"),
        frame([(None, "c")], "p array<string>, q string"), frame([([None], "c")], "p array<string>, q string"), frame([({"k": "v"}, (1, None))], "p map<string,string>, q struct<x:int,y:int>"), frame([({"k": "v"}, (None, 1))], "p map<string,string>, q struct<x:int,y:int>"),
    ]
    seen = [told(t) for t in tables]
    assert len(set(seen)) == len(seen)
    rows = [(str(k), None if k % 3 else "x") for k in range(50)]
    assert told(frame(rows)) == told(frame(rows[::-1]).repartition(7)) == told(frame(rows).select("q", "p"))
    assert archive.digest(frame([]).limit(0)).first().rows == 0
    binary = lambda v: frame([(v,)], "p binary")
    assert told(binary(b"\x00")) != told(binary(b"\x01"))


def length(df):
    return df.selectExpr("length(p) as n")


def test_kept_results_belong_to_their_input(spark):
    config = {"id": uuid.uuid4().hex}
    a, b = (spark.createDataFrame([r], "p string, q string") for r in (("a|b", "c"), ("a", "b|c")))
    assert [archive.kept(config, length, x).first().n for x in (a, b, a)] == [3, 1, 3]
    assert archive.kept(config, lambda df: df.selectExpr("10 + length(p) as n"), a).first().n == 13
    times = lambda k: lambda df: df.selectExpr(f"{k} * length(p) as n")
    assert [archive.kept(config, times(k), a).first().n for k in (2, 5)] == [6, 15]


def test_archives_notice_changes(spark):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    a = spark.createDataFrame([(None, "c", 1)], "p string, q string, n int")
    archive.save_archive(folder, {"t": a})
    assert archive.load_archive(spark, folder)["t"].first().q == "c"
    for other in (a.na.fill("~"), a.withColumn("n", a.n.cast("long")), a.withColumnRenamed("q", "r"), a.union(a)):
        other.write.mode("overwrite").parquet(f"{folder}/t")
        with pytest.raises(ValueError, match="not what was saved"):
            archive.load_archive(spark, folder)


def kept(spark, scores, conflicts, kind=None):
    rows = spark.createDataFrame([(*s, "k")[:3] for s in scores], "region long, score double, class string")
    ties = spark.createDataFrame(conflicts, "a long, b long")
    return sorted((r.region for r in regions.suppressed(rows, ties, kind).collect()), key=lambda v: (v is None, v))


def test_suppression_of_regions(spark):
    scores = [(1, 5.0), (2, None), (3, 1.0)]
    assert kept(spark, scores, [(1, 2), (2, 3)]) == [1, 3]
    assert kept(spark, scores, [(1, 1), (1, 2), (3, 2), (2, 1)]) == [1, 3]
    assert kept(spark, [(1, 5.0, "x"), (2, 4.0, "y"), (3, 3.0, "x"), (4, 2.0, None), (5, 1.0, None)], [(1, 2), (1, 3), (4, 5), (3, 4)], "class") == [1, 2, 4]
    assert kept(spark, [(1, 5.0), (None, 9.0), (2, 5.0)], [(1, 2)]) == [1, None]
    assert kept(spark, [(1, None), (2, None), (2, None)], [(1, 2)]) == [1]
    with pytest.raises(ValueError, match="several scores"):
        kept(spark, [(1, 5.0), (2, 9.0), (2, 1.0)], [(1, 2)])


def test_suppression_of_bearings_with_nulls(spark):
    rows = [(1, "g", None, 0.0, 0.0), (2, "g", 1.0, 0.001, 0.0), (None, "g", 7.0, 1.0, 0.0), (3, "g", 7.0, 1.001, 0.0), (None, None, 2.0, 2.0, 0.0), (9, None, 1.0, 2.0, 0.0), (5, "g", None, 3.0, 0.0), (6, "g", None, 3.0, 0.0), (7, "g", 1.0, None, None)]
    got = match.angular_suppression(spark.createDataFrame(rows, "id long, g string, score double, lon double, lat double"), "g", 0.05).collect()
    assert sorted((r.id or 0, r.score or 0) for r in got) == [(0, 2.0), (2, 1.0), (3, 7.0), (5, 0), (7, 1.0)]


def test_gradients_look_back(spark):
    """A spike in a flat field: it and the cells after it in row and column are steep, those before it aren't."""
    value = {(y, x): 9.0 if (y, x) == (2, 2) else 1.0 for y in range(5) for x in range(5)}
    rows = [(y + pano * 5, x, v) for pano in range(2) for (y, x), v in value.items() if (y, x) != (4, 4)]
    got = {(r.y, r.x) for r in stencil.steep(spark.createDataFrame(rows, "y int, x int, value double"), 5, 8.0).collect()}
    every = {(y, x) for y, x, _ in rows}
    assert every - got == {(y + p, x) for p in (0, 5) for y, x in ((2, 2), (2, 3), (3, 2))}
    diagonal = spark.createDataFrame([(y, x, 3.0 * x + 4.0 * y) for y in range(3) for x in range(3)], "y int, x int, value double")
    assert {(r.y, r.x) for r in stencil.steep(diagonal, 3, 5.0).collect()} == {(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)}


def test_merging_by_class_and_containment(spark):
    """1 and 2 overlap by half, 3 lies inside 1 but is of another class, 4 has no class like 5 inside of it."""
    masks = {1: range(0, 6), 2: range(2, 8), 3: range(0, 2), 4: range(20, 30), 5: range(20, 22)}
    cells = spark.createDataFrame([(r, c) for r, m in masks.items() for c in m], "region long, cell long")
    scores = spark.createDataFrame([(1, 0.5, "x"), (2, 0.9, "x"), (3, 0.7, "y"), (4, None, None), (5, 0.1, None)], "region long, score double, class string")
    got = lambda **how: {(r.keeper, r.members, r.cells) for r in regions.merged(cells, scores, **how).collect()}
    assert got(least_iou=0.5) == {(2, 2, 8), (3, 1, 2), (4, 1, 10), (5, 1, 2)}
    assert got(least_iou=None, least_containment=0.9) == {(3, 2, 6), (2, 1, 6), (5, 2, 10)}
    assert got(least_iou=0.5, least_containment=0.9, kind="class") == {(2, 2, 8), (3, 1, 2), (5, 2, 10)}
    with pytest.raises(ValueError, match="threshold"):
        got(least_iou=None)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_holes_by_connectivity(spark, connectivity):
    import numpy as np

    rng = np.random.default_rng(connectivity)
    h, w = 8, 12
    inside, known = rng.random((h, w)) < 0.7, rng.random((h, w)) < 0.95
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not a * b)]
    area = [(np.sin(np.pi / 2 - np.pi * y / h) - np.sin(np.pi / 2 - np.pi * (y + 1) / h)) * 2 * np.pi / w for y in range(h)]
    want, seen = set(), set()
    for start in map(tuple, np.argwhere(known & ~inside)):
        if start in seen:
            continue
        piece, open_, frontier = {start}, False, [start]
        while frontier:
            y, x = frontier.pop()
            for a, b in steps:
                p = (y + a, (x + b) % w)
                if not 0 <= p[0] < h:
                    continue
                open_ |= not known[p]
                if known[p] and not inside[p] and p not in piece:
                    piece.add(p)
                    frontier.append(p)
        seen |= piece
        if not open_ and sum(area[y] for y, _ in piece) <= 0.5:
            want |= piece
    rows = spark.createDataFrame([(int(y), int(x), bool(inside[y, x])) for y, x in np.argwhere(known)], "y int, x int, inside boolean")
    assert {(r.y, r.x) for r in regions.filled(rows, h, w, 0.5, connectivity).collect()} == want

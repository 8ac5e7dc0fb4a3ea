"""Points at the camera's own place: the query's rows against its SQL where a range is zero."""

import duckdb

from orbisight import catalogue


def test_camera_rays_of_range_zero(spark, tmp_path):
    d = str(tmp_path)
    rows = [(k, "view", v) for k, v in enumerate((0.0, 2.5, 0.0, 0.01, 490.0))] + [(8192 + 130, "error", 0.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.queries()["camera_rays"](spark, d).select("y", "x", "rx", "ry", "rz").collect()))
    assert got == sorted(con.execute(f"SELECT y, x, rx, ry, rz FROM ({catalogue.oracle_sql()['camera_rays']})").fetchall())

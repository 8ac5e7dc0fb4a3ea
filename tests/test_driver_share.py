"""What reaches the driver for a join is fixed by the lattice, not by how many panoramas a stack has."""

import duckdb
import pytest

from orbisight import catalogue

STACK = 40


@pytest.fixture(scope="module")
def stack(spark, tmp_path_factory):
    """40 panoramas of 400 cells each; the last has none that is valid, and one place in the stack is empty."""
    d = str(tmp_path_factory.mktemp("stack"))
    kind = lambda p, k: "error" if p == STACK or k % 9 == 0 else "view"
    rows = [(p * 8192 + k * 8191 // 400, kind(p, k), (k * 7 + p) % 100 + 0.5) for p in range(STACK + 1) if p != 5 for k in range(400)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def broadcast_rows(df):
    """Rows of each table that the query's final plan broadcast."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if name == "BroadcastExchangeExec":
                found.append(node.metrics().get("numOutputRows").get().value())
            left += [node.children().apply(k) for k in range(node.children().size())]
    return found


QUERIES = ["cubemap_faces_bilinear", "reconstruct_average", "reconstruct_nearest_axis", "reconstruct_gaussian", "reconstruct_closest", "reconstruct_feathering"]


@pytest.mark.parametrize("name", QUERIES)
def test_joins_send_one_lattice(spark, stack, name):
    df = catalogue.queries()[name](spark, stack)
    rows = broadcast_rows(df)
    assert rows and max(rows) <= 6 * 24 * 24 * 4  # four corners of each pixel of a cube's faces
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{stack}/events.parquet/*.parquet'")
    names = ", ".join(df.columns)
    got, want = sorted(map(tuple, df.collect()), key=repr), sorted(con.execute(f"SELECT {names} FROM ({catalogue.oracle_sql()[name]})").fetchall(), key=repr)
    assert len(got) > STACK and got == want


@pytest.mark.parametrize("how", ["nearest", "bilinear"])
def test_large_lattices_are_merged(spark, stack, monkeypatch, how):
    from orbisight.operators import reproject, stencil, views
    from orbisight.sources.tables import cells

    found = lambda: reproject.extract(cells(spark, stack), views.CUBE, 95.0, 16, 64, 128, how)
    few = sorted(map(repr, found().drop("value", "weight").collect()))
    monkeypatch.setattr(stencil, "BROADCAST_ROWS", 0)
    assert not broadcast_rows(found())
    assert sorted(map(repr, found().drop("value", "weight").collect())) == few

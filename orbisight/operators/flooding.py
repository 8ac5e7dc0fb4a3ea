"""Watersheds of markers: least barriers first, then least steps, settled tile by tile.

The lattice is cut into tiles, each a row of arrays.  In a round every tile that got news settles itself as far as its
own cells allow, and what changed on its border is sent to the tiles beside it; news travels a tile a round, so rounds are
few, a task holds one tile, and a lattice of any size or number of panoramas works.  Barriers are settled first: the least
over all paths of the highest cell on them.  Then labels spread, fewest steps first and then the smaller label, along the
steps that keep a cell's barrier; markers stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..sources.lineage import written

AROUND = {4: [(-1, 0), (0, -1), (0, 1), (1, 0)], 8: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]}
_TILE = "pano long, ty int, tx int, h int, w int, value binary, marker binary, cost binary, steps binary, label binary, changed boolean"
_NEWS = "pano long, ty int, tx int, ly int, lx int, cost double, steps long, label long"
_FAR = np.iinfo(np.int64).max


def _packed(key: tuple, table: pa.Table, tile: int, height: int, width: int) -> pa.Table:
    """A tile from its cells: the value is NaN where there is none; markers cost their own value and no step."""
    pano, ty, tx = (k.as_py() for k in key)
    h, w = min(tile, height - ty * tile), min(tile, width - tx * tile)
    at = table["ly"].to_numpy(), table["lx"].to_numpy()
    value, marker = np.full((h, w), np.nan), np.zeros((h, w), np.int64)
    value[at] = table["value"].to_numpy(zero_copy_only=False)
    marker[at] = table["marker"].to_numpy(zero_copy_only=False)
    cost = np.where(marker > 0, value, np.inf)
    steps = np.where(marker > 0, 0, _FAR)
    made = [pano, ty, tx, h, w, *(a.tobytes() for a in (value, marker, cost, steps, marker)), True]
    return pa.Table.from_pylist([dict(zip([c.split()[0] for c in _TILE.split(", ")], made, strict=True))], _arrow(_TILE))


def _arrow(schema: str) -> pa.Schema:
    """The Arrow form of a flat schema, also where there is no session."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    kinds = {"value": np.float64, "marker": np.int64, "cost": np.float64, "steps": np.int64, "label": np.int64}
    return tuple(np.frombuffer(row[n], k).reshape(row["h"], row["w"]).copy() for n, k in kinds.items())


def settled(value: np.ndarray, marker: np.ndarray, cost: np.ndarray, steps: np.ndarray, label: np.ndarray, news: list[dict], around: list, labels: bool) -> tuple[np.ndarray, ...]:
    """A tile's arrays when nothing inside it changes any more, with what is told of the cells around it."""
    h, w = value.shape
    rim = [np.full((h + 2, w + 2), fill, kind) for fill, kind in ((np.inf, np.float64), (_FAR, np.int64), (0, np.int64))]
    for x in news:
        at = x["ly"] + 1, x["lx"] + 1
        rim[0][at], rim[1][at], rim[2][at] = x["cost"], x["steps"], x["label"]
    free = ~np.isnan(value) & (marker <= 0)
    own = [np.where(np.isnan(value), fill, a) for a, fill in ((cost, np.inf), (steps, _FAR), (label, 0))]
    while True:
        for field, a in zip(rim, own, strict=True):
            field[1:-1, 1:-1] = a
        best = [a.copy() for a in own]
        for dy, dx in around:
            c, s, name = (field[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for field in rim)
            if labels:
                # steps that keep the barrier; the neighbour must have a label itself
                tight = free & (s < _FAR) & (np.maximum(c, value) == own[0])
                one = np.where(s < _FAR, s, 0) + 1
                better = tight & ((one < best[1]) | ((one == best[1]) & (name < best[2])))
                best[1][better], best[2][better] = one[better], name[better]
            else:
                np.minimum(best[0], np.where(free, np.maximum(c, value), best[0]), out=best[0])
        if all(np.array_equal(a, b) for a, b in zip(own, best, strict=True)):
            return tuple(own)
        own = best


def _round(around: list, labels: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_TILE)
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                value, marker, cost, steps, label = _unpacked(row)
                now = settled(value, marker, cost, steps, label, row.pop("news") or [], around, labels)
                # the first round of a phase settles every tile and tells its border even if nothing in it moved
                row["changed"] = row["changed"] or any(not np.array_equal(a, b) for a, b in zip((cost, steps, label), now, strict=True))
                row |= {n: a.tobytes() for n, a in zip(("cost", "steps", "label"), now, strict=True)}
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _news(around: list, tile: int, height: int, width: int):  # noqa: ANN202
    """What changed tiles tell the tiles beside them: their border as seen from there; the seam wraps, the poles do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_NEWS)
        for batch in batches:
            for row in batch.to_pylist():
                value, _, cost, steps, label = _unpacked(row)
                h, w = value.shape
                told = []
                for ly, lx in np.argwhere(np.isfinite(cost) & ~np.isnan(value)):
                    if 0 < ly < h - 1 and 0 < lx < w - 1:
                        continue
                    y, x = row["ty"] * tile + int(ly), row["tx"] * tile + int(lx)
                    for dy, dx in around:
                        if (0 <= ly + dy < h and 0 <= lx + dx < w) or not 0 <= y + dy < height:
                            continue
                        ny, nx = y + dy, (x + dx) % width
                        told.append((row["pano"], ny // tile, nx // tile, ny % tile - dy, nx % tile - dx, cost[ly, lx], int(steps[ly, lx]), int(label[ly, lx])))
                columns = zip(*set(told), strict=True) if told else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _spread(tiles: DataFrame, tile: int, height: int, width: int, around: list, labels: bool) -> DataFrame:
    """Rounds until no tile changes."""
    key = ["pano", "ty", "tx"]
    settle = _round(around, labels)
    now = written(tiles.withColumn("changed", F.lit(True)).withColumn("news", F.lit(None).cast("array<struct<ly:int,lx:int,cost:double,steps:bigint,label:bigint>>")).mapInArrow(settle, _TILE))
    while not now.where("changed").isEmpty():
        news = now.where("changed").mapInArrow(_news(around, tile, height, width), _NEWS)
        heard = news.groupBy(*key).agg(F.collect_list(F.struct("ly", "lx", "cost", "steps", "label")).alias("news"))
        met = now.withColumn("changed", F.lit(False)).join(heard, key, "left")
        still, asked = met.where("news IS NULL").drop("news"), met.where("news IS NOT NULL")
        now = written(still.unionByName(asked.mapInArrow(settle, _TILE)))
    return now


def watershed(cells: DataFrame, value: str, marker: str, height: int, width: int, connectivity: int = 8, tile: int = 64) -> DataFrame:
    """(y, x, label, cost, steps) of every cell that some marker reaches; markers are positive, null and 0 are none.

    Cells with a null or infinite value are outside of the domain, and a marker there raises.
    """
    if connectivity not in AROUND:
        raise ValueError("connectivity is 4 or 8")
    row = G.row_in(F.col("y"), height)
    v, m = F.col(value).cast("double"), F.coalesce(F.col(marker).cast("long"), F.lit(0))
    inside = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    outside = F.raise_error(F.lit("a marker lies outside of the domain"))
    checked = F.when((m > 0) & ~F.coalesce(inside, F.lit(False)), outside.cast("long")).otherwise(F.greatest(m, F.lit(0)))
    each = cells.select(F.floor(F.col("y") / height).alias("pano"), F.floor(row / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), (row % tile).cast("int").alias("ly"), (F.col("x") % tile).cast("int").alias("lx"), v.alias("value"), checked.alias("marker"))
    placed = each.where((F.col("marker") > 0) | F.coalesce(inside, F.lit(False)))
    tiles = written(placed.groupBy("pano", "ty", "tx").applyInArrow(lambda key, table: _packed(key, table, tile, height, width), _TILE))
    around = AROUND[connectivity]
    done = _spread(_spread(tiles, tile, height, width, around, False), tile, height, width, around, True)

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("y int, x int, label long, cost double, steps long")
        for batch in batches:
            for r in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                _, _, cost, steps, label = _unpacked(r)
                ly, lx = np.nonzero(label > 0)
                made = (r["pano"] * height + r["ty"] * tile + ly, r["tx"] * tile + lx, label[ly, lx], cost[ly, lx], steps[ly, lx])
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(made, schema, strict=True)], schema=schema)

    return done.mapInArrow(cells_of, "y int, x int, label long, cost double, steps long")

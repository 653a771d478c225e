"""Rasters of whole maps."""

from __future__ import annotations

from hazgrid.operators import outputs


def test_own_extent_holds_every_cell(spark):
    known = {(0, -24, 3): 5, (0, 22, -2): 7, (0, 0, 0): 0, (4, 9, 9): 100}
    cells = spark.createDataFrame([(*k, v) for k, v in known.items()], "map_id long, ci int, cj int, occ int")
    got = {(r["map_id"], r["i0"] + k, r["cj"]): v for r in outputs.dense(cells, "occ").collect() for k, v in enumerate(r["row"])}
    want = {(0, i, j): -1 for i in range(-24, 23) for j in range(-2, 4)} | known
    assert got == want
    assert outputs.dense(cells.limit(0), "occ").count() == 0

"""Labels across tiles are those of whole frames, for any size of tile."""

import numpy as np
import pandas as pd
import pytest

from galvane.operators import kernels, tiles


def whole(masks, corners):
    out = {}
    for f, mask in masks.items():
        i, j = np.nonzero(mask)
        if len(i):
            rows = kernels.label_components(pd.DataFrame({"i": i, "j": j}), corners)
            out |= {(f, a, b): c for a, b, c in rows[["i", "j", "label"]].itertuples(index=False)}
    return out


@pytest.mark.parametrize(("tile", "corners"), [(1, False), (3, True), (5, False), (64, True)])
def test_any_tile(spark, tile, corners):
    rng = np.random.default_rng(tile)
    masks = {f: rng.random((14, 17)) < share for f, share in ((0, 0.5), (1, 0.62), (2, 0.0))}
    snake = np.zeros((14, 17), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks[3] = snake
    pixels = [(f, int(i), int(j)) for f, m in masks.items() for i, j in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(pixels + pixels[:5] + [(0, None, 1)], "frame int, i int, j int").repartition(3)
    got = {(r["frame"], r["i"], r["j"]): r["label"] for r in tiles.labelled(df, tile, corners).collect()}
    assert got == whole(masks, corners)


def test_levels_nest(spark):
    field = [(0, i, j, float(10 * min(i, 6 - i, j, 6 - j))) for i in range(7) for j in range(7)] + [(0, 0, 9, 30.0)]
    df = spark.createDataFrame(field, "frame int, i int, j int, value double")
    got = {(r["i"], r["j"]): (r["label_0"], r["label_1"], r["label_2"]) for r in tiles.levels(df, (10, 20, 30), tile=2).collect()}
    assert got[3, 3] == (2, 2, 2) and got[0, 9] == (1, 1, 1) and got[1, 1] == (2, 0, 0) and got[2, 2] == (2, 2, 0) and (0, 0) not in got
    assert tiles.labelled(df.where("false").select("frame", "i", "j")).count() == 0

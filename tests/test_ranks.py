"""Running sums, percentiles, the area under the curve and the isotonic fit by ranges, against one sequence each."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galvane.operators import hulls, kernels
from galvane.operators.ranks import running
from galvane.plans import ranked


def test_running_sums_of_hot_and_small_groups(spark, many_ranges):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(30), rnd.randrange(500), rnd.randrange(9)) for _ in range(4000)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k int, at int, n int").repartition(5)
    got = running(df, ["k"], [F.col("at"), F.col("n")], {"sum": F.col("n"), "place": F.lit(1)}, keep=["_range"]).toPandas()
    assert got[got.k == 0]._range.nunique() > 1 and len(got) == 4000
    for k, own in got.sort_values(["k", "place"]).groupby("k"):
        assert own.place.tolist() == list(range(1, len(own) + 1))
        assert own["sum"].tolist() == own.n.cumsum().tolist()
        assert list(zip(own["at"], own.n, strict=True)) == sorted((a, n) for c, a, n in rows if c == k)
    whole = running(df.where("k = 3"), [], [F.col("at")], {"place": F.lit(1)}).toPandas()
    assert sorted(whole.place) == list(range(1, len(whole) + 1))
    assert running(df.where("false"), ["k"], [F.col("at")], {"place": F.lit(1)}).count() == 0


def test_percentiles_and_auc(spark, many_ranges):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"key": rng.integers(0, 3, 900), "v": rng.integers(0, 40, 900) / 4.0})
    rows.loc[rows.key == 2, "v"] = 7.0
    df = spark.createDataFrame([(int(k), float(v)) for k, v in rows.itertuples(index=False)] + [(1, None)], "key int, v double")
    got = {r["key"]: r for r in ranked.percentiles_of(df, "key", "v", {"a": 0.1, "b": 0.5, "c": 0.99, "d": 1.0}).collect()}
    for k, own in rows.groupby("key"):
        assert [got[k][c] for c in "abcd"] == pytest.approx(np.quantile(own.v, [0.1, 0.5, 0.99, 1.0]), abs=1e-6)
    sketch = {r["key"]: r for r in ranked.percentile_sketches(df, ["key"], "v", {"b": 0.5}).collect()}
    for k, own in rows.groupby("key"):
        share = [(own.v < sketch[k]["b"]).mean(), (own.v <= sketch[k]["b"]).mean()]
        assert share[0] <= 0.5 + 1e-3 and share[1] >= 0.5 - 1e-3
    scored = pd.DataFrame({"k": rng.integers(0, 2, 400), "p": rng.integers(0, 20, 400) / 20, "y": rng.integers(0, 2, 400)})
    out = {r["k"]: r["auc"] for r in ranked.auc(spark.createDataFrame(scored), "k").collect()}
    for k, own in scored.groupby("k"):
        pos, neg = own[own.y == 1].p.to_numpy(), own[own.y == 0].p.to_numpy()
        assert out[k] == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2), abs=1e-6)
    assert ranked.auc(spark.createDataFrame([(1, 0.5, 1)], "k int, p double, y int"), "k").first()["auc"] is None


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_as_pooling(spark, many_ranges, seed, monkeypatch):
    """Knots of merged hulls are those of pooling adjacent violators over the whole sequence."""
    monkeypatch.setattr(hulls, "MERGED", 2)
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"lead": rng.integers(0, 2, 1500), "p": rng.integers(0, 300, 1500) / 300})
    rows["y"] = (rng.random(1500) < (rows.p if seed else 0.3)).astype(int)
    rows.loc[rows.p < 0.05, "y"] = 0
    by = rows.groupby(["lead", "p", "y"]).size().reset_index(name="n")
    got = hulls.isotonic(spark.createDataFrame(by).repartition(4), "lead").toPandas()
    for lead, own in by.groupby("lead"):
        want = kernels.fit_isotonic(own.rename(columns={"y": "mean"}).assign(lead=lead))
        mine = got[got.lead == lead].sort_values("ord")
        assert mine.ord.tolist() == want.ord.tolist() and mine.threshold.tolist() == want.threshold.tolist()
        assert np.allclose(mine.value, want.value, atol=1e-6)


def test_lower_hull():
    assert hulls.lower_hull([0, 1, 2, 3, 4], [0, 0, 0, 1, 4]) == [0, 2, 3, 4]
    assert hulls.lower_hull([0, 1], [0, 1]) == [0, 1] and hulls.lower_hull([5], [3]) == [0]

"""Every product query against its SQL on the middle tables."""

import math

import duckdb
import pytest

from galvane.plans import catalog, products  # noqa: F401
from galvane.sources import views
from tests.test_plans import text

SF = "/root/testdata/sf0.01"
NAMES = sorted(n for n, f in catalog.QUERIES.items() if f"relational(\"{n}\"" in open(products.__file__).read())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "lineitem", "supplier", "nation", "region", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(ours) and text(ours) == text(con.execute(catalog.SQL[name]).df())


def test_advection_reads_the_storms_own_day(spark):
    """Every storm's probability from the pixels of the day that its cycle (four hours) is in, by hand."""
    obs = views.v_obs(spark, SF).where("s is not null").select("cycle", "us", "i", "j", "modality", "value").toPandas()
    obs["day"] = (obs.us - 1704067200000000) // 86400000000
    radar = obs[obs.modality == "radar"].groupby(["cycle", "i", "j"]).value.max()
    storms = radar[radar >= 74].index
    days = {(c, i, j): int(obs[(obs.cycle == c)].day.iloc[0]) for c, i, j in storms}
    got = {(r["cycle"], r["i"], r["j"]): r["p"] for r in catalog.QUERIES["advection_baseline"](spark, SF).collect()}
    assert set(got) == set(storms) and len(set(days.values())) > 2
    for c, i, j in list(storms)[::50]:
        near = obs[(obs.day == days[c, i, j]) & ((obs.i - i).abs() <= 2) & ((obs.j - j).abs() <= 2)].value.max()
        assert abs(got[c, i, j] - (1 - math.exp(-0.05 * min(near / 255, 1) * 30))) < 1e-5

"""Motion of storms: a constant-velocity Kalman filter, and what follows from its state.

Both axes are filtered by one scalar recursion: they share variances, so one 2 x 2 covariance (three numbers)
serves latitude and longitude. Rows of a track stream through a task in order of time; a task holds the state of one
track and a batch of rows. Speed, heading, path, cone and acceleration are column expressions over the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

KM_PER_DEGREE = 111.32
#: Drift of velocity, measurement variance, first variances of place and velocity.
DRIFT, SEEN, PLACE_0, SPEED_0 = 0.8, 0.005**2, 0.01**2, 1.0
LEADS = (15, 30, 45, 60)

#: lat, lon, v_lat, v_lon (degrees, degrees an hour), then variance of place, covariance, variance of velocity.
State = tuple[float, float, float, float, float, float, float]


def first(lat: float, lon: float) -> State:
    return lat, lon, 0.0, 0.0, PLACE_0, 0.0, SPEED_0


def step(state: State, hours: float, lat: float, lon: float) -> State:
    """Predict over hours (at least 0.0001) and take in what was seen."""
    x, y, u, v, a, b, c = state
    h = max(1e-4, hours)
    x, y = x + h * u, y + h * v
    a, b, c = a + 2 * h * b + h * h * c + DRIFT * h**3 / 3, b + h * c + DRIFT * h * h / 2, c + DRIFT * h
    k1, k2 = a / (a + SEEN), b / (a + SEEN)
    dx, dy = lat - x, lon - y
    return x + k1 * dx, y + k1 * dy, u + k2 * dx, v + k2 * dy, (1 - k1) * a, (1 - k1) * b, c - k2 * b


def filtered(rows: DataFrame, key: str, hours: str, lat: str, lon: str) -> DataFrame:
    """rows with f_lat, f_lon, v_lat, v_lon: the filter's state after each row of its track, in order of hours, then lat, lon.

    Rows with a null in key, hours, lat or lon are left out.
    """
    schema = rows.schema.add("f_lat", "double").add("f_lon", "double").add("v_lat", "double").add("v_lon", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track = state = last = None
        for batch in batches:
            out = np.empty((len(batch), 4))
            for n, (k, t, y, x) in enumerate(zip(batch[key], batch[hours], batch[lat], batch[lon], strict=True)):
                if k != track:
                    track, state = k, first(y, x)
                else:
                    state = step(state, t - last, y, x)
                last = t
                out[n] = state[:4]
            yield batch.assign(f_lat=out[:, 0], f_lon=out[:, 1], v_lat=out[:, 2], v_lon=out[:, 3])

    whole = rows.dropna(subset=[key, hours, lat, lon])
    return whole.repartition(key).sortWithinPartitions(key, hours, lat, lon).mapInPandas(run, schema)


def east() -> Column:
    return F.col("v_lon") * KM_PER_DEGREE * F.cos(F.radians("f_lat"))


def north() -> Column:
    return F.col("v_lat") * KM_PER_DEGREE


def speed() -> Column:
    return F.sqrt(east() * east() + north() * north())


def heading() -> Column:
    """Degrees from north, clockwise; 0 below half a km/h."""
    turn = F.degrees(F.atan2(east(), north()))
    return F.when(speed() < 0.5, 0.0).when(turn < 0, turn + 360).otherwise(turn)


def point(lat: Column, lon: Column) -> Column:
    return F.struct(F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


def path(leads: tuple[int, ...] = LEADS) -> Column:
    """Places at the leads."""
    return F.array(*[point(F.col("f_lat") + F.col("v_lat") * (m / 60), F.col("f_lon") + F.col("v_lon") * (m / 60)) for m in leads])


def cone(base_km: Column, sigma_kmh: float = 12.0, leads: tuple[int, ...] = LEADS) -> Column:
    """The 90 % region ahead as a closed ring: left side out, the cap's five points, right side back; a circle of 17 points below 1 km/h."""
    flat = lambda lat: F.greatest(F.cos(F.radians(lat)), F.lit(1e-4))
    lat, lon, u, v, s = F.col("f_lat"), F.col("f_lon"), east(), north(), speed()
    far = base_km + 1.645 * sigma_kmh
    circle = F.array(*[point(lat + far / KM_PER_DEGREE * np.sin(2 * np.pi * k / 16), lon + far / (KM_PER_DEGREE * flat(lat)) * np.cos(2 * np.pi * k / 16)) for k in range(17)])

    def side(m: int, sign: int) -> Column:
        h = m / 60
        plat, plon, r = lat + F.col("v_lat") * h, lon + F.col("v_lon") * h, base_km + 1.645 * sigma_kmh * h
        return point(plat + sign * (u / s * r) / KM_PER_DEGREE, plon + sign * (-v / s * r) / (KM_PER_DEGREE * flat(plat)))

    end = leads[-1] / 60
    elat, elon, r, way = lat + F.col("v_lat") * end, lon + F.col("v_lon") * end, base_km + 1.645 * sigma_kmh * end, F.atan2(u, v)
    cap = [point(elat + r * F.cos(way + np.pi / 2 - np.pi * k / 6) / KM_PER_DEGREE, elon + r * F.sin(way + np.pi / 2 - np.pi * k / 6) / (KM_PER_DEGREE * flat(elat))) for k in range(1, 6)]
    left, right = [side(m, 1) for m in (0, *leads)], [side(m, -1) for m in (0, *leads)]
    return F.when(s < 1, circle).otherwise(F.array(*left, *cap, *right[::-1], left[0]))


def base_radius(pixels: Column, pixel_km2: float) -> Column:
    """Of a circle of the storm's area, 8 km at least."""
    return F.greatest(F.lit(8.0), F.sqrt(pixels * pixel_km2 / np.pi))


def accelerated(rows: DataFrame, key: str, hours: str, lat: str) -> DataFrame:
    """rows of filtered() with accel_x, accel_y and accel (km/h an hour): the change of the filter's velocity from the row before; 0 in a track's first two rows."""
    w = Window.partitionBy(key).orderBy(hours, lat)
    before = rows.select("*", F.lag("v_lat").over(w).alias("_v"), F.lag("v_lon").over(w).alias("_u"), F.lag(hours).over(w).alias("_t"), F.lag(hours, 2).over(w).alias("_tt"))
    h = F.greatest(F.col(hours) - F.col("_t"), F.lit(1e-4))
    y = (F.col("v_lat") - F.col("_v")) / h * KM_PER_DEGREE
    x = (F.col("v_lon") - F.col("_u")) / h * KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.1))
    early = F.isnull("_tt")
    out = before.withColumn("accel_x", F.when(early, 0.0).otherwise(x)).withColumn("accel_y", F.when(early, 0.0).otherwise(y))
    return out.withColumn("accel", F.sqrt(F.col("accel_x") * F.col("accel_x") + F.col("accel_y") * F.col("accel_y"))).drop("_v", "_u", "_t", "_tt")

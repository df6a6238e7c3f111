"""Forecasts settled by event time: each (forecast, lead) once, when the watermark passes issue + lead.

No stream-stream join and no Python state: a flash is sent to the pixels and to the earlier cycles whose
outcome windows hold it, so that forecasts and outcomes meet in one windowed aggregation whose key is the
time when the pair is due. The state store closes a key at that time, like a timer, and a pair that was
closed cannot be settled again. The same plan over static tables is the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CYCLE_US = 600_000_000
KM_PER_DEGREE = 111.32


def outcomes(flashes: DataFrame, leads: tuple[int, ...], radius_km: float, reach: int = 2) -> DataFrame:
    """flashes (time, lat, lon) -> the (issued, i, j, lead) whose window (issued, issued + lead] and box hold them.

    reach is the number of 0.1 degree pixels to each side that a box can touch. Rows with a null go.
    """
    last = F.ceil(F.unix_micros("time") / CYCLE_US) - 1
    near = F.sequence(F.lit(-reach), F.lit(reach))
    rows = flashes.select("time", "lat", "lon", F.explode(F.array(*map(F.lit, leads))).alias("lead"))
    rows = rows.select("*", F.explode(F.sequence(last - (F.col("lead") / 10).cast("long") + 1, last)).alias("at"))
    rows = rows.select("*", F.explode(near).alias("di")).select("*", F.explode(near).alias("dj"))
    i, j = F.rint((26.0 - F.col("lat")) * 10) + F.col("di"), F.rint((F.col("lon") - 84.0) * 10) + F.col("dj")
    rows = rows.select("*", i.cast("int").alias("i"), j.cast("int").alias("j"))
    lat, lon = 26.0 - 0.1 * F.col("i"), 84.0 + 0.1 * F.col("j")
    inside = (F.abs(F.col("lat") - lat) <= radius_km / KM_PER_DEGREE) & (F.abs(F.col("lon") - lon) <= radius_km / (KM_PER_DEGREE * F.cos(F.radians(lat))))
    return rows.where(inside).select(F.timestamp_micros((F.col("at") * CYCLE_US).cast("long")).alias("issued"), "i", "j", "lead")


def settled(forecasts: DataFrame, flashes: DataFrame, leads: tuple[int, ...] = (10, 20, 30), radius_km: float = 12.0, late_minutes: int = 30) -> DataFrame:
    """forecasts (issued, i, j) and flashes (time, lat, lon), both streams or both static -> issued, i, j, lead, due, y.

    Issue times lie on ten-minute cycles, leads are multiples of ten minutes, cells are pixels. As streams (append
    mode) a row comes when everything up to its due time has been seen but for late_minutes, and flashes later than that are dropped;
    as static tables every pair comes, the immature ones too (filter on due). Repeated forecasts are one;
    forecasts with a null go; a forecast without flashes has y = 0.
    """
    told = forecasts.select("issued", "i", "j", F.explode(F.array(*map(F.lit, leads))).alias("lead")).dropna()
    both = told.withColumn("y", F.lit(0)).withColumn("told", F.lit(1)).unionByName(outcomes(flashes, leads, radius_km).withColumn("y", F.lit(1)).withColumn("told", F.lit(0)))
    due = F.timestamp_micros(F.unix_micros("issued") + F.col("lead") * 60_000_000)
    # due lies up to the longest lead ahead of what has been seen, hence the delay
    keyed = both.withColumn("due", due).withWatermark("due", f"{late_minutes + max(leads)} minutes")
    out = keyed.groupBy("due", "issued", "i", "j", "lead").agg(F.max("y").alias("y"), F.max("told").alias("told"))
    return out.where("told = 1").select("issued", "i", "j", "lead", "due", "y")

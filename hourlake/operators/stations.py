"""Nearest-station selection as a grid join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourlake.functions import geo, measure
from hourlake.operators.ranking import keep_first

MAX_DISTANCE_KM = 200.0
RADIUS_KM = 250.0
MIN_COVERAGE = 0.6
KM_PER_DEGREE = 110.0  # a little under the true 111.2, so cells never come out too small


def _lon_reach(lat: Column, km: float) -> Column:
    """Degrees of longitude within which a point km away can lie, at the far edge of the latitude band."""
    edge = F.least(F.lit(89.0), F.abs(lat) + F.lit(km / KM_PER_DEGREE))
    return F.least(F.lit(180.0), F.lit(km / KM_PER_DEGREE) / F.cos(F.radians(edge)))


def nearby(locations: DataFrame, stations: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """All stations within the radius of each place.

    Places are put into every one-degree-band cell their circle touches and meet
    the stations of those cells by an equi-join; equal coordinates are searched once.
    """
    cell = F.lit(radius_km / KM_PER_DEGREE)
    spots = locations.select("latitude", "longitude").distinct()
    reach = _lon_reach(F.col("latitude"), radius_km)
    row = lambda x: F.floor(x / cell)
    spots = spots.select(
        "*",
        F.explode(F.sequence(row(F.col("latitude") - cell), row(F.col("latitude") + cell))).alias("_r"),
        reach.alias("_reach"),
    ).select(
        "latitude", "longitude", "_r",
        F.explode(F.sequence(row(F.col("longitude") - F.col("_reach")), row(F.col("longitude") + F.col("_reach")))).alias("_c0"),
    )
    # wrap the date line
    columns = F.lit(360.0) / cell
    spots = spots.withColumn("_c", F.pmod(F.col("_c0"), F.ceil(columns))).drop("_c0").distinct()
    s = stations.select(
        *[F.col(c).alias(f"_s_{c}") if c in ("latitude", "longitude") else F.col(c) for c in stations.columns]
    )
    s = s.withColumn("_r", row(F.col("_s_latitude")))
    s = s.withColumn("_c", F.pmod(row(F.col("_s_longitude")), F.ceil(columns)))
    d = F.round(geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_s_latitude"), F.col("_s_longitude")), 6)
    pairs = spots.join(s, ["_r", "_c"]).withColumn("distance_km", d).where(F.col("distance_km") <= radius_km)
    # one cell column can be reached both ways round the globe; ranks stay per station
    pairs = pairs.dropDuplicates(["latitude", "longitude", "station_id"])
    keep = ["location_id", *[c for c in stations.columns if c not in ("latitude", "longitude")], "distance_km"]
    return locations.select("location_id", "latitude", "longitude").join(pairs, ["latitude", "longitude"]).select(keep)


def inventory_covers(year: Column) -> Column:
    return (F.coalesce("start_year", year) <= year) & (F.coalesce("end_year", year) >= year)


def reject_reason(year: Column, max_distance: float = MAX_DISTANCE_KM, min_coverage: float = MIN_COVERAGE) -> Column:
    """First failing check of a candidate; `accepted` when none fails."""
    return (
        F.when(~inventory_covers(year), "station_inventory_mismatch")
        .when(F.coalesce("distance_km", F.lit(999999.0)) > max_distance, "station_too_far")
        .when(F.coalesce("row_count", F.lit(0)) == 0, "station_no_rows")
        .when(F.col("coverage_ratio") < min_coverage, "station_low_coverage")
        .otherwise("accepted")
    )


def candidates(locations, stations, station_obs, year: int, expected: int, max_distance=MAX_DISTANCE_KM,
               min_coverage=MIN_COVERAGE, radius_km=RADIUS_KM, max_accepted: int | None = None) -> DataFrame:
    """Nearby stations with coverage and reason. `station_obs`: station_id, row_count, metric_count.

    Every station within the radius is checked. `max_accepted`, where a caller sets it, keeps
    only the nearest accepted ones of a place; rejected ones stay for the report.
    """
    c = nearby(locations, stations, radius_km).join(station_obs, "station_id", "left")
    ratio = measure.coverage_ratio(F.col("row_count"), F.lit(expected))
    checked = (
        c.withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn("coverage_ratio", ratio)
        .withColumn("reason", reject_reason(F.lit(year), max_distance, min_coverage))
    )
    if max_accepted is None:
        return checked
    accepted = F.col("reason") == "accepted"
    near = keep_first(checked.where(accepted), ["location_id"], [F.col("distance_km").asc(), F.col("station_id").asc()], max_accepted)
    return checked.where(~accepted).unionByName(near.select(checked.columns))


def select_station(locations, cands: DataFrame, point_obs: DataFrame, expected: int, min_coverage=MIN_COVERAGE):
    """Per place: full point data, else the nearest accepted station, else partial point data, else none.

    `point_obs`: location_id, point_rows.
    """
    best = keep_first(
        cands.where(F.col("reason") == "accepted"), ["location_id"],
        [F.col("distance_km").asc(), F.col("row_count").desc(), F.col("metric_count").desc(), F.col("station_id").asc()],
    ).select("location_id", "station_id", "distance_km", "row_count", "coverage_ratio")
    j = locations.select("location_id").join(point_obs, "location_id", "left").join(best, "location_id", "left")
    n = F.coalesce("point_rows", F.lit(0))
    pr = measure.coverage_ratio(n, F.lit(expected))
    method = (
        F.when((n > 0) & (pr >= min_coverage), "point")
        .when(F.col("station_id").isNotNull(), "station")
        .when(n > 0, "partial_point")
    )
    st = F.col("fetch_method") == "station"
    return j.withColumn("fetch_method", method).select(
        "location_id",
        "fetch_method",
        F.when(st, F.col("station_id")).alias("station_id"),
        F.when(st, F.col("distance_km")).alias("distance_km"),
        F.when(st, F.col("row_count")).when(F.col("fetch_method").isNotNull(), n).otherwise(F.lit(0)).alias("row_count"),
        F.when(st, F.col("coverage_ratio")).otherwise(pr).alias("coverage_ratio"),
        F.when(st, geo.distance_bucket(F.col("distance_km"))).otherwise(F.lit("point")).alias("data_quality"),
    )


def flag_primary(cands: DataFrame, chosen: DataFrame) -> DataFrame:
    c = chosen.select("location_id", F.col("station_id").alias("_chosen"))
    return cands.join(c, "location_id", "left").withColumn(
        "is_primary", F.coalesce(F.col("station_id") == F.col("_chosen"), F.lit(False))
    ).drop("_chosen")


def collection_report(summary: DataFrame, warnings: DataFrame, k: int = 10) -> DataFrame:
    """Long report: totals, top failing places, top far stations."""
    ok = F.col("status").isin("success", "partial") & (F.coalesce("row_count", F.lit(0)) > 0)
    fields = lambda section, item, v: [
        F.lit(section).alias("section"), item.cast("string").alias("item"), v.cast("double").alias("amount")
    ]
    totals = summary.agg(
        F.count_distinct(F.when(ok, F.struct("location_id", "year"))).alias("s"),
        F.count_if(~ok).alias("f"),
        F.count_distinct(F.when(~ok, F.col("location_id"))).alias("l"),
    )
    out = [totals.select(*fields("total", F.lit(n), F.col(c))) for n, c in
           (("successful_pairs", "s"), ("missing_pairs", "f"), ("missing_locations", "l"))]
    fail = top_failing(summary.where(~ok), ["location_id"], k)
    out.append(fail.select(*fields("top_missing", F.col("location_id"), F.col("failures"))))
    far = warnings.where(F.col("reason") == "station_too_far").orderBy("location_id", "year", "distance_km", "station_id").limit(k)
    out.append(far.select(*fields("top_too_far", F.concat_ws("/", "location_id", "year", "station_id"), F.round("distance_km", 1))))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def top_failing(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.col("failures").desc(), *keys).limit(k)

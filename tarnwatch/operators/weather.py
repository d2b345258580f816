"""Antecedent weather: (station, day, precip, tmean, tmin, tmax, station_elev), one row for each day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import thousandths

LAPSE_C_PER_KM = 6.5


def _epoch(day="day"):
    return F.unix_date(day)


def _trailing(days: int):
    return Window.partitionBy("station").orderBy(_epoch()).rangeBetween(-(days - 1), 0)


def antecedent_rain_rows(weather: DataFrame, *others: str) -> DataFrame:
    """TS-01: rain of the day and of the seven rows that end with it, whatever days are missing; ``others`` are kept."""
    rows = Window.partitionBy("station").orderBy("day").rowsBetween(-6, 0)
    rain = F.coalesce("precip", F.lit(0.0))
    return weather.select("station", "day", rain.alias("rain_24h"), F.sum(rain).over(rows).alias("rain_7d"), *others)


def antecedent_rain_days(weather: DataFrame) -> DataFrame:
    """TS-02: the same over seven calendar days, with the days missing; a missing day's own rain stays null."""
    missing = (7 - F.count("precip").over(_trailing(7))).cast("int")
    return weather.select("station", "day", F.col("precip").alias("rain_24h"), F.coalesce(F.sum("precip").over(_trailing(7)), F.lit(0.0)).alias("rain_7d"), missing.alias("missing"), (missing == 0).alias("complete"))


def thermal_state(weather: DataFrame, lake_elevation_m: float) -> DataFrame:
    """TS-04: state of the lake's surface from the mean of seven days, corrected for altitude."""
    coverage = F.count("tmean").over(_trailing(7)) / 7
    lake = F.avg("tmean").over(_trailing(7)) - LAPSE_C_PER_KM * (F.lit(float(lake_elevation_m)) - F.col("station_elev")) / 1000
    out = weather.select("station", "day", coverage.alias("coverage"), lake.alias("lake_temp"))
    state = F.when((F.col("coverage") < 0.5) | F.col("lake_temp").isNull(), "unknown").when(F.col("lake_temp") < -1.5, "frozen_surface").when(F.col("lake_temp") <= 0.5, "freeze_transition")
    return out.withColumn("state", state.otherwise("liquid"))


def observation_weather(observations: DataFrame, weather: DataFrame, default_temp: float = 12.0) -> DataFrame:
    """TS-03: observations with the weather of their day; no rain and a default temperature where there is none."""
    rain = antecedent_rain_rows(weather.select("station", "day", "precip", "tmean"), "tmean").withColumnRenamed("day", "_day")
    found = observations.join(rain, (observations["station"] == rain["station"]) & (F.col("acquired_at") == F.col("_day")), "left").drop(rain["station"], "_day")
    return found.withColumns({"rain_24h": F.coalesce("rain_24h", F.lit(0.0)), "rain_7d": F.coalesce("rain_7d", F.lit(0.0)), "temp": F.coalesce("tmean", F.lit(float(default_temp)))}).drop("tmean")


def _window_days(events: DataFrame, weather: DataFrame, days: int) -> DataFrame:
    """Events with each day of the window that ends with them, _ago days before.

    The join is an equality on the station and the week, with each event in the
    weeks its window touches, so that no event meets all days of a station.
    """
    week = lambda d: F.floor(F.unix_date(d) / 7)
    e = events.withColumn("_week", F.explode(F.sequence(week(F.date_sub("event_date", days - 1)), week("event_date"))))
    w = weather.withColumn("_week", week("day"))
    ago = F.datediff("event_date", "day")
    return e.join(w, ["station", "_week"]).where((ago >= 0) & (ago < days)).withColumn("_ago", ago)


def event_windows(events: DataFrame, weather: DataFrame, *, days: int = 30, most_nulls: int = 4) -> DataFrame:
    """TS-05 to TS-08: features of the days that end with each event; windows with too many nulls are dropped.

    Temperatures are corrected for altitude.
    """
    joined = _window_days(events, weather, days)
    rain = F.coalesce("precip", F.lit(0.0))
    lapse = LAPSE_C_PER_KM * (F.col("elev_m") - F.col("station_elev")) / 1000
    cycle = (F.col("tmin") - lapse < 0) & (F.col("tmax") - lapse > 0) & (F.col("_ago") < 14)
    features = joined.groupBy("event_id").agg(
        F.sum(rain).alias("rain_30d"),
        F.sum(F.when(F.col("_ago") < 7, rain).otherwise(0.0)).alias("rain_7d"),
        F.max(rain).alias("rain_max"),
        F.count_if(rain > 25).alias("wet_days"),
        F.sum(rain * F.pow(F.lit(0.9), F.col("_ago"))).alias("decay_index"),
        F.sum(F.greatest(F.lit(0.0), F.col("tmean") - lapse)).alias("melt_degree_days"),
        F.count_if(cycle).alias("freeze_thaw"),
        (2 * days - F.count("precip") - F.count("tmean")).alias("_nulls"),
        F.max("elev_m").alias("elev_m"),
    )
    return features.where(F.col("_nulls") <= most_nulls).drop("_nulls")


def climatology_anomaly(events: DataFrame, weather: DataFrame, *, days: int = 30, years: int = 10) -> DataFrame:
    """TS-09: a window's rain less the mean of the same window in earlier years, complete windows only."""
    ends = events.select("event_id", "station", F.explode(F.sequence(F.lit(0), F.lit(years))).alias("back"), "event_date")
    ends = ends.withColumn("end", F.date_sub("event_date", F.col("back") * 365))
    sums = weather.select("station", F.col("day").alias("end"), F.sum("precip").over(_trailing(days)).alias("rain"), F.count("precip").over(_trailing(days)).alias("n"))
    full = ends.join(sums.where(F.col("n") == days), ["station", "end"])
    out = full.groupBy("event_id").agg(F.max(F.when(F.col("back") == 0, F.col("rain"))).alias("rain"), F.avg(F.when(F.col("back") > 0, F.col("rain"))).alias("normal"))
    return events.select("event_id").join(out, "event_id", "left").select("event_id", (F.col("rain") - F.col("normal")).alias("anomaly"))


def event_features(events: DataFrame, weather: DataFrame, static: DataFrame, *, days: int = 30, most_nulls: int = 4, years: int = 10) -> DataFrame:
    """TS-10: window features, anomaly and static attributes (event_id, ...) of every event whose window is complete enough."""
    full = event_windows(events, weather, days=days, most_nulls=most_nulls).join(climatology_anomaly(events, weather, days=days, years=years), "event_id")
    return full.join(static, "event_id", "left")


def latest_window_fallback(observations: DataFrame, weather: DataFrame, *, days: int = 30, most_nulls: int = 4) -> DataFrame:
    """TS-11: features of the window that ends with each observation (event_id, station, event_date, elev_m, rain_24h, rain_7d).

    Where the window is complete enough they are those of ``event_windows``.
    Else the observation's own rain counts, and melt is the sum over the days
    that have a temperature, corrected for altitude, if these are half of the
    window; what has no source is null. ``basis`` is full, partial or none.
    """
    full = event_windows(observations, weather, days=days, most_nulls=most_nulls).select("event_id", "rain_30d", F.col("rain_7d").alias("_week_rain"), "rain_max", F.col("melt_degree_days").alias("_melt"))
    lapse = LAPSE_C_PER_KM * (F.col("elev_m") - F.coalesce("station_elev", "elev_m")) / 1000
    warm = F.sum(F.greatest(F.lit(0.0), F.col("tmean") - lapse))
    part = _window_days(observations, weather, days).groupBy("event_id").agg(F.when(F.count("tmean") >= days // 2, F.round(warm, 2)).alias("_part"))
    joined = observations.join(full, "event_id", "left").join(part, "event_id", "left")
    has = F.col("rain_30d").isNotNull()
    return joined.select(
        "event_id",
        "rain_30d",
        F.when(has, F.col("_week_rain")).otherwise(F.col("rain_7d")).alias("rain_7d"),
        F.when(has, F.col("rain_max")).otherwise(F.col("rain_24h")).alias("rain_max"),
        F.when(has, F.col("_melt")).otherwise(F.col("_part")).alias("melt"),
        F.when(has, "full").when(F.col("_part").isNotNull(), "partial").otherwise("none").alias("basis"),
    )


def trend_class(areas: DataFrame) -> DataFrame:
    """TS-12: (basin_id, acquired_at, area, observation_id) -> class of growth of each basin, and how sure it is.

    Growth is that over the first area above 0, or over 1 where there is none.
    """
    order = Window.partitionBy("basin_id").orderBy("acquired_at", "observation_id")
    steps = areas.withColumn("_drops", F.coalesce(F.col("area") < 0.95 * F.lag("area").over(order), F.lit(False)))
    at = F.struct("acquired_at", "observation_id")
    by = steps.groupBy("basin_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.min_by(F.when(F.col("area") > 0, F.col("area")), F.when(F.col("area") > 0, at)), F.lit(1.0)).alias("first"),
        F.max_by("area", at).alias("last"),
        F.bool_or("_drops").alias("_drops"),
    )
    percent = (F.col("last") - F.col("first")) / F.col("first") * 100
    kind = F.when((F.col("n") < 2) | percent.isNull() | F.col("_drops"), "uncertain").when(percent >= 20, "rapidly").when(percent >= 5, "slowly").otherwise("stable")
    sure = F.when(F.col("trend") == "rapidly", thousandths(F.least(F.lit(0.9), 0.5 + F.col("percent") / 100))).when(F.col("trend") == "slowly", 0.5).when(F.col("trend") == "stable", 0.9).otherwise(0.3)
    return by.select("basin_id", "n", percent.alias("percent"), kind.alias("trend")).withColumn("confidence", sure)


def month_share(events: DataFrame, months=(6, 7, 8, 9)) -> DataFrame:
    """TS-13: events of each month, and the share of all that fall in the season."""
    by = events.groupBy(F.month("event_date").alias("month")).agg(F.count("*").alias("events"))
    whole = by.agg(F.sum("events").alias("all"), F.sum(F.when(F.col("month").isin(*months), F.col("events")).otherwise(0)).alias("season"))
    return by.join(F.broadcast(whole), F.lit(True)).select("month", "events", (F.col("season") / F.col("all")).alias("season_share"))

"""Provider payloads: JSON bodies to typed rows. Malformed bodies give no rows; what can't be a session is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The provider's sport names.
SPORTS = {
    "running": "run",
    "run": "run",
    "trail_running": "run",
    "treadmill_running": "run",
    "indoor_running": "run",
    "track_running": "run",
    "street_running": "run",
    "virtual_run": "run",
    "ultra_run": "run",
    "walking": "run",
    "hiking": "run",
    "cycling": "bike",
    "bike": "bike",
    "road_biking": "bike",
    "mountain_biking": "bike",
    "gravel_cycling": "bike",
    "indoor_cycling": "bike",
    "virtual_ride": "bike",
    "cyclocross": "bike",
    "track_cycling": "bike",
    "bmx": "bike",
    "e_bike_fitness": "bike",
    "swimming": "swim",
    "swim": "swim",
    "lap_swimming": "swim",
    "open_water_swimming": "swim",
    "open_water": "swim",
    "strength_training": "strength",
    "strength": "strength",
    "weight_training": "strength",
    "indoor_cardio": "strength",
    "hiit": "strength",
    "pilates": "strength",
    "yoga": "strength",
    "crossfit": "strength",
    "multi_sport": "multisport",
    "multisport": "multisport",
    "triathlon": "multisport",
    "duathlon": "multisport",
    "swimrun": "multisport",
}
# Keys of a webhook's body and the kind of subject that each holds.
SUBJECT_KINDS = {
    "activities": "activity",
    "activityDetails": "activity",
    "manuallyUpdatedActivities": "activity",
    "dailies": "dailies",
    "sleeps": "sleep",
    "hrv": "hrv",
    "hrvSummaries": "hrv",
    "stressDetails": "dailies",
    "bodyComps": "body_composition",
    "userMetrics": "body_composition",
    "respiration": "dailies",
    "pulseOx": "dailies",
    "deregistrations": "deregistration",
    "userPermissionsChange": "deregistration",
}
# 2000-01-01 in seconds; limits of a history import.
LEAST_EPOCH, MOST_HISTORY_DAYS, CHUNK_DAYS = 946684800, 730, 90

LAP = "struct<durationInSeconds:double,distanceInMeters:double,averageHeartRateInBeatsPerMinute:double,averagePowerInWatts:double>"
ACTIVITY = f"""struct<summaryId:string,activityId:string,userId:string,activityType:string,startTimeInSeconds:double,startTimeOffsetInSeconds:double,durationInSeconds:double,
movingDurationInSeconds:double,distanceInMeters:double,averageSpeedInMetersPerSecond:double,averageHeartRateInBeatsPerMinute:double,maxHeartRateInBeatsPerMinute:double,
averagePowerInWatts:double,normalizedPowerInWatts:double,totalElevationGainInMeters:double,manual:boolean,deviceName:string,laps:array<{LAP}>>"""
WELLNESS = """struct<userId:string,calendarDate:string,lastNightAvg:double,hrvRmssd:double,restingHeartRateInBeatsPerMinute:double,sleepTimeInSeconds:double,sleepScore:double,
overallSleepScore:struct<value:double>,weightInGrams:double,steps:double>"""


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def map_sport(name: Column) -> Column:
    return F.coalesce(lookup(SPORTS, F.lower(F.trim(name))), F.lit("other"))


def positive(x: Column, upper: float | None = None) -> Column:
    """Null for what isn't a finite positive number within the range: a sensor's way of saying nothing."""
    ok = (x > 0) & ~F.isnan(x) & (x < F.lit(float("inf")))
    return F.when(ok & (x <= upper) if upper is not None else ok, x)


def objects(body: Column, kind: str) -> Column:
    """The objects of a body that is one or a list of them."""
    some = F.when(F.ltrim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return F.filter(F.coalesce(F.from_json(some, f"array<{kind}>"), F.array().cast(f"array<{kind}>")), lambda x: x.isNotNull())


def local_date(start: Column, offset_s: Column) -> Column:
    """The athlete's calendar day; without an offset, the one in UTC."""
    return F.to_date(start + F.make_dt_interval(secs=F.coalesce(offset_s, F.lit(0)).cast("decimal(18,6)")))


def normalise_activities(payloads: DataFrame, body: str = "body") -> DataFrame:
    """A row for each body whose first object is a session: it has an id, a user, a start from 2000 on and a duration."""
    o = F.get(objects(F.col(body), ACTIVITY), F.lit(0))
    rows = payloads.withColumn("o", o).filter("o IS NOT NULL")
    x = lambda name, upper=None: positive(F.col(f"o.{name}"), upper)
    start = F.timestamp_seconds(F.col("o.startTimeInSeconds"))
    rows = rows.withColumns(
        {
            "provider_activity_id": F.coalesce("o.summaryId", "o.activityId"),
            "provider_user_id": F.nullif(F.col("o.userId"), F.lit("")),
            "sport": map_sport(F.col("o.activityType")),
            "start_time": start,
            "local_date": local_date(start, F.col("o.startTimeOffsetInSeconds")),
            "duration_s": x("durationInSeconds"),
            "moving_duration_s": x("movingDurationInSeconds"),
            "distance_m": x("distanceInMeters"),
            "avg_speed_m_s": F.coalesce(x("averageSpeedInMetersPerSecond"), x("distanceInMeters") / x("durationInSeconds")),
            "avg_hr": x("averageHeartRateInBeatsPerMinute", 260),
            "max_hr": x("maxHeartRateInBeatsPerMinute", 260),
            "avg_power_w": x("averagePowerInWatts", 3000),
            "normalised_power_w": x("normalizedPowerInWatts", 3000),
            "elevation_gain_m": x("totalElevationGainInMeters"),
            "is_manual": F.coalesce("o.manual", F.lit(False)),
            "laps": laps(F.col("o.laps")),
        }
    )
    whole = F.col("provider_activity_id").isNotNull() & F.col("provider_user_id").isNotNull() & F.col("duration_s").isNotNull() & (F.col("o.startTimeInSeconds") >= LEAST_EPOCH)
    return rows.filter(whole).drop("o")


def laps(raw: Column) -> Column:
    """The laps with a duration; their numbers are those of the payload."""
    each = F.transform(raw, lambda x, i: F.struct((i + 1).alias("lap_index"), positive(x.durationInSeconds).alias("duration_s"), positive(x.distanceInMeters).alias("distance_m"), positive(x.averageHeartRateInBeatsPerMinute, 260).alias("avg_hr"), positive(x.averagePowerInWatts, 3000).alias("avg_power_w")))
    return F.filter(each, lambda x: x.duration_s.isNotNull())


def normalise_wellness(payloads: DataFrame, body: str = "body") -> DataFrame:
    """A row for each object with a user and a valid date: part of a day."""
    rows = payloads.withColumn("o", F.explode(objects(F.col(body), WELLNESS)))
    x = lambda name, upper=None: positive(F.col(f"o.{name}"), upper)
    rows = rows.withColumns(
        {
            "provider_user_id": F.nullif(F.col("o.userId"), F.lit("")),
            "local_date": F.try_to_date(F.col("o.calendarDate"), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.col("o.calendarDate").try_cast("date"),
            "hrv_rmssd_ms": positive(F.coalesce(F.nullif(F.col("o.lastNightAvg"), F.lit(0.0)), F.col("o.hrvRmssd")), 400),
            "resting_hr": x("restingHeartRateInBeatsPerMinute", 200),
            "sleep_duration_s": x("sleepTimeInSeconds"),
            "sleep_score": positive(F.coalesce("o.overallSleepScore.value", "o.sleepScore"), 100),
            "weight_kg": x("weightInGrams") / 1000,
            "steps": F.col("o.steps").cast("int"),
        }
    )
    return rows.filter("provider_user_id IS NOT NULL AND local_date IS NOT NULL").drop("o")


def merge_days(parts: DataFrame, measures: list[str], order: str) -> DataFrame:
    """One row for each user and day: of each measure, the latest value that there is."""
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return parts.groupBy("provider_user_id", "local_date").agg(*(latest(c) for c in measures))


def subjects(events: DataFrame, body: str = "body") -> DataFrame:
    """(user, kind, ref, occurred) for each object below a known key of a webhook's body."""
    item = "struct<userId:string,summaryId:string,activityId:string,calendarDate:string,startTimeInSeconds:double>"
    rows = events.select("*", F.explode(F.from_json(F.col(body), f"map<string,array<{item}>>")).alias("key", "items"))
    rows = rows.withColumn("kind", lookup(SUBJECT_KINDS, F.col("key"))).filter("kind IS NOT NULL").withColumn("o", F.explode("items"))
    rows = rows.withColumns({"provider_user_id": F.nullif(F.col("o.userId"), F.lit("")), "provider_ref": F.coalesce("o.summaryId", "o.activityId", "o.calendarDate"), "occurred_at": F.timestamp_seconds("o.startTimeInSeconds")})
    return rows.filter("provider_user_id IS NOT NULL").drop("key", "items", "o")


def plan_fetches(found: DataFrame) -> DataFrame:
    """What to fetch for each subject: two tasks for an activity with a reference, a day's window for wellness, else nothing."""
    task = lambda kind, ref, day: F.struct(kind.alias("task"), ref.alias("ref"), day.alias("window_start"))
    none, day = F.lit(None).cast("string"), F.to_date("occurred_at")
    two = F.array(*(task(F.lit(k), F.col("provider_ref"), F.lit(None).cast("date")) for k in ("activity_summary", "activity_details")))
    tasks = F.when((F.col("kind") == "activity") & F.col("provider_ref").isNotNull(), two).when(F.col("kind").isin("dailies", "sleep", "hrv"), F.array(task(F.col("kind"), none, day)))
    rows = found.withColumn("t", F.explode(tasks)).select("*", "t.*").drop("t")
    return rows.withColumn("dedupe_key", F.concat_ws(":", "task", "provider_user_id", F.coalesce("ref", F.lit("-")), F.coalesce(F.col("window_start").cast("string"), F.lit("-"))))


def backfill_chunks(imports: DataFrame, kinds: tuple[str, ...] = ("activity_summary", "dailies", "sleep")) -> DataFrame:
    """Windows of a history import (since, until), at most so long back and so many days each, for each kind."""
    since = F.greatest(F.col("since"), F.date_sub("until", MOST_HISTORY_DAYS))
    starts = F.when(since < F.col("until"), F.sequence(since, F.date_sub("until", 1), F.expr(f"INTERVAL {CHUNK_DAYS} DAYS")))
    rows = imports.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.least(F.date_add("window_start", CHUNK_DAYS), F.col("until")))
    return rows.withColumn("task", F.explode(F.array(*(F.lit(k) for k in kinds))))


def backfill_days(imports: DataFrame, task: str = "activity_summary") -> DataFrame:
    """One window for each day of an import, since included and until not; none where until isn't after since."""
    days = F.when(F.col("since") < F.col("until"), F.sequence(F.col("since"), F.date_sub("until", 1)))
    rows = imports.withColumn("window_start", F.explode(days)).withColumn("window_end", F.date_add("window_start", 1))
    return rows.withColumns({"task": F.lit(task), "priority": F.lit("backfill")})


def pace_to_speed(pace_s_per_km: Column) -> Column:
    """Seconds for a kilometre as metres a second; null for what isn't positive."""
    return F.when(pace_s_per_km > 0, 1000 / pace_s_per_km)


def speed_to_pace(speed_m_s: Column) -> Column:
    return F.when(speed_m_s > 0, 1000 / speed_m_s)


def event_key(event_id: Column, body: Column, provider: str = "provider") -> Column:
    """The provider's id of the event, else a digest of its body, so that a retry has the same key."""
    return F.concat(F.lit(f"{provider}:"), F.coalesce(event_id, F.concat(F.lit("sha256:"), F.sha2(body, 256))))


def stream_blob(body: Column) -> Column:
    """(channels, samples, checksum) of a body's samples: the sorted union of their keys, and the SHA-256 digest of the
    samples as canonical JSON: keys in order, no blanks, numbers in their shortest form; null without samples. Numbers are
    taken as integers or doubles; a digest of numbers beyond 1e7 or below 1e-3 that aren't integers may differ from other
    writers' forms."""
    raw = F.get_json_object(body, "$.samples")
    samples = F.from_json(raw, "array<map<string,string>>")
    channels = F.array_sort(F.array_distinct(F.flatten(F.transform(samples, F.map_keys))))
    number = lambda x: F.when(x.rlike("^-?[0-9]+$") | x.isin("true", "false"), x).when(x.try_cast("double").isNotNull(), x.try_cast("double").cast("string")).otherwise(F.concat(F.lit('"'), x, F.lit('"')))
    value = lambda x: F.when(x.isNull(), "null").otherwise(number(x))
    entry = lambda e: F.concat(F.lit('"'), e.key, F.lit('":'), value(e.value))
    one = lambda m: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), entry), ","), F.lit("}"))
    canonical = F.concat(F.lit("["), F.array_join(F.transform(samples, one), ","), F.lit("]"))
    return F.when(F.size(samples) > 0, F.struct(channels.alias("channels"), F.size(samples).alias("samples"), F.sha2(canonical, 256).alias("checksum"), canonical.alias("content")))

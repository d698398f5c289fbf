"""Vendor payloads to flat event and signal records.

An adapter is a function from a frame with a VARIANT column ``record`` to the nine flat columns.
They are looked up by name in a ``Connectors`` registry, which users extend.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.parsing import id_text, ingest_time, signal_id

FLAT = ("event_name", "screen_tag", "session_id", "user_id", "anonymous_id", "time_text", "app_version", "platform", "properties")
# Reserved Mixpanel properties, known raw keys, and UXCam failures with their kind.
MIXPANEL_RESERVED = ("distinct_id", "time", "token", "mp_lib", "insert_id")
RAW_KEYS = ("event_name", "event", "screen_tag", "screen", "screen_name", "session_id", "user_id", "anonymous_id", "timestamp", "ts", "app_version", "platform", "properties")
UXCAM_FAILURES = {"Rage Tap": "rage_tap", "UI Freeze": "slow_frame", "Slow Frames": "slow_frame", "ANR": "anr"}


def text(path: str, record: Column | None = None) -> Column:
    return F.nullif(F.try_variant_get(F.col("record") if record is None else record, path, "string"), F.lit(""))


def bag(path: str) -> Column:
    """A nested object as a map of variants; an empty map if there is none."""
    return F.coalesce(F.try_variant_get("record", path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def as_json(properties: Column) -> Column:
    """JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))))


def flat(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[columns[c].alias(c) for c in FLAT])


def rudderstack(df: DataFrame) -> DataFrame:
    screen = text("$.type") == "screen"
    return flat(
        df,
        event_name=F.when(screen, "screen_view").otherwise(text("$.event")),
        screen_tag=F.when(screen, text("$.event")).otherwise(text("$.properties.screen_name")),
        session_id=id_text(F.col("record"), "$.context.sessionId"),
        user_id=id_text(F.col("record"), "$.userId"),
        anonymous_id=id_text(F.col("record"), "$.anonymousId"),
        time_text=F.coalesce(text("$.originalTimestamp"), text("$.timestamp")),
        app_version=text("$.context.app.version"),
        platform=text("$.context.os.name"),
        properties=as_json(bag("$.properties")),
    )


def firebase(df: DataFrame) -> DataFrame:
    param = "array<struct<key:string,value:struct<string_value:string,int_value:string,double_value:double,float_value:double>>>"
    params = F.coalesce(F.try_variant_get("record", "$.event_params", param), F.array().cast(param))
    entries = F.transform(params, lambda p: F.struct(p["key"].alias("key"), F.coalesce(p["value"]["string_value"], p["value"]["int_value"], p["value"]["double_value"].cast("string"), p["value"]["float_value"].cast("string")).alias("value")))
    df = df.withColumn("__bag", F.map_from_entries(entries))
    value = F.col("__bag")
    return flat(
        df,
        event_name=text("$.event_name"),
        screen_tag=F.coalesce(value["firebase_screen"], value["screen_name"]),
        session_id=value["ga_session_id"],
        user_id=id_text(F.col("record"), "$.user_id"),
        anonymous_id=id_text(F.col("record"), "$.user_pseudo_id"),
        time_text=text("$.event_timestamp"),
        app_version=text("$.app_info.version"),
        platform=text("$.platform"),
        properties=F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value)))),
    ).drop("__bag")


def mixpanel(df: DataFrame) -> DataFrame:
    own = F.map_filter(bag("$.properties"), lambda k, v: ~F.startswith(k, F.lit("$")) & ~k.isin(*MIXPANEL_RESERVED))
    inside = lambda k: text(f"$.properties['{k}']")
    return flat(
        df,
        event_name=text("$.event"),
        screen_tag=F.coalesce(inside("$screen_name"), inside("screen_name")),
        session_id=id_text(F.col("record"), "$.properties['$session_id']", "$.properties.session_id"),
        user_id=id_text(F.col("record"), "$.properties['$user_id']", "$.properties.distinct_id"),
        anonymous_id=id_text(F.col("record"), "$.properties['$device_id']"),
        time_text=inside("time"),
        app_version=inside("$app_version_string"),
        platform=inside("$os"),
        properties=as_json(own),
    )


def uxcam(df: DataFrame) -> DataFrame:
    url = F.try_variant_get("record", "$.url", "variant")
    properties = F.map_concat(bag("$.eventProperty"), F.when(url.isNotNull(), F.create_map(F.lit("replay_url"), url)).otherwise(F.create_map().cast("map<string,variant>")))
    return flat(
        df,
        event_name=text("$.eventName"),
        screen_tag=text("$.eventScreen"),
        session_id=id_text(F.col("record"), "$.sessionProperty.sessionId"),
        user_id=id_text(F.col("record"), "$.userProperty.kUXCam_UserIdentity"),
        anonymous_id=id_text(F.col("record"), "$.device.deviceId"),
        time_text=text("$.eventDate"),
        app_version=text("$.device.appVersion"),
        platform=text("$.device.platform"),
        properties=as_json(properties),
    )


def raw(df: DataFrame) -> DataFrame:
    """Flat records: unknown top-level keys join the bag, which wins over them."""
    others = F.map_filter(bag("$"), lambda k, v: ~k.isin(*RAW_KEYS))
    nested = bag("$.properties")
    properties = F.map_concat(F.map_filter(others, lambda k, v: ~F.map_contains_key(nested, k)), nested)
    return flat(
        df,
        event_name=F.coalesce(text("$.event_name"), text("$.event")),
        screen_tag=F.coalesce(text("$.screen_tag"), text("$.screen"), text("$.screen_name")),
        session_id=id_text(F.col("record"), "$.session_id"),
        user_id=id_text(F.col("record"), "$.user_id"),
        anonymous_id=id_text(F.col("record"), "$.anonymous_id"),
        time_text=F.coalesce(text("$.timestamp"), text("$.ts")),
        app_version=text("$.app_version"),
        platform=text("$.platform"),
        properties=as_json(properties),
    )


@dataclass(frozen=True)
class Connector:
    adapter: Callable[[DataFrame], DataFrame]
    kind: str = "events"
    auto_capture: bool = False


class Connectors:
    """Adapters by name."""

    def __init__(self):
        self._known: dict[str, Connector] = {}

    def add(self, name: str, connector: Connector, replace: bool = False) -> None:
        if name in self._known and not replace:
            raise ValueError(f"a connector named {name!r} exists; pass replace=True to replace it")
        self._known[name] = connector

    def get(self, name: str) -> Connector:
        if name not in self._known:
            raise ValueError(f"unknown source {name!r}; known are {', '.join(sorted(self._known))}")
        return self._known[name]


CONNECTORS = Connectors()
for _name, _adapter, _auto in (("rudderstack", rudderstack, False), ("firebase", firebase, False), ("mixpanel", mixpanel, False), ("uxcam", uxcam, True), ("raw", raw, False)):
    CONNECTORS.add(_name, Connector(_adapter, auto_capture=_auto))


def read_events(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """JSON lines, or files that hold one JSON array each, as ``record`` with file and read order."""
    if array:
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"))
        return whole.select("file", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("read_order", "record"))
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    return lines.select(F.parse_json("value").alias("record"), "file", F.monotonically_increasing_id().alias("read_order"))


def unwrap(envelopes: DataFrame) -> DataFrame:
    """UXCam envelopes {success, data: [...]} in ``record``; a failed one raises (S3)."""
    good = F.coalesce(F.try_variant_get("record", "$.success", "boolean"), F.lit(True))
    checked = F.when(good, F.coalesce(F.try_variant_get("record", "$.data", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.raise_error(F.lit("the export reports success=false")).cast("array<variant>"))
    return envelopes.select(F.explode(checked).alias("record"))


def _signals(df: DataFrame, kind: Column, fatal: Column, title: Column, session: Column, user: Column, time_text: Column, properties: Column, source: str) -> DataFrame:
    at = ingest_time(time_text)
    rows = df.select(kind.alias("kind"), session.alias("session_id"), user.alias("user_id"), at.alias("timestamp"), fatal.alias("fatal"), title.alias("title"), properties.alias("properties"), F.lit(source).alias("source"))
    rows = rows.where("kind IS NOT NULL AND timestamp IS NOT NULL")
    return rows.select(signal_id(F.col("session_id"), F.col("kind"), F.col("title"), F.col("timestamp")).alias("signal_id"), "*")


def crashlytics(df: DataFrame) -> DataFrame:
    record = F.col("record")
    device = F.map_filter(bag("$"), lambda k, v: k.isin("app_version", "os_version", "device", "issue_id"))
    return _signals(df, F.when(F.upper(text("$.error_type")) == "ANR", "anr").otherwise("crash"), F.coalesce(F.try_variant_get("record", "$.is_fatal", "boolean"), F.lit(True)), text("$.issue_title"), id_text(record, "$.application.session_id", "$.session_id"), id_text(record, "$.user_id"), text("$.event_timestamp"), as_json(device), "crashlytics")


def sentry(df: DataFrame) -> DataFrame:
    """``tags`` may be an object or a list of {key, value}."""
    record = F.col("record")
    listed = F.map_from_entries(F.coalesce(F.try_variant_get("record", "$.tags", "array<struct<key:string,value:string>>"), F.array().cast("array<struct<key:string,value:string>>")))
    session = F.coalesce(id_text(record, "$.tags.session_id"), listed["session_id"], id_text(record, "$.contexts.app.session_id"))
    return _signals(df, F.lit("error"), F.coalesce(text("$.level") == "fatal", F.lit(False)), F.coalesce(text("$.title"), text("$.message")), session, id_text(record, "$.user.id"), text("$.timestamp"), as_json(bag("$.contexts")), "sentry")


def uxcam_failures(df: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in UXCAM_FAILURES.items() for x in pair])
    record = F.col("record")
    return _signals(df, kinds[text("$.eventName")], F.lit(False), text("$.eventName"), id_text(record, "$.sessionProperty.sessionId"), id_text(record, "$.userProperty.kUXCam_UserIdentity"), text("$.eventDate"), as_json(bag("$.eventProperty")), "uxcam")


for _name, _adapter in (("crashlytics", crashlytics), ("sentry", sentry), ("uxcam_failures", uxcam_failures)):
    CONNECTORS.add(_name, Connector(_adapter, kind="signals"))


def risk_signals(df: DataFrame, source: str) -> DataFrame:
    """Signals of a stream by its source; records without a time are dropped."""
    connector = CONNECTORS.get(source)
    if connector.kind != "signals":
        raise ValueError(f"{source!r} is no source of signals")
    return connector.adapter(df)

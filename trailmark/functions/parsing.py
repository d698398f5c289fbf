"""Scalars of ingest: timestamps, ids, event types, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of navigation events.
NAVIGATION = ("screen_view", "screen_viewed", "page_view", "Screen Viewed")
# Markers of a screen's sensitivity, tried in list order, critical ones first.
SENSITIVITY = {
    "critical": ("login", "signin", "sign_in", "signup", "register", "otp", "password", "passcode", "pin", "payment", "card", "cvv", "credential", "biometric", "wallet", "bank"),
    "high": ("address", "profile", "account", "order", "personal", "email", "phone", "kyc", "identity", "document", "refund", "delete", "export", "contact", "history", "saved", "billing", "invoice"),
    "low": ("search", "notification", "help", "faq", "settings"),
}
# Further markers of critical screens.
CRITICAL_EXTRA = ("checkout", "confirm", "cart", "refund", "delete", "export")
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?([+-][0-9]{2}:?[0-9]{2}|Z)?)?$"


def _iso(text: Column) -> Column:
    return F.when(text.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def ingest_time(text: Column) -> Column:
    """Packed 14 digits (2000 to 2100), else microseconds, milliseconds or seconds by size, else
    ISO 8601 with naive times as UTC; anything else is null."""
    text = F.trim(text)
    number = F.try_to_number(text, F.lit("S9999999999999999999.999999"))
    number = F.coalesce(number.cast("double"), F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"), text.try_cast("double")))
    packed = F.when(text.rlike(r"^(20[0-9]{2}|2100)[0-9]{10}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))
    epoch = F.when(number > 1e14, F.timestamp_micros(number.try_cast("long"))).when(number > 1e11, F.timestamp_micros((number * 1000).try_cast("long"))).otherwise(F.timestamp_micros((number * 1_000_000).try_cast("long")))
    return F.coalesce(packed, F.when(number.isNotNull(), epoch), _iso(text))


def readiness_time(text: Column) -> Column:
    """The audit's rule: above 1e10 milliseconds, else seconds, else ISO 8601."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros((F.when(number > 1e10, number * 1000).otherwise(number * 1_000_000)).try_cast("long"))), _iso(text))


def id_text(record: Column, *paths: str) -> Column:
    """The first id found at the paths of a variant, as text: ``9.0`` is 9, booleans are capitalised."""

    def one(path: str) -> Column:
        value = F.try_variant_get(record, path, "string")
        kind = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
        return F.nullif(F.when(kind == "BOOLEAN", F.initcap(value)).otherwise(F.regexp_replace(value, r"\.0+$", "")), F.lit(""))

    return F.coalesce(*[one(p) for p in paths])


def event_type(name: Column) -> Column:
    return F.when(name.isin(*NAVIGATION), "screen_view").otherwise("interaction")


def event_id(session: Column, name: Column, tag: Column, at: Column, properties: Column) -> Column:
    """Content-addressed id: equal contents have equal ids, whatever file they come from."""
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = [F.coalesce(c, F.lit("")) for c in (session, name, tag, iso, properties)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def signal_id(session: Column, kind: Column, title: Column, at: Column) -> Column:
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (session, kind, title, iso)]), 256), 1, 32)


def number_of(properties: Column, name: str) -> Column:
    """A numeric property of a JSON bag; booleans and texts are none."""
    bag = F.try_parse_json(properties)
    kind = F.schema_of_variant(F.try_variant_get(bag, f"$.{name}", "variant"))
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(bag, f"$.{name}", "double"))


def snake_case(text: Column) -> Column:
    """A capital before a small letter opens a word, other characters divide words; ``unknown`` if nothing is left."""
    spaced = F.regexp_replace(text, r"(?s)(?<=.)(?=[A-Z][a-z])", "_")
    clean = F.lower(F.regexp_replace(F.regexp_replace(spaced, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(clean, F.lit("")), F.when(text.isNotNull(), F.lit("unknown")))


def title_case(text: Column) -> Column:
    return F.initcap(F.regexp_replace(snake_case(text), "_", " "))


def sensitivity(name: Column) -> Column:
    """Struct (level, reason): the first marker of the snake-case name in list order, critical
    before high before low."""
    markers = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(m).alias("reason")) for level, ms in SENSITIVITY.items() for m in ms])
    none = F.struct(F.lit("low").alias("level"), F.lit("no marker").alias("reason"))
    # As a lambda's variable the snake-case name is found once, not again for each marker.
    first = F.transform(F.array(snake_case(name)), lambda low: F.get(F.filter(markers, lambda m: F.contains(low, m["reason"])), F.lit(0)))
    return F.coalesce(F.get(first, F.lit(0)), none)


def critical_screen(name: Column) -> Column:
    return snake_case(name).rlike("|".join((*SENSITIVITY["critical"], *CRITICAL_EXTRA)))


def locator_strategy(value: Column) -> Column:
    """Strategy that a claimed locator shows; an XPath with a predicate [1] to [19] is positional."""
    text = F.trim(value)
    positional = text.rlike(r"\[(?:[1-9]|1[0-9])\]")
    return (
        F.when(text.startswith("~"), "accessibility_id")
        .when(F.contains(text, F.lit(":id/")) | text.startswith("id="), "resource_id")
        .when(text.startswith("//") | text.startswith("("), F.when(positional, "positional_xpath").otherwise("semantic_xpath"))
        .when(text.startswith("**/"), "class_chain")
        .otherwise("accessibility_id")
    )


def suite_strategy(value: Column) -> Column:
    """Strategy of a locator in a test suite, as the suite's summary counts them."""
    text = F.trim(value)
    return (
        F.when(text.startswith("//") | text.startswith("(//"), "xpath")
        .when(text.startswith("~"), "accessibility_id")
        .when(F.contains(text, F.lit(":id/")) | text.startswith("id="), "resource_id")
        .when(text.startswith("-android uiautomator") | text.startswith("-ios"), "platform_query")
        .when(text.startswith("#") | text.startswith("."), "css")
        .otherwise("other")
    )

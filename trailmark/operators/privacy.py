"""Personal data in event properties: detectors, redaction, flattening, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.cutting import new_path

# Detectors ((?U): word characters and digits of all scripts), and property names
# that are flagged whatever they hold.
PATTERNS = {
    "email": r"(?U)[\w.+-]+@[\w-]+\.[\w.-]{2,}",
    "phone": r"(?U)(?<!\d)(?:\+\d{1,3}[\s-]?)?(?:\d[\s-]?){9,14}\d(?!\d)",
    "national_id": r"(?U)(?<!\w)(?:\d{3}-\d{2}-\d{4}|[A-Z]{5}\d{4}[A-Z]|\d{4}\s?\d{4}\s?\d{4})(?!\w)",
    "ip_address": r"(?U)(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "credential": r"(?iU)(?:bearer\s+[\w.-]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S{8,})",
}
CARD = r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
SUSPICIOUS = (
    "email", "email_address", "phone", "phone_number", "mobile", "msisdn", "password", "passwd", "pin", "otp", "cvv", "card", "card_number", "pan", "ssn", "aadhaar", "national_id", "passport",
    "dob", "date_of_birth", "address", "street", "postcode", "zip", "full_name", "first_name", "last_name", "latitude", "longitude", "token", "api_key", "secret",
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def redacted(value: Column) -> Column:
    """What a report shows of a value: its length and eight digits of its hash."""
    return F.concat(F.lit("<redacted len="), F.length(value).cast("string"), F.lit(" sha="), F.left(F.sha2(value, 256), F.lit(8)), F.lit(">"))


def findings(value: Column) -> Column:
    """Array of (kind, redacted) of a text; a card in it hides phones, which look alike."""
    none = F.array().cast("array<string>")

    def hits_of(kind: str, pattern: str) -> Column:
        return F.when(_may_hold(value, kind), F.regexp_extract_all(value, F.lit(pattern), F.lit(0))).otherwise(none)

    cards = F.filter(hits_of("card", CARD), lambda x: luhn(F.regexp_replace(x, "[^0-9]", "")))
    parts = [_tagged(cards, "card")]
    for kind, pattern in PATTERNS.items():
        hits = hits_of(kind, pattern)
        if kind == "phone":
            hits = F.when(F.size(cards) > 0, F.slice(hits, 1, 0)).otherwise(hits)
        parts.append(_tagged(hits, kind))
    return F.concat(*parts)


def _may_hold(value: Column, kind: str) -> Column:
    """Whether a text can hold a kind, by a search that is far cheaper than the detector's; null
    stays out."""
    tests = {
        "email": F.contains(value, F.lit("@")),
        "credential": F.rlike(value, F.lit(r"(?i)bearer|eyJ|[=:]")),
        "ip_address": F.rlike(value, F.lit(r"(?U)\d\.\d")),
        "card": F.rlike(value, F.lit(r"(?U)\d[ -]?\d[ -]?\d[ -]?\d")),
        "phone": F.rlike(value, F.lit(r"(?U)\d[\s-]?\d[\s-]?\d[\s-]?\d")),
        "national_id": F.rlike(value, F.lit(r"(?U)\d\d-\d|\d{4}")),
    }
    return tests[kind]


def _tagged(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), redacted(x).alias("sample")))


def flattened(rows: DataFrame, column: str = "properties", most: int | None = None) -> DataFrame:
    """Each property of a JSON bag, nested ones as ``a.b[0].c``, with key, value text and type.

    Each round is a lateral explode of one level, written to a folder of its own; what is nested in it
    is all that the next round reads, until nothing is. So any depth is scanned, and the result is
    one read of all levels. ``most`` ends after so many levels.
    """
    spark, keep = rows.sparkSession, ", ".join(f"t.`{c}`" for c in rows.columns)
    root, depth = new_path(spark, "properties"), 0
    level = rows.select("*", F.col(column).alias("__rest"), F.lit("").alias("__at"))
    while True:
        exploded = spark.sql(
            f"""SELECT {keep}, e.key AS key, e.value AS __v, schema_of_variant(e.value) AS type,
            CASE WHEN e.key IS NULL THEN concat(__at, '[', e.pos, ']') WHEN __at = '' THEN e.key ELSE concat(__at, '.', e.key) END AS path
            FROM {{level}} t, LATERAL variant_explode(try_parse_json(t.__rest)) e""",
            level=level.where("__rest IS NOT NULL"),
        )
        nested = F.col("type").rlike("^(OBJECT|ARRAY)")
        leaves = exploded.select(*rows.columns, "path", "key", "type", F.when(~nested, F.try_variant_get("__v", "$", "string")).alias("value"), F.when(nested, F.to_json("__v")).alias("__rest"))
        leaves.write.parquet(f"{root}/level={depth}")
        below = spark.read.schema(leaves.schema).parquet(f"{root}/level={depth}").where("__rest IS NOT NULL")
        if depth + 1 == most or below.isEmpty():
            return spark.read.schema(leaves.schema).parquet(*[f"{root}/level={i}" for i in range(depth + 1)]).drop("__rest")
        level, depth = below.select(*rows.columns, "__rest", F.col("path").alias("__at")), depth + 1


def scan_properties(events: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Findings in the properties of events: (app_id, event_id, event_name, path, kind, sample).
    Only texts are scanned; suspicious keys are flagged with any value, null too."""
    leaves = flattened(events.select("app_id", "event_id", "event_name", "properties")).where(~F.col("path").isin(*allowed) if allowed else F.lit(True))
    by_key = F.when(F.lower("key").isin(*SUSPICIOUS), F.array(F.struct(F.lit("suspicious_key").alias("kind"), F.lit("<key>").alias("sample"))))
    in_text = F.when(F.col("type") == "STRING", findings(F.col("value")))
    nothing = F.array().cast("array<struct<kind:string,sample:string>>")
    found = F.concat(F.coalesce(by_key, nothing), F.coalesce(in_text, nothing))
    return leaves.select("app_id", "event_id", "event_name", "path", F.explode(found).alias("f")).select("app_id", "event_id", "event_name", "path", "f.*")


def report(finding_rows: DataFrame) -> DataFrame:
    """Distinct (kind, event, path) with occurrences and the first sample, most frequent first (Q11)."""
    grouped = finding_rows.groupBy("app_id", "kind", "event_name", "path").agg(F.count("*").alias("n"), F.min_by("sample", "event_id").alias("sample"))
    return grouped.withColumn("rank", F.row_number().over(W.partitionBy("app_id").orderBy(F.desc("n"), "event_name", "kind", "path")))

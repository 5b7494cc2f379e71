"""Synthetic datasets of any size, the same for the same seed: schemas and shapes of three common kinds of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.meta import Dataset
from quarry.sources.adopt import adopt

MOST_ROWS = 5_000_000
COUNTRIES = {"US": ["Austin", "Denver", "Boston"], "DE": ["Berlin", "Bremen"], "FR": ["Lyon", "Nantes"], "JP": ["Osaka", "Kobe"], "BR": ["Recife", "Santos"]}
CATEGORIES = {"Home": ["Lamp", "Chair", "Rug"], "Sport": ["Ball", "Racket"], "Books": ["Novel", "Atlas"], "Toys": ["Puzzle", "Kite"]}


def _draw(salt: str, *keys: Column) -> Column:
    """A number in 0..1 that a row's own columns fix, whatever the partitions."""
    return (F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 40)) / float(1 << 40)).cast("double")


def _pick(salt: str, options: list, *keys: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), F.floor(_draw(salt, *keys) * len(options)).cast("int") + 1)


def _normal(salt: str, *keys: Column) -> Column:
    """About normal: the sum of four draws, centred and scaled."""
    return (sum((_draw(f"{salt}{k}", *keys) for k in range(4)), F.lit(-2.0))) * 1.732


def _nested(salt: str, of: Column, choices: dict, *keys: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, options in choices.items():
        out = F.when(of == key, _pick(salt, options, *keys)).otherwise(out)
    return out


def ecommerce(rows: DataFrame) -> DataFrame:
    i = F.col("id")
    base = rows.select(
        i, _pick("country", list(COUNTRIES), i).alias("country"), _pick("category", list(CATEGORIES), i).alias("category"), F.round(F.exp(F.lit(3.2) + 0.8 * _normal("price", i)), 2).alias("unit_price"),
        (F.floor(_draw("qty", i) * _draw("qty2", i) * 8) + 1).cast("bigint").alias("quantity"), F.when(_draw("sale", i) < 0.3, F.round(_draw("cut", i) * 40, 1)).otherwise(0.0).alias("discount_pct"),
    )
    return base.select(
        F.format_string("ORD-%08d", i).alias("order_id"), F.format_string("C%06d", F.floor(F.pow(_draw("who", i), 2.0) * 50_000).cast("bigint")).alias("customer_id"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.floor(_draw("day", i) * 730).cast("int")).cast("timestamp").alias("order_date"), "country", _nested("city", F.col("country"), COUNTRIES, i).alias("city"),
        "category", _nested("product", F.col("category"), CATEGORIES, i).alias("product"), "unit_price", "quantity", "discount_pct",
        F.round(F.col("unit_price") * F.col("quantity") * (1 - F.col("discount_pct") / 100), 2).alias("revenue"), _pick("pay", ["card", "paypal", "invoice", "voucher"], i).alias("payment_method"),
        (_draw("back", i) < 0.07).alias("is_returned"), F.when(_draw("rated", i) >= 0.08, F.least(F.floor(F.sqrt(_draw("stars", i)) * 5) + 1, F.lit(5)).cast("bigint")).alias("rating"), (F.floor(_draw("ship", i) * 9) + 1).cast("bigint").alias("shipping_days"),
    )


def iot_sensors(rows: DataFrame, devices: int = 200) -> DataFrame:
    i = F.col("id")
    base = rows.select(i, F.pmod(i, F.lit(devices)).alias("d"), F.floor(i / devices).cast("bigint").alias("turn"))
    d, turn = F.col("d"), F.col("turn")
    broken = _draw("fault", i) < 0.03
    # a device's battery falls by its own rate each turn, and starts anew when empty: no state between rows
    battery = F.round(100 - F.pmod(turn * (0.01 + 0.05 * _draw("rate", d)) + 60 * _draw("level", d), F.lit(95.0)), 2)
    return base.select(
        F.format_string("R%09d", i).alias("reading_id"), F.format_string("dev-%04d", d).alias("device_id"), F.timestamp_millis(F.lit(1704067200000).cast("bigint") + turn * 60_000 + d * 250).alias("timestamp"),
        _pick("site", ["north", "south", "east", "west"], d).alias("site"), _pick("type", ["climate", "motion", "power"], d).alias("sensor_type"),
        F.round(20 + 6 * F.sin(turn / 240.0) + 1.5 * _normal("temp", i), 2).alias("temperature_c"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 12 * _normal("hum", i))), 1).alias("humidity_pct"), battery.alias("battery_pct"),
        F.round(-70 + 9 * _normal("dbm", i), 0).cast("bigint").alias("signal_dbm"), F.when(broken, "error").when(battery < 12, "low_battery").otherwise("ok").alias("status"),
        F.when(broken, _pick("code", ["E01", "E02", "E07", "E11"], i)).alias("error_code"), F.round(turn / 60.0, 2).alias("uptime_hours"),
    )


def web_events(rows: DataFrame) -> DataFrame:
    i = F.col("id")
    session = F.floor(i / 7).cast("bigint")
    sold = _draw("sold", i) < 0.02
    kind = F.when(sold, "purchase").otherwise(_pick("kind", ["page_view", "page_view", "page_view", "click", "scroll", "search"], i))
    return rows.select(
        F.format_string("E%09d", i).alias("event_id"), F.format_string("S%08d", session).alias("session_id"), F.when(_draw("anonymous", session) >= 0.12, F.format_string("U%06d", F.floor(_draw("user", session) * 40_000).cast("bigint"))).alias("user_id"),
        F.timestamp_millis(F.lit(1717200000000).cast("bigint") + session * 4000 + F.pmod(i, F.lit(7)) * 9000).alias("timestamp"), kind.alias("event_type"), _pick("page", ["/", "/search", "/item", "/cart", "/help", "/account"], i).alias("page_path"),
        _pick("ref", ["direct", "search.example", "social.example", "mail.example"], session).alias("referrer_domain"), _pick("browser", ["Chrome", "Safari", "Firefox", "Edge"], session).alias("browser"),
        _pick("os", ["Windows", "macOS", "Android", "iOS", "Linux"], session).alias("os"), _pick("device", ["desktop", "mobile", "tablet"], session).alias("device_type"), _pick("country", list(COUNTRIES), session).alias("country"),
        F.floor(F.exp(F.lit(6.5) + 1.1 * _normal("ms", i))).cast("bigint").alias("duration_ms"), sold.alias("is_conversion"), F.when(sold, F.round(F.exp(F.lit(3.5) + 0.7 * _normal("rev", i)), 2)).alias("revenue"),
    )


PRESETS = {"ecommerce": ecommerce, "iot_sensors": iot_sensors, "web_events": web_events}


def sample(spark: SparkSession, preset: str, rows: int) -> Dataset:
    """A synthetic dataset; rows is cut to 1..5,000,000, and an unknown preset is ecommerce."""
    made = PRESETS.get(preset, ecommerce)(spark.range(min(max(int(rows), 1), MOST_ROWS)))
    return adopt(made, preset if preset in PRESETS else "ecommerce")

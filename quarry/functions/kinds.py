"""Kinds of columns in Spark's types, and values as the text that exports and value lists show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of the kinds.
SPARK_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "date": "timestamp", "string": "string"}


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(data_type, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "date"
    return "string"


def normalised(column: Column, data_type: T.DataType) -> Column:
    """A stored column as its kind's type: NaN is null, nested values are JSON text, local times are UTC."""
    if isinstance(data_type, T.FloatType | T.DoubleType):
        as_double = column.cast("double")
        return F.when(~F.isnan(as_double), as_double)
    if isinstance(data_type, T.ArrayType | T.MapType | T.StructType | T.VariantType):
        return F.to_json(column)
    kind = kind_of(data_type)
    return column if data_type.simpleString() == SPARK_TYPES[kind] else column.cast(SPARK_TYPES[kind])


def number_text(column: Column) -> Column:
    """A number as a script engine prints it: no point for whole numbers, exponents below 1e-6 and from 1e21."""
    v = column.cast("double")
    plain = v.cast("string")
    size = F.abs(v)
    decimal = plain.try_cast("decimal(38,17)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(decimal, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^([^E]*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(plain, r"E(.*)$", 1)
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent.startswith("-"), "").otherwise("+"), exponent)
    return (
        F.when(v.isNull(), None)
        .when(F.isnan(v), "NaN")
        .when(size == float("inf"), F.when(v > 0, "Infinity").otherwise("-Infinity"))
        .when((v == F.floor(v)) & (size < 1e15), v.cast("bigint").cast("string"))
        .when((size >= 1e21) | (size < 1e-6), scientific)
        .when(plain.contains("E"), trimmed)
        .otherwise(F.regexp_replace(plain, r"\.0$", ""))
    )


def date_text(column: Column) -> Column:
    """ISO 8601 in UTC with milliseconds; years outside 0..9999 have a sign and six digits."""
    year = F.year(column)
    rest = F.date_format(column, "-MM-dd'T'HH:mm:ss.SSS'Z'")
    wide = F.concat(F.when(year < 0, "-").otherwise("+"), F.lpad(F.abs(year).cast("string"), 6, "0"))
    return F.concat(F.when((year < 0) | (year > 9999), wide).otherwise(F.lpad(year.cast("string"), 4, "0")), rest)


def value_text(column: Column, kind: str) -> Column:
    if kind == "date":
        return date_text(column)
    if kind == "int":
        return column.cast("string")
    if kind == "float":
        return number_text(column)
    return column.cast("string")


def as_measure(column: Column, kind: str) -> Column:
    """What sums and averages take: numbers, dates as milliseconds, booleans as 0 and 1; nothing of texts."""
    if kind == "date":
        return F.unix_millis(column).cast("double")
    if kind == "bool":
        return column.cast("int").cast("double")
    if kind in ("int", "float"):
        return column.cast("double")
    return F.lit(None).cast("double")

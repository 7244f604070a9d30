"""Canonical text of values, value and type normalisation, natural order: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"
#: What a NULL is written as, and other names of the modes.
NULL_MODES = {"marker": NULL_MARK, "empty": "", "literal": "NULL"}
NULL_ALIASES = {"postgres": "marker", "mysql": "literal", "excel": "empty"}

#: Substrings of a declared type in the order they are tested, and the normal type of each; a leading `=`
#: asks for the whole name.
TYPE_RULES = [
    ("INT", "INTEGER"),
    ("FLOAT", "REAL"),
    ("DOUBLE", "REAL"),
    ("=REAL", "REAL"),
    ("CHAR", "TEXT"),
    ("TEXT", "TEXT"),
    ("STRING", "TEXT"),
    ("CLOB", "TEXT"),
    ("BLOB", "BLOB"),
    ("BINARY", "BLOB"),
    ("BYTEA", "BLOB"),
    ("DECIMAL", "NUMERIC"),
    ("NUMERIC", "NUMERIC"),
    ("BOOL", "INTEGER"),
]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normal_type(declared: str) -> str:
    name = declared.upper()
    return next((to for part, to in TYPE_RULES if (name == part[1:] if part[0] == "=" else part in name)), "TEXT")


def ddl_type(kind: T.DataType) -> str:
    """The declared type for a Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "INTEGER"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "REAL"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return "BLOB" if isinstance(kind, T.BinaryType) else "TEXT"


def spark_type(declared: str) -> T.DataType:
    """The Spark type that holds a declared type's values."""
    name = declared.upper()
    if name.startswith("BOOL"):
        return T.BooleanType()
    if name == "DATE":
        return T.DateType()
    if name.startswith("TIMESTAMP"):
        return T.TimestampNTZType()
    if name.startswith(("DECIMAL", "NUMERIC")) and "(" in name:
        p, _, s = name[name.index("(") + 1 : name.index(")")].partition(",")
        return T.DecimalType(min(int(p), 38), int(s or 0))
    return {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType(), "NUMERIC": T.DoubleType()}.get(normal_type(declared), T.StringType())


def double_text(c: Column) -> Column:
    """The shortest decimal of a double, never with an exponent, and without a fraction if it is whole."""
    short = c.cast("string")  # d.ddd, or d.dddEx for what is very small or large
    # Java's text may have a digit or more than it needs; 15 or 16 digits do if they are the same number.
    few, more = F.format_string("%.14E", c), F.format_string("%.15E", c)
    long = (F.length(F.regexp_replace(short, "E.*|[^0-9]", "")) >= 16) & (more.cast("double") == c)
    source = F.when(long & (few.cast("double") == c), few).when(long, more).otherwise(short)
    scientific = long | short.contains("E")
    exponent = F.when(scientific, F.substring_index(source, "E", -1)).otherwise("0").cast("int")
    digits = F.rtrim(F.translate(F.substring_index(source, "E", 1), "-.", ""), F.lit("0"))
    n = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), exponent - n + 1))
    between = F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    plain = F.when(exponent < 0, small).when(exponent >= n - 1, large).otherwise(between)
    sign = F.when(short.startswith("-"), "-").otherwise("")
    whole = F.when(short.endswith(".0"), F.substr(short, F.lit(1), F.length(short) - 2)).otherwise(short)
    special = F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.when(c.isNull(), None).when(special.isNotNull(), special).when(scientific, F.concat(sign, plain)).otherwise(whole)


def text(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a value; NULL stays NULL."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "1").when(~c, "0")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double_text(c.cast("double"))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def encoded(c: Column, kind: T.DataType, mode: str = "marker") -> Column:
    """The canonical text with NULL as the mode writes it."""
    mode = NULL_ALIASES.get(mode, mode)
    return F.coalesce(text(c, kind), F.lit(NULL_MODES[mode]))


def normal_value(s: Column) -> Column:
    """A text by which equal values of different sources are equal: numbers without a fraction become whole numbers,
    others are rounded to ten places, the rest stays. White space and type suffixes make no number."""
    f = F.try_cast(s, "double") if hasattr(F, "try_cast") else s.try_cast("double")
    rounded = F.rtrim(F.rtrim(F.format_string("%.10f", f), F.lit("0")), F.lit("."))
    low = F.lower(s)
    number = F.when((f == F.rint(f)) & (F.abs(f) < 9223372036854775807.0), f.cast("bigint").cast("string")).otherwise(rounded)
    special = F.when(low.isin("inf", "+inf", "infinity", "+infinity"), "inf").when(low.isin("-inf", "-infinity"), "-inf").when(low.isin("nan", "+nan", "-nan"), "NaN")
    return F.when(s.rlike(NUMBER) & (F.abs(f) < float("inf")), number).otherwise(F.coalesce(special, s))


def normal_number(c: Column, kind: T.DataType) -> Column:
    """What normal_value makes of a number's text, straight from the number."""
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return normal_value(c.cast("string"))
    f = c.cast("double")
    rounded = F.rtrim(F.rtrim(F.format_string("%.10f", f), F.lit("0")), F.lit("."))
    return F.when(F.isnan(f), "NaN").when(f == float("inf"), "inf").when(f == float("-inf"), "-inf").when((f == F.rint(f)) & (F.abs(f) < 9223372036854775807.0), f.cast("bigint").cast("string")).otherwise(rounded)


def natural_key(s: Column) -> Column:
    """Sorts as maximal runs of digits and of other characters do: numbers by value (0 if over 64 bits) and before text,
    and a shorter sequence first."""
    parts = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(x: Column) -> Column:
        digits = x.rlike("^[0-9]")
        stripped = F.ltrim(x, F.lit("0"))
        n = F.when(digits & (F.length(stripped) <= 20), F.coalesce(F.when(stripped == "", "0").otherwise(stripped), F.lit("0"))).cast("decimal(20,0)")
        n = F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n).otherwise(F.lit(0).cast("decimal(20,0)"))
        return F.struct(F.when(digits, 0).otherwise(1).alias("k"), F.when(digits, n).alias("n"), F.when(~digits, x).alias("t"))

    return F.transform(parts, part)

"""Row predicates shared by the checks.  All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named formats.
NAMED_FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_us": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "zipcode_us": r"^\d{5}(-\d{4})?$",
    "ipv4": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "url": r"^https?://[^\s]+$",
}

# Accepted datetime layouts and boolean words.
DATETIME_LAYOUTS = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
)
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")


def blank(column: Column, data_type: str = "string") -> Column:
    """Null, or for strings nothing but whitespace."""
    if data_type != "string":
        return column.isNull()
    return column.isNull() | column.rlike(r"^\s*$")


def any_layout(column: Column, layouts=DATETIME_LAYOUTS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(layout)) for layout in layouts])


def coercible(column: Column, expected: str) -> Column:
    """Whether a string reads as ``expected``; null stays null."""
    if expected == "string":
        return column.isNotNull() | F.lit(None).cast("boolean")
    text = F.trim(column)
    if expected == "integer":
        return text.rlike(r"^[+-]?\d+$")
    if expected == "float":
        return column.try_cast("double").isNotNull() & ~text.rlike(r"(?i)[0-9.][df]$")
    if expected == "boolean":
        return F.lower(column).isin(*BOOLEAN_WORDS)
    if expected == "datetime":
        return any_layout(column).isNotNull()
    raise ValueError(f"unknown type {expected!r}")


# Type name -> Spark type names that satisfy it without coercion.
NATIVE_TYPES = {
    "string": ("string",),
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "float": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"),
    "boolean": ("boolean",),
    "datetime": ("date", "timestamp", "timestamp_ntz"),
}


def type_mismatch(column: Column, actual: str, expected: str, nullable: bool = True) -> Column:
    """Rows whose value is not of, and cannot be read as, the expected type."""
    if actual.split("(")[0] in NATIVE_TYPES[expected]:
        wrong = F.lit(False)
    elif actual == "string":
        wrong = ~coercible(column, expected)
    else:
        wrong = F.lit(True)
    return F.when(column.isNull(), F.lit(not nullable)).otherwise(wrong)


def outside(value: Column, minimum=None, maximum=None,
            inclusive_min: bool = True, inclusive_max: bool = True) -> Column:
    """Value beyond a bound.  Null and NaN are left to other checks."""
    hits = []
    if minimum is not None:
        hits.append(value < minimum if inclusive_min else value <= minimum)
    if maximum is not None:
        hits.append(value > maximum if inclusive_max else value >= maximum)
    beyond = F.lit(False)
    for hit in hits:
        beyond = beyond | hit
    return F.coalesce(value.isNotNull() & beyond, F.lit(False))


def outside_number(value: Column, *bounds, **options) -> Column:
    number = value.try_cast("double")
    return outside(number, *bounds, **options) & ~F.coalesce(F.isnan(number), F.lit(False))


def mismatched(column: Column, pattern: str) -> Column:
    """Non-null text on which the pattern fails, anchored at the start, ignoring case."""
    regex = NAMED_FORMATS.get(pattern, pattern)
    return F.coalesce(~column.cast("string").rlike(f"(?i)^(?:{regex})"), F.lit(False))


def badly_encoded(column: Column, data_type: str) -> Column:
    """Bytes that are not UTF-8, or text in which a decoder already put U+FFFD."""
    if data_type == "binary":
        return F.coalesce(~F.is_valid_utf8(column), F.lit(False))
    return F.coalesce(F.contains(column, F.lit("�")), F.lit(False))


def row_key(*columns: str) -> Column:
    """Key values joined by ``|``; different values give different keys.

    A null is ``\\N``; a backslash or bar inside a value has a backslash before it.
    """
    def part(name: str) -> Column:
        text = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("|", *map(part, columns))


def first_identifier(columns, candidates=("id", "order_id", "customer_id", "_id", "record_id")) -> Column:
    """The first non-null of the usual identifier columns."""
    present = [F.col(c).cast("string") for c in candidates if c in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps, independent of the session time zone."""
    gap = later - earlier
    return (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * 3600
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * 60
        + F.floor(F.extract(F.lit("SECOND"), gap)).cast("bigint")
    )

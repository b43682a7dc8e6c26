"""One text form per value, so that values of differently typed columns can meet in an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what counts as a written number, and the tokens that stand for "no value"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NULL_TOKENS = ("<NA>", "nan", "Unknown")

WHOLE = r"^\s*\+?(-?)0*(\d+)(\.0*)?\s*$"
LONG_TEXT = 64


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def as_double(text: Column) -> Column:
    """The number a text spells, NULL for anything else (also for Java suffixes such as `1d`)."""
    return F.when(is_number(text), F.trim(text).try_cast("double"))


def number_text(number: Column) -> Column:
    """Whole numbers with all their digits, others as Spark writes a double; NaN is no value."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e38)
    spelled = F.nullif(number.cast("string"), F.lit("NaN"))
    return F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(spelled)


def whole_text(text: Column) -> Column:
    """Digits of a text that spells a whole number, of any length: no plus sign, leading zeros or empty fraction."""
    return F.regexp_replace(F.regexp_replace(text, WHOLE, "$1$2"), "^-0$", "0")


def normalize_value(text: Column) -> Column:
    """Number-like text in the canonical number form, other text unchanged.

    Whole numbers keep every digit; the others go through a double. The patterns fail on the first
    letter of ordinary text, which meets each of them once.
    """
    number = number_text(F.trim(text).try_cast("double"))
    return F.when(text.rlike(WHOLE), whole_text(text)).when(is_number(text), F.coalesce(number, text)).otherwise(text)


def is_value(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def canonical_text(column: Column, data_type: T.DataType) -> Column:
    """The text of a typed column: `1`, `1.0` and `'1'` of three columns all read `1`."""
    if isinstance(data_type, T.IntegralType):
        return column.cast("string")
    if isinstance(data_type, T.DecimalType):
        return F.when(column == F.floor(column), whole_text(column.cast("string"))).otherwise(number_text(column.cast("double")))
    if isinstance(data_type, T.NumericType):
        return number_text(column.cast("double"))
    if isinstance(data_type, T.StringType):
        return normalize_value(column)
    return column.cast("string")


def plain_text(column: Column, data_type: T.DataType) -> Column:
    """As `canonical_text`, but strings stay as they are (`'01'` and `'1'` differ)."""
    return column if isinstance(data_type, T.StringType) else canonical_text(column, data_type)


def short_key(text: Column) -> Column:
    """Long text by its digest: equal iff the whole texts are equal, at a bounded shuffle width."""
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def texts(df: DataFrame, columns: list[str], key: list[str] = (), strings: str = "plain") -> DataFrame:
    """`key` columns plus the text form of `columns`, ready for `unpivot`."""
    form = plain_text if strings == "plain" else canonical_text
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*key, *[form(F.col(c), types[c]).alias(c) for c in columns])


def values_equal(a: Column, b: Column) -> Column:
    """Equal as numbers when both spell one, else equal as text; NaN equals nothing."""
    x, y = as_double(a), as_double(b)
    not_nan = ~F.lower(F.trim(a)).isin("nan", "+nan", "-nan")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise((a == b) & not_nan)


def truth_or_null(text: Column) -> Column:
    """NULL for the tokens that mean "no ground truth"."""
    return F.when(~text.isin(*NULL_TOKENS), text)

"""Raw registry values to clean text, numbers, padded codes and years."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as white space at the edges of a value: the ASCII ones, and all.
ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
ANY_SPACE = (ASCII_SPACE + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
             "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def clean(value: Column, dtype: T.DataType) -> Column:
    """Trimmed text with blank as null; whole numbers are written without a decimal part."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = F.when(value == F.floor(value), value.cast("bigint").cast("string"))
        text = F.when(~F.isnan(value), F.coalesce(whole, value.cast("string")))
    elif isinstance(dtype, T.DecimalType):
        text = F.regexp_replace(value.cast("string"), r"\.0*$", "")
    else:
        text = value.cast("string")
    return F.nullif(strip(text), F.lit(""))


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends.

    Plain ASCII values, nearly all of them, search the short list. These expressions run for every
    value of every column: they are kept short so that the generated code stays small enough for
    the JVM to compile.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.btrim(text, F.when(ascii_only, ASCII_SPACE).otherwise(ANY_SPACE))


def number(text: Column) -> Column:
    """Lenient number: anything that is not plainly numeric is null.

    The cast alone would also take '1d', 'inf' and '0x1p3'.
    """
    return F.when(text.rlike("^[0-9.eE+-]+$"), text.try_cast("double"))


def pad_left(text: Column, width: int) -> Column:
    """Zero-pad to a width; longer values stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def state_code(code: Column) -> Column:
    return F.substring(code, 1, 2)


def date_year(text: Column) -> Column:
    """Year of a DDMMYYYY date that may have lost its leading zero."""
    return F.substring(pad_left(text, 8), 5, 4).try_cast("int")


def year_or_file_year(year: Column, file_year: Column, window: tuple[int, int]) -> Column:
    return F.when(year.between(*window), year).otherwise(file_year)


def label(code: Column, labels: dict) -> Column:
    """Closed code-to-label map; unmapped codes are null."""
    (first, text), *rest = labels.items()
    out = F.when(code == F.lit(first), F.lit(text))
    for key, text in rest:
        out = out.when(code == F.lit(key), F.lit(text))
    return out


def code_text(code: Column) -> Column:
    """A numeric code as text without a decimal part; a code of any length keeps its digits."""
    return code.try_cast("bigint").cast("string")

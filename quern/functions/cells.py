"""The primitives that every operator reads cells with: missing, number, date, text.

A column is read by its type. Typed columns (numbers, dates, booleans) are
missing where they are null or NaN and are their own value; string columns
follow the rules for text cells: tokens such as ``n/a`` are missing, numbers and
dates are parsed. All are column expressions, so they stay in generated code and
simple predicates reach the scan.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a missing or a boolean cell, in lower case.
MISSING = ("", "na", "n/a", "null", "nan", "none", "-", "?")
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "vrai", "faux", "oui", "non")

# How a number and a date are written in a text cell, and what is white space.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ISO_DATE = r"^(\d{4})-(\d{2})(?:-(\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?)?$"
DAY_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$"


def jtrim(c: Column) -> Column:
    """Trim all Unicode white space, where ``trim`` would only take ASCII spaces."""
    return F.btrim(c, F.lit(SPACES))


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.DateType | T.TimestampType | T.TimestampNTZType)


def missing_text(c: Column) -> Column:
    return c.isNull() | F.lower(jtrim(c)).isin(*MISSING)


def is_missing(df: DataFrame, name: str) -> Column:
    c = df[name]
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return missing_text(c)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def parse_number_text(c: Column) -> Column:
    """A text cell as a finite double, else null; hex, suffixes and underscores are no numbers."""
    t = jtrim(c)
    value = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def number(df: DataFrame, name: str) -> Column:
    """A column's cells as doubles; null where missing or not a number."""
    c = df[name]
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.when(~missing_text(c), parse_number_text(c))
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    return F.lit(None).cast("double")


def parse_date_text(c: Column) -> Column:
    """ISO, else day first (swapped where the month can't be one); two-digit years are 20xx; impossible dates are null."""
    t = jtrim(c)
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    whole = lambda pattern, i, default: F.when(part(pattern, i) == "", F.lit(default)).otherwise(part(pattern, i))
    iso = F.concat(part(ISO_DATE, 1), F.lit("-"), part(ISO_DATE, 2), F.lit("-"), whole(ISO_DATE, 3, "01"), F.lit(" "), whole(ISO_DATE, 4, "00"), F.lit(":"), whole(ISO_DATE, 5, "00"), F.lit(":"), whole(ISO_DATE, 6, "00"))
    d, m, y = part(DAY_DATE, 1).try_cast("int"), part(DAY_DATE, 2).try_cast("int"), part(DAY_DATE, 3)
    swap = (m > 12) & (d <= 12)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day_first = F.concat(year, F.lit("-"), two(F.when(swap, d).otherwise(m)), F.lit("-"), two(F.when(swap, m).otherwise(d)), F.lit(" 00:00:00"))
    text = F.when(t.rlike(ISO_DATE), iso).when(t.rlike(DAY_DATE), day_first)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def date(df: DataFrame, name: str) -> Column:
    """A column's cells as timestamps; null where missing or not a date."""
    if is_string(df, name):
        return F.when(~missing_text(df[name]), parse_date_text(df[name]))
    if is_temporal(df, name):
        return df[name].cast("timestamp")
    return F.lit(None).cast("timestamp")


def text(df: DataFrame, name: str) -> Column:
    """A column's cells as trimmed text; null where missing."""
    c = df[name]
    return F.when(~is_missing(df, name), jtrim(c) if is_string(df, name) else c.cast("string"))


def format_number(c: Column) -> Column:
    """Six decimals at most, without trailing zeros."""
    plain = F.format_string("%.6f", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def plain_name(name: str) -> str:
    """Lower case without accents, as names of columns are matched."""
    return "".join(x for x in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(x))


def fold(question: str) -> str:
    """A question as it is matched: no accents, separators as spaces, only letters, digits and comparison signs."""
    low = plain_name(question).replace("_", " ").replace("/", " ")
    return " ".join(re.sub(r"[^a-z0-9><=!.,\s-]", " ", low).split())


# Letters with the accent taken off, for texts in Latin script.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(c: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Words of three letters or digits at least, lower case, without accents and stop words."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)
    found = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def fnv1a(value: str) -> str:
    """32-bit FNV-1a in hex, over UTF-16 code units."""
    h = 2166136261
    units = value.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) % (1 << 32)
    return f"{h:08x}"

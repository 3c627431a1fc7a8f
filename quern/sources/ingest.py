"""Delimited files as they come: encoding, delimiter, header and decimal commas, found on a bounded head.

Only the first 256 KiB of a file are looked at on the driver; the rows are read
by Spark. Cells stay text; the operators parse them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators.profile import per_column

# How much of a file is looked at, delimiters, and how numbers are written in either custom.
HEAD_BYTES = 256 * 1024
DELIMITERS = (",", ";", "\t", "|")
LEAST_VALUES, DECIMAL_SHARE = 5, 0.9
FRENCH_NUMBER = r"^[+-]?\d{1,3}(?:[ \u00a0\u202f.]\d{3})*(?:,\d+)?$|^[+-]?\d+(?:,\d+)?$"
ENGLISH_NUMBER = r"^[+-]?\d{1,3}(?:[ \u00a0\u202f,]\d{3})*(?:\.\d+)?$|^[+-]?\d+(?:\.\d+)?$"


@dataclass(frozen=True)
class ReadFormat:
    encoding: str
    delimiter: str
    decimal_columns: tuple[str, ...] = ()
    header_issues: tuple[str, ...] = ()
    malformed_rows: int = 0


@dataclass(frozen=True)
class Header:
    names: list[str]
    issues: list[str] = field(default_factory=list)


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, through Spark's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = min(HEAD_BYTES, fs.getFileStatus(where).getLen())
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(int(size)))
    finally:
        stream.close()


def decode_head(data: bytes) -> tuple[str, str]:
    """(text, encoding): by byte order mark, else strict UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    for cut in range(4 if len(data) >= HEAD_BYTES else 1):  # a full head may end within a character
        try:
            return data[: len(data) - cut].decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", "replace"), "windows-1252"


def fields_in(line: str, delimiter: str) -> int:
    """Fields of a line; delimiters between quotes don't count."""
    return 1 + sum(part.count(delimiter) for part in line.split('"')[::2])


def detect_delimiter(text: str) -> str:
    """The one that cuts each of the first 20 lines into equally many, and into most, fields."""
    lines = [line for line in re.split(r"\r?\n", text) if line.strip()][:20]
    counts = {d: {fields_in(line, d) for line in lines} for d in DELIMITERS}
    fit = [(min(c), -i, d) for i, (d, c) in enumerate(counts.items()) if len(c) == 1 and min(c) > 1]
    return max(fit)[2] if fit else ","


def repair_header(row: list[str | None]) -> Header:
    """Names that are given and distinct: column_N for blanks, " (2)" and on for repeats."""
    given = [(c or "").strip() for c in row]
    taken: set[str] = set()
    names, issues = [], []
    for i, name in enumerate(given):
        base = name or f"column_{i + 1}"
        avoid = taken if name else taken | {g for g in given if g}
        new = next(n for n in [base, *(f"{base} ({k})" for k in range(2, len(given) + 3))] if n not in avoid)
        taken.add(new)
        names.append(new)
        if new != name:
            issues.append(f"{'duplicate' if name else 'unnamed'}:{i}:{new}")
    return Header(names, issues)


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, most_cells: int | None = None) -> tuple[DataFrame, ReadFormat]:
    """A delimited file as text columns, and how it was read."""
    text, found = decode_head(head_of(spark, path))
    encoding, delimiter = encoding or found, delimiter or detect_delimiter(text)
    first = spark.read.csv(spark.sparkContext.parallelize(text.splitlines()[:1], 1), sep=delimiter, header=False, inferSchema=False).first()
    header = repair_header(list(first) if first else [])
    # Spark reads the Latin alphabets by this name in any session, and Windows-1252 only by a session-wide legacy option.
    read_as = "iso-8859-1" if encoding == "windows-1252" else encoding
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in header.names)
    reader = spark.read.options(sep=delimiter, encoding=read_as, header=True, enforceSchema=True, multiLine='"' in text, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__corrupt")
    raw = reader.schema(f"{schema}, __corrupt string").csv(path)
    if read_as != encoding:
        raw = raw.select(*[from_latin(F.col(f"`{c.replace('`', '``')}`")).alias(c) for c in raw.columns])
    # All columns are read, as a row is only known to be malformed when all of it is parsed.
    content = F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in raw.columns if c != "__corrupt"])
    n, bad, _ = raw.agg(F.count("*"), F.count("__corrupt"), F.max(content)).first()
    if most_cells and n * len(header.names) > most_cells:
        raise ValueError(f"too-large:{n}:{len(header.names)}")
    df = raw.drop("__corrupt")
    decimals = decimal_columns(df)
    return normal_decimals(df, decimals), ReadFormat(encoding, delimiter, tuple(decimals), tuple(header.issues), bad)


#: The characters of Windows-1252 where ISO 8859-1 has control codes 0x80 to 0x9F.
WINDOWS = {code: bytes([code]).decode("cp1252", "ignore") for code in range(0x80, 0xA0)}


def from_latin(text: Column) -> Column:
    """A text that was read as ISO 8859-1 as Windows-1252 has it: the two differ in 27 characters."""
    changed = {chr(code): c for code, c in WINDOWS.items() if c}
    return F.translate(text, "".join(changed), "".join(changed.values()))


def read_text(spark: SparkSession, text: str, delimiter: str | None = None) -> DataFrame:
    """Delimited text that is at hand."""
    delimiter = delimiter or detect_delimiter(text)
    lines = spark.sparkContext.parallelize(text.splitlines())
    rows = spark.read.csv(lines, sep=delimiter, header=False, inferSchema=False)
    header = repair_header(list(spark.read.csv(spark.sparkContext.parallelize(text.splitlines()[:1], 1), sep=delimiter).first()))
    return spark.read.csv(lines, sep=delimiter, header=True).toDF(*header.names) if rows.columns else rows


def decimal_columns(df: DataFrame) -> list[str]:
    """Text columns whose numbers are written with a decimal comma: one pass over all of them."""
    names = [c for c in df.columns if cells.is_string(df, c)]
    if not names:
        return []
    trimmed = lambda d, c: F.trim(d[c])
    english = lambda d, c: trimmed(d, c).rlike(ENGLISH_NUMBER)
    figures = per_column(df, names, {
        "n": lambda d, c: F.count_if(trimmed(d, c) != ""),
        "english": lambda d, c: F.count_if(english(d, c)),
        "french": lambda d, c: F.count_if(~english(d, c) & trimmed(d, c).rlike(FRENCH_NUMBER)),
        "commas": lambda d, c: F.count_if(trimmed(d, c).rlike(FRENCH_NUMBER) & trimmed(d, c).contains(",")),
    })
    n = F.col("n")
    fit = (n >= LEAST_VALUES) & (F.col("english") < DECIMAL_SHARE * n) & (F.col("french") + F.col("english") >= DECIMAL_SHARE * n) & (F.col("commas") > 0)
    found = {r["column"] for r in figures.where(fit).select("column").collect()}
    return [c for c in df.columns if c in found]


def normal_decimals(df: DataFrame, names: list[str]) -> DataFrame:
    """Decimal commas as points and grouping marks taken out, where a cell is such a number."""
    changed = {c: F.when(F.trim(df[c]).rlike(FRENCH_NUMBER), F.replace(F.regexp_replace(F.trim(df[c]), "[ \\u00a0\\u202f.]", ""), F.lit(","), F.lit("."))).otherwise(df[c]) for c in names}
    return df.withColumns(changed) if changed else df


def view_name(file_name: str) -> str:
    """A view's name from a file's: letters, digits and _, in lower case."""
    base = re.sub(r"\.[^.]+$", "", file_name)
    clean = re.sub(r"[^A-Za-z0-9_]", "_", base)
    return (f"t_{clean}" if clean[:1].isdigit() else clean).lower() or "dropped"


def register(spark: SparkSession, path: str) -> str:
    """Register a Parquet, JSON, ORC or delimited file as a view; returns its name."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "json"):
        df = getattr(spark.read, kind)(path)
    elif kind in ("ndjson", "jsonl"):
        df = spark.read.json(path)
    elif kind in ("csv", "tsv", "txt"):
        df = read_delimited(spark, path)[0]
    elif kind in ("xls", "xlsx"):
        raise ValueError("spreadsheets can't be read here: save the sheet as CSV")
    else:
        raise ValueError(f"no reader for .{kind}")
    df.createOrReplaceTempView(view_name(name))
    return view_name(name)

"""CSV ingest (S1–S4): encoding fallback, delimiter fallback, NA tokens, type salvage.

Every column is read as STRING (no ``inferSchema``: it would type dates itself and it
accepts one ``nullValue`` only). One aggregation pass then decides BIGINT / DOUBLE /
BOOLEAN / STRING per column, and a single projection applies it.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.types import q

REPLACEMENT = "\ufffd"
#: Charsets in the fixed order; utf-8-sig and utf-8 are one probe (a byte-order mark is removed).
CHARSETS = tuple(dict.fromkeys({"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}.get(e, e.upper()) for e in K.CSV_ENCODINGS))
#: Bytes that windows-1252 gives a meaning and ISO-8859-1 reads as control characters.
CP1252_BYTES = bytes(b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
CP1252_UNDEFINED = "".join(chr(b) for b in range(0x80, 0xA0) if b not in CP1252_BYTES)
BOOL_TRUE = ("True", "TRUE", "true")
BOOL_FALSE = ("False", "FALSE", "false")


def _read(spark: SparkSession, path: str, sep: str, encoding: str, multiline: bool) -> DataFrame:
    """All columns as text. cp1252 is read as ISO-8859-1, one byte a character, and mapped after:
    Spark offers the charset only under a legacy setting."""
    read = "ISO-8859-1" if encoding == "windows-1252" else encoding
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", read).option("quote", '"').option("escape", '"')
          .option("ignoreLeadingWhiteSpace", True).option("multiLine", multiline)
          .option("mode", "PERMISSIVE").option("inferSchema", False).csv(path))
    if encoding != "windows-1252":
        return df
    as_latin, as_cp1252 = "".join(map(chr, CP1252_BYTES)), CP1252_BYTES.decode("cp1252")
    swap = str.maketrans(as_latin, as_cp1252)
    return df.select(*[F.translate(q(c), as_latin, as_cp1252).alias(c.translate(swap)) for c in df.columns])


def _strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df


def _undecodable(df: DataFrame, encoding: str) -> bool:
    """Text that is not in the charset: U+FFFD after UTF-8, an undefined byte after cp1252."""
    if encoding == "ISO-8859-1" or not df.columns:
        return False
    bad = f"[{REPLACEMENT if encoding == 'UTF-8' else CP1252_UNDEFINED}]"
    if any(ch in name for name in df.columns for ch in bad[1:-1]):
        return True
    return not df.where(reduce(lambda a, b: a | b, [F.coalesce(q(c).rlike(bad), F.lit(False)) for c in df.columns])).limit(1).isEmpty()


def choose_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """When the header parses to one column and contains ';' (then tab), use that."""
    head = spark.read.option("encoding", encoding).text(path).first()
    line = head[0] if head else ""
    if "," in line:
        return ","
    for sep in (";", "\t"):
        if sep in line:
            return sep
    return ","


def null_tokens(df: DataFrame, columns=None, tokens=K.NA_TOKENS) -> DataFrame:
    """S3: sentinel strings → NULL (exact, case-sensitive match after leading spaces)."""
    cols = columns if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = list(tokens)
    return df.select(*[F.when(~F.ltrim(q(c)).isin(toks), q(c)).alias(c) if c in cols
                       else q(c) for c in df.columns])


#: What a cast to a number accepts, as text: anything else is not tried.
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"
WHOLE_SHAPE = r"^\s*[+-]?\d{1,19}\s*$"


def _number(s: Column, kind: str = "double") -> Column:
    """try_cast behind a pattern: a failing cast costs far more than a failing match."""
    return F.when(s.rlike(WHOLE_SHAPE if kind == "bigint" else NUMBER_SHAPE), s.try_cast(kind))


def cleaned_number(col: Column) -> Column:
    """S4 cleaning: strip, drop commas/whitespace, one leading $ € £, then '%' → DOUBLE.

    Kept quirks: a decimal comma '1,5' reads as 15; a percentage is not rescaled.
    """
    s = F.regexp_replace(F.trim(col.cast("string")), K.MONEY_SEPARATORS, "")
    return _number(F.replace(F.regexp_replace(s, K.MONEY_SIGN, ""), F.lit(K.PERCENT), F.lit("")))


@dataclass
class TypeDecision:
    column: str
    kind: str  # bigint | double | boolean | salvaged | string


def decide_types(df: DataFrame, threshold: float = K.NUMERIC_SHARE_THRESHOLD) -> list[TypeDecision]:
    """One aggregation over all string columns; one small row per column reaches the driver."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return []
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        x = q(c)
        exprs += [
            F.count(x).alias(f"nn{i}"),
            F.count(_number(x, "bigint")).alias(f"ni{i}"),
            F.count(_number(x)).alias(f"nd{i}"),
            F.count(F.when(x.isin(*BOOL_TRUE, *BOOL_FALSE), 1)).alias(f"nb{i}"),
            F.count(cleaned_number(x)).alias(f"ns{i}"),
            F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
        ]
    row = df.agg(*exprs).first()
    # "more than 2 distinct values" ⟺ some value differs from both min and max: a second
    # cheap scan, only for columns that pass the share test (no distinct-count shuffle)
    cand = [i for i, c in enumerate(cols) if row[f"nn{i}"] and row[f"ns{i}"] / row[f"nn{i}"] >= threshold]
    third = {}
    if cand:
        r2 = df.agg(*[F.max(F.when((q(cols[i]) != F.lit(row[f"mn{i}"])) &
                                   (q(cols[i]) != F.lit(row[f"mx{i}"])), 1)).alias(f"t{i}")
                      for i in cand]).first()
        third = {i: r2[f"t{i}"] == 1 for i in cand}
    out = []
    for i, c in enumerate(cols):
        n, nn = row["__n"], row[f"nn{i}"]
        if nn == 0:
            out.append(TypeDecision(c, "string"))
        elif row[f"ni{i}"] == nn:
            out.append(TypeDecision(c, "bigint" if nn == n else "double"))
        elif row[f"nd{i}"] == nn:
            out.append(TypeDecision(c, "double"))
        elif row[f"nb{i}"] == nn and nn == n:
            out.append(TypeDecision(c, "boolean"))
        elif row[f"ns{i}"] / nn >= threshold and third.get(i, False):
            out.append(TypeDecision(c, "salvaged"))
        else:
            out.append(TypeDecision(c, "string"))
    return out


def apply_types(df: DataFrame, decisions: list[TypeDecision]) -> DataFrame:
    kinds = {d.column: d.kind for d in decisions}
    cols = []
    for c in df.columns:
        x = q(c)
        k = kinds.get(c, "keep")
        if k == "bigint":
            cols.append(_number(x, "bigint").alias(c))
        elif k == "double":
            cols.append(_number(x).alias(c))
        elif k == "boolean":
            cols.append(x.isin(*BOOL_TRUE).alias(c))
        elif k == "salvaged":
            cols.append(cleaned_number(x).alias(c))
        else:
            cols.append(x)
    return df.select(*cols)


def salvage_numeric(df: DataFrame, threshold: float = K.NUMERIC_SHARE_THRESHOLD) -> DataFrame:
    """S4 on an already-loaded table: only the salvage rule, plain numbers stay as they are."""
    decisions = [d for d in decide_types(df, threshold) if d.kind == "salvaged"]
    return apply_types(df, decisions)


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes: one parallel scan by lines that stops at the first.

    A field that runs over a line break leaves its first line with an open quote, doubled quotes
    count twice, and in all charsets tried the quote is the same byte.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None,
             multiline: bool | None = None, types: bool = True) -> DataFrame:
    """Read a CSV into typed columns.

    Doubled quotes and line breaks inside quotes are read as such. Files are split by lines among
    tasks unless a line break stands inside quotes (``breaks_in_quotes``), which makes each file one
    task; ``multiline`` tells it where it is known. Charsets are tried in the fixed order, each once.
    """
    multiline = breaks_in_quotes(spark, path) if multiline is None else multiline
    names = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}
    order = [names.get(encoding.lower(), encoding)] if encoding else list(CHARSETS)
    for charset in order:
        probe = "ISO-8859-1" if charset == "windows-1252" else charset
        df = _strip_bom(_read(spark, path, sep or choose_separator(spark, path, probe), charset, multiline))
        if charset == order[-1] or not _undecodable(df, charset):
            break
    df = null_tokens(df)
    return apply_types(df, decide_types(df)) if types else df

"""Text forms of results: byte sizes, durations, CSV and JSON cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: unit names and their powers of 1024
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def fmt_bytes(n: Column) -> Column:
    out = F.format_string("%.2f TB", n / 1024.0 ** 4)
    for power in (3, 2, 1, 0):
        out = F.when(n < 1024 ** (power + 1),
                     F.format_string(f"%.2f {BYTE_UNITS[power]}", n / 1024.0 ** power)).otherwise(out)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(out)


def fmt_duration(ms: Column) -> Column:
    return (F.when(F.coalesce(ms, F.lit(0)) == 0, "0ms")
            .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
            .when(ms < 60000, F.format_string("%.1fs", ms / 1000.0))
            .otherwise(F.format_string("%.1fm", ms / 60000.0)))


def fmt_truncate(text: Column, n: int, total: bool = True) -> Column:
    """Shorten to ``n`` characters including the dots, or (``total=False``) to
    ``n`` characters and the dots after them."""
    kept = n - 3 if total else n
    return (F.when(text.isNull(), "")
            .when(F.length(text) > n, F.concat(F.substring(text, 1, kept), F.lit("...")))
            .otherwise(text))


def csv_cell(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike('[,"\n]'), quoted).otherwise(text)


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, the form in which results leave the platform."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def to_csv_lines(df: DataFrame) -> DataFrame:
    """One CSV line per row, cells quoted only where needed. The header is
    :func:`csv_header`; lines are written as files, never collected."""
    cells = [csv_cell(F.col(f"`{c}`").cast("string")) for c in df.columns]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def csv_header(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in columns)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row with text cells; nulls are kept."""
    text = as_text(df)
    return text.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in text.columns]),
                                 {"ignoreNullFields": "false"}).alias("line"))

"""Merged keys: parts joined by ``:`` with ``\\`` as the escape character."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values of the key format
DELIMITER = ":"
ESCAPE = "\\"


def merge_key(parts: Column) -> Column:
    """Join an array of parts into one key text; an empty array gives null."""
    escaped = F.transform(
        parts,
        lambda p: F.replace(
            F.replace(p, F.lit(ESCAPE), F.lit(ESCAPE * 2)),
            F.lit(DELIMITER), F.lit(ESCAPE + DELIMITER)),
    )
    return F.when(F.size(parts) > 0, F.array_join(escaped, DELIMITER))


def split_key(key: Column) -> Column:
    """Inverse of :func:`merge_key`; keeps empty parts, and a stray escape
    stands for the character after it.

    Delimiters that count are those with an even run of escapes before them, so
    the text is cut into runs of ``escaped pair | ordinary character``.
    """
    # one leading delimiter makes every part, empty ones too, a match of its own
    pieces = F.regexp_extract_all(F.concat(F.lit(DELIMITER), key), F.lit(r"(?s):((?:\\.|[^:\\])*)"), F.lit(1))
    return F.when(key.isNotNull(), F.transform(pieces, lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1")))

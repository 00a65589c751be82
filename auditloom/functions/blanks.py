"""The null family: what counts as "no value" in each context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(value: Column) -> Column:
    """Rule-engine blank: null, the empty string or the literal ``null``.

    No trimming and no case folding: ``" "`` and ``"NULL"`` are values.
    """
    return value.isNull() | value.isin("", "null")


def squeeze(value: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def null_word(value: Column) -> Column:
    """Parser blank: null, empty, ``null`` or ``none`` in any case."""
    return value.isNull() | F.lower(value).isin("", "null", "none")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def normalize_text(value: Column) -> Column:
    """Lower-cased, trimmed text; null becomes the empty string."""
    return F.lower(squeeze(text_or_empty(value)))


def keep_if_filled(value: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(value, F.lit(""))

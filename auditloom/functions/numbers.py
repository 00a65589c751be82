"""Two number parsers that deliberately disagree.

``rule_number`` serves rule checks: with both separators present the dot is the
thousands mark.  ``score_number`` serves accuracy scoring: whichever separator
comes last is the decimal mark.  ``1,190.00`` is therefore 1.19 for a rule and
1190.0 for scoring; tests pin both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import squeeze

# Fixed patterns.
NUMBER_TOKEN = r"[+-]?\d[\d.,]*"
PLAIN_NUMBER = r"^[+-]?\d+(\.\d*)?$"
PLAIN_NUMBER_ONLY = r"^[+-]?\d+(?:\.\d*)?\z"
TAG = r"<[^>]+>"
NBSP = "&nbsp;|&#160;|\u00a0"
MARKUP = f"{TAG}|{NBSP}"

# Which separators a number text holds.
BOTH = r"(?s),.*\.|\..*,"
COMMA_LAST = r"(?s)\..*,[^.]*$"
DOT_LAST = r"(?s),.*\.[^,]*$"
MANY_COMMAS = r"(?s),.*,"
EARLIER_DOT = r"(?s)\.(?=.*\.)"

# Each step below mentions its input as few times as it can: Catalyst copies an
# expression into every mention, and these steps nest.


def _to_double(token: Column) -> Column:
    # Extraction leaves nothing of suffixes such as "5d" that a cast would accept; casting an empty text costs an exception.
    return F.nullif(F.regexp_extract(token, PLAIN_NUMBER, 0), F.lit("")).try_cast("double")


def _commas_are_decimals(text: Column) -> Column:
    return F.translate(text, ",.", ".")


def _no_commas(text: Column) -> Column:
    return F.translate(text, ",", "")


def _one_kind(text: Column) -> Column:
    """A lone comma is the decimal mark; of several dots only the last one is."""
    return F.regexp_replace(F.translate(text, ",", "."), EARLIER_DOT, "")


def rule_number(value: Column) -> Column:
    """Number in OCR text for rule checks, or null when there is none."""
    text = value.cast("string")
    # A text that is a number as it stands needs none of the steps below.
    return F.when(text.rlike(PLAIN_NUMBER_ONLY), text.try_cast("double")).otherwise(_marked_up_number(text))


def _marked_up_number(text: Column) -> Column:
    token = F.regexp_extract(F.regexp_replace(text, f"{MARKUP}|[ €$£]", ""), NUMBER_TOKEN, 0)

    def plain(token: Column) -> Column:
        return (
            F.when(token.rlike(BOTH), _commas_are_decimals(token))
            .when(token.rlike(MANY_COMMAS), _no_commas(token))
            .otherwise(_one_kind(token))
        )

    # The lambda binds the token, so that its branches don't extract it anew.
    number = F.get(F.transform(F.array(token), plain), F.lit(0))
    accounting = text.contains("(") & F.regexp_replace(text, f"{MARKUP}| ", "").rlike(r"(?s)^\s*\(.*\)\s*$")
    sign = F.when(accounting, -1.0).otherwise(1.0)
    return sign * _to_double(number)


def float_text(number: Column) -> Column:
    """A number as text in its shortest decimal form with at least one decimal: 5.0, 1234.56."""
    usual = F.abs(number).between(1e-4, 1e16) | (number == 0)
    digits = F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(usual, digits).otherwise(number.cast("string"))


def _rightmost_decimal(text: Column) -> Column:
    return (
        F.when(~text.contains(","), F.when(text.contains("."), F.regexp_replace(text, EARLIER_DOT, "")).otherwise(text))
        .when(text.rlike(COMMA_LAST), _commas_are_decimals(text))
        .when(text.rlike(DOT_LAST) | text.rlike(MANY_COMMAS), _no_commas(text))
        .otherwise(_one_kind(text))
    )


def score_number(value: Column) -> Column:
    """Number in text for scoring, or null when there is none."""
    text = value.cast("string")
    packed = F.regexp_replace(squeeze(text), "[ €$£%]", "")

    def number(packed: Column) -> Column:
        token = F.regexp_extract(_rightmost_decimal(packed), NUMBER_TOKEN, 0)
        return F.get(F.transform(F.array(token), lambda t: _to_double(_rightmost_decimal(t))), F.lit(0))

    # The lambdas bind their texts, so that no branch reads them anew; a number as it stands needs neither.
    return F.when(text.rlike(PLAIN_NUMBER_ONLY), text.try_cast("double")).when(
        text.rlike("[0-9]"), F.get(F.transform(F.array(packed), number), F.lit(0)))


def clamp_unit(confidence: Column, default: float = 0.5) -> Column:
    """Confidence forced into [0, 1]; a missing one takes the default."""
    return F.least(F.greatest(F.coalesce(confidence, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def size_mb(length: Column) -> Column:
    return F.round(length / F.lit(1048576.0), 2)


def suggest_compression(length: Column) -> Column:
    return size_mb(length) > 8

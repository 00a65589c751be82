"""Text helpers used across extraction, evidence and the review views."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import keep_if_filled, null_word, squeeze, text_or_empty
from .numbers import NBSP, TAG, rule_number

# Entity patterns and payment terms.
AMOUNT_PATTERN = r"\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})\b|\b\d+[.,]\d{2}\b"
DATE_PATTERN = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}[/.\-]\d{2}[/.\-]\d{2}\b"
REFERENCE_PATTERN = r"\b[A-Z]{1,5}[-_/]?\d{2,}\b"
PAYMENT_TERMS = (
    "transfer", "bank", "iban", "swift", "paid", "payment", "tarjeta", "card", "receipt",
    "justificante",
)

# Page subtype keywords, first hit wins.
SUBTYPE_KEYWORDS = (
    ("payroll", ("payroll", "nomina", "nómina")),
    ("invoice", ("invoice", "factura")),
    ("receipt", ("receipt", "justificante")),
    ("stamp_page", ("stamp", "seal")),
)

# Page categories asked for by words of a rule.
CATEGORY_KEYWORDS = (
    (("payment", "proof", "justificante", "receipt", "bank"), ("SIGNATURE_STAMP", "SUPPORTING_DOC", "TOTALS")),
    (("translation", "translated", "idioma", "language"), ("SUPPORTING_DOC", "COVER_PAGE")),
    (("quote", "presupuesto", "budget", "supplier"), ("SUPPORTING_DOC", "LINE_ITEMS")),
    (("stamp", "seal", "signature", "signed"), ("SIGNATURE_STAMP",)),
)
PAGE_CATEGORIES = (
    "INVOICE_HEADER", "LINE_ITEMS", "TOTALS", "SIGNATURE_STAMP", "SUPPORTING_DOC", "COVER_PAGE",
    "BLANK", "UNKNOWN",
)

# Fixed patterns: names and payment phrases inside observation prose.
NAME_PATTERNS = (r"(?i)employee\s+name\s+'([^']+)'", r"(?i)name\s+'([^']+)'")
PAYMENT_PATTERNS = (
    r"(?iu)(Payé par[^,.;)]*)",
    r"(?i)(Paid by[^,.;)]*)",
    r"(?i)(pagado por[^,.;)]*)",
    r"(?i)(payment method[^,.;)]*)",
)

# Accented Latin letters and their base letters, position by position.
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"


def contains_any(text: Column, terms) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def sanitize_text(value: Column, data_type: Column | None = None) -> Column:
    """Strip markup from string and date fields; empty, null and none vanish."""
    clean = F.regexp_replace(value, TAG, "")
    clean = F.regexp_replace(clean, r"&#\d+;", " ")
    clean = squeeze(F.regexp_replace(clean, NBSP, " "))
    clean = F.when(~null_word(clean), clean)
    if data_type is None:
        return clean
    return F.when(F.lower(F.trim(F.coalesce(data_type, F.lit("")))).isin("string", "date", ""), clean).otherwise(value)


def snap_enum(value: Column, allowed: Column) -> Column:
    """Canonical allowed value equal up to case, blanks and hyphens, else null."""

    def key(text: Column) -> Column:
        return F.regexp_replace(F.lower(squeeze(text)), r"[\s\-]+", "_")

    wanted = key(value)
    return F.try_element_at(F.filter(allowed, lambda item: key(item) == wanted), F.lit(1))


def _sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def extract_entities(text: Column) -> Column:
    """Struct of sorted distinct amounts, dates, references and payment markers."""
    body = text_or_empty(text)
    found = F.regexp_extract_all(body, F.lit(AMOUNT_PATTERN), F.lit(0))
    amounts = F.filter(F.transform(found, lambda m: F.round(rule_number(m), 2)), lambda n: n.isNotNull())
    low = F.lower(body)
    markers = F.filter(F.array(*[F.lit(t) for t in PAYMENT_TERMS]), lambda t: low.contains(t))
    return F.struct(
        _sorted_set(amounts).alias("amounts"),
        _sorted_set(F.regexp_extract_all(body, F.lit(DATE_PATTERN), F.lit(0))).alias("dates"),
        _sorted_set(F.regexp_extract_all(body, F.lit(REFERENCE_PATTERN), F.lit(0))).alias("references"),
        _sorted_set(markers).alias("payment_markers"),
    )


def doc_subtype(description: Column) -> Column:
    low = F.lower(text_or_empty(description))
    subtype = None
    for name, words in SUBTYPE_KEYWORDS:
        hit = contains_any(low, words)
        subtype = F.when(hit, name) if subtype is None else subtype.when(hit, name)
    return subtype.otherwise("unknown")


def normalize_category(value: Column) -> Column:
    return F.upper(squeeze(F.coalesce(keep_if_filled(value), F.lit("UNKNOWN"))))


def target_categories(rule_text: Column) -> Column:
    """Page categories worth looking at for a rule, sorted."""
    low = F.lower(text_or_empty(rule_text))
    wanted = F.array(F.lit("INVOICE_HEADER"))
    nothing = F.array().cast("array<string>")
    for words, categories in CATEGORY_KEYWORDS:
        extra = F.array(*[F.lit(c) for c in categories])
        wanted = F.array_union(wanted, F.when(contains_any(low, words), extra).otherwise(nothing))
    return F.array_sort(wanted)


def display_text(value: Column) -> Column:
    """Identifier turned into a label: separators to blanks, first letter raised."""
    spaced = F.regexp_replace(text_or_empty(value), "[_-]", " ")
    words = squeeze(F.regexp_replace(spaced, r"\s+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000_000))


def keyword_set(text: Column) -> Column:
    """Distinct lower-case words of three or more characters."""
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    useful = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin("true", "false", "none"))
    return F.array_distinct(useful)


def role_like(name: Column, phrases) -> Column:
    """True when a candidate name is a role title (or too short to be a name)."""
    low = F.lower(squeeze(name))
    hit = F.length(name) < 3
    for phrase in phrases:
        word = phrase.strip().lower()
        if word:
            hit = hit | (low == word) | (low.contains(word) & (F.length(name) < 35))
    return hit


def parse_employee_name(observation: Column, phrases=()) -> Column:
    """Quoted employee name in an observation; role titles give null."""
    text = text_or_empty(observation)
    found = F.coalesce(*[keep_if_filled(F.regexp_extract(text, p, 1)) for p in NAME_PATTERNS])
    name = squeeze(found)
    return F.when(~role_like(name, phrases), name)


def parse_payment_phrase(observation: Column) -> Column:
    """First payment phrase of an observation, up to punctuation."""
    text = text_or_empty(observation)
    found = F.coalesce(*[keep_if_filled(F.regexp_extract(text, p, 1)) for p in PAYMENT_PATTERNS])
    return squeeze(found)


@cache
def _decompositions() -> tuple[str, str]:
    """Letters with marks and their bare letters in the same order, then all marks, which have none."""
    letters, bare, marks = [], [], []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif decomposed := unicodedata.normalize("NFD", c):
            rest = "".join(x for x in decomposed if unicodedata.category(x) != "Mn")
            if len(rest) == 1 and rest != c:
                letters.append(c)
                bare.append(rest)
    return "".join(letters + marks), "".join(bare)


def fold_any_script(text: Column) -> Column:
    """Lower case without combining marks, for any script; null stays null.

    The canonical decompositions to one letter are a map applied inside the JVM. Characters of several
    letters (Hangul syllables, two-part vowel signs) stay composed.
    """
    return F.translate(F.lower(text), *_decompositions())


def fold_accents(text: Column) -> Column:
    """Lower case without accents, for Latin-script text."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def clean_updates(updates: Column) -> Column:
    """Map of field updates without blank keys or null values, all trimmed."""
    kept = F.map_filter(updates, lambda k, v: (squeeze(k) != "") & v.isNotNull())
    return F.transform_values(F.transform_keys(kept, lambda k, v: squeeze(k)), lambda k, v: squeeze(v))


def join_distinct(values: Column) -> Column:
    """Sorted distinct non-empty values joined with ``'; '``."""
    filled = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.array_join(F.array_sort(F.array_distinct(filled)), "; ")

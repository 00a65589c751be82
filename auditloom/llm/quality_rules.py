"""Quality rules, line first: bad lines go, then documents that lost too much text.

Each line is judged alone: navigation (many separators between few words), symbols (marks that prose
does not have), shouting (repeated exclamation marks), boilerplate phrases and, for lines of several
words, the lack of any closing or inner punctuation. What remains is joined again; a document is kept
if it passes the base rules and keeps ``KEEP_TENTHS`` tenths of its word characters.

Everything is computed inside the row: no shuffle, so neither hot sources nor groups of copies matter.
A repeated 3-word window is found by sorting the windows of one text (n log n, also for very long texts).

Defined results: null or empty text has no words and fails the base rules; null ids, repeated rows and
further columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unpacked, whole_row, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document keeps at least so many tenths of its word characters.
KEEP_TENTHS = 6
#: Lines of fewer words need no punctuation (headings, list items).
PUNCTUATION_MIN_WORDS = 12
#: A boilerplate phrase condemns lines up to this length; in longer ones it is part of prose.
BOILERPLATE_MAX_WORDS = 30

#: Characters that count as symbols, the separator of navigation lines, boilerplate phrases.
SYMBOLS = r"[#*$%&|<>]"
SEPARATOR = "|"
PUNCTUATION = r"[.,:;!?…。，！？؟۔।]"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "enable javascript", "javascript is disabled", "click here", "read more", "sign up", "log in", "subscribe",
    "licensed under the", "lorem ipsum",
)

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _window_keys(hashes: Column) -> Column:
    """One key for each 3-word window."""
    n = F.size(hashes) - 2
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(hashes, 1, n), lambda first, i: F.xxhash64(first, F.get(hashes, i + 1), F.get(hashes, i + 2))))


def _ordered(keys: Column) -> Column:
    """Windows ordered by key; empty where no two are equal, as in most texts, which spares the sort."""
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p")))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.array().cast("array<struct<k:bigint,p:int>>")).otherwise(F.sort_array(pairs))


def _starts(ordered: Column) -> Column:
    """Start positions of repeated windows, ascending."""
    twin = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["k"] == x["k"]) | (F.get(ordered, i + 1)["k"] == x["k"]))
    return F.sort_array(F.transform(twin, lambda x: x["p"]))


def _covered(starts: Column) -> Column:
    """Words inside the windows that begin at ``starts``."""
    steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _marks(line: Column) -> Column:
    """The counts that the line rules look at; words are counted by the spaces between them."""
    return F.struct(
        line.alias("line"), _filled(line).alias("filled"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"),
        F.regexp_count(line, F.lit(SYMBOLS)).alias("symbols"),
        F.regexp_count(line, F.lit("[!?]{2,}")).alias("shouts"))


def _bad(m: Column) -> Column:
    """True for the marks of a line with words that some line rule removes."""
    separators = F.length(m["line"]) - F.length(F.replace(m["line"], F.lit(SEPARATOR), F.lit("")))
    navigation = (m["symbols"] >= 3) & (separators >= 3) & (separators * 4 >= m["words"])
    unpunctuated = (m["words"] >= PUNCTUATION_MIN_WORDS) & ~m["line"].rlike(PUNCTUATION)
    boilerplate = (m["words"] <= BOILERPLATE_MAX_WORDS) & F.lower(m["line"]).rlike("|".join(BOILERPLATE))
    return m["filled"] & (navigation | (m["symbols"] * 2 >= m["words"]) | (m["shouts"] * 2 >= m["words"]) | unpunctuated | boilerplate)


def _filled(line: Column) -> Column:
    """True for a line with a word."""
    return F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__quality``: the measures, the verdicts and the cleaned text."""
    rest = docs.columns
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    q = docs.select(F.struct(*rest).alias("row"), body.alias("body"))
    q = staged(q, "words", words_of(F.col("body")))
    q = staged(q, "keys", F.transform("words", lambda w: F.xxhash64(w)))
    q = staged(q, "keys_3", _window_keys(F.col("keys")), ["row", "body", "words"])
    q = staged(q, "ordered", _ordered(F.col("keys_3")), ["row", "body", "words"])
    q = staged(q, "starts", _starts(F.col("ordered")), ["row", "body", "words"])
    q = q.select("row", "body", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 _covered(F.col("starts")).alias("n_repeat_words"), F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    q = staged(q, "lines", F.split("body", "\n"), ["row", "n_words", "word_chars", "n_repeat_words", "n_symbols"])
    q = staged(q, "marks", F.transform("lines", _marks))
    q = staged(q, "judged", F.transform("marks", lambda m: F.struct(m["line"].alias("line"), m["filled"].alias("filled"), _bad(m).alias("bad"))),
               ["row", "n_words", "word_chars", "n_repeat_words", "n_symbols"])
    q = q.withColumn("filled", F.transform(F.filter("judged", lambda x: x["filled"]), lambda x: x["line"]))
    q = q.withColumn("cleaned", F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"))
    removed = F.array_join(F.transform(F.filter("judged", lambda x: x["bad"]), lambda x: x["line"]), "\n")
    q = staged(q, "left_chars", F.col("word_chars") - F.length(F.array_join(words_of(removed), "")),
               ["row", "n_words", "word_chars", "n_repeat_words", "n_symbols", "filled", "cleaned"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    q = staged(q, "__quality", F.struct(
        "n_words", "word_chars", "n_symbols", (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (~failed & (10 * F.col("left_chars") >= KEEP_TENTHS * F.col("word_chars"))).alias("kept"),
        "left_chars", "cleaned"), ["row"])
    return q.select(*[F.col("row")[c].alias(c) for c in rest], "__quality")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: measures and verdicts (the cleaned text is left out and not computed twice)."""
    out = measure(docs.select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"__quality.{m}").alias(m) for m in (*_MEASURES, "base_failed", "kept", "left_chars")])


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with their cleaned text, in the columns of ``docs``; ``n_chars`` follows."""
    out = measure(docs.select("text", whole_row(docs.drop("text")).alias("rest"))).where("__quality.kept")
    cleaned = F.col("__quality.cleaned")
    return unpacked(out, "rest", docs, {"text": cleaned, "n_chars": F.length(cleaned).cast("long")})


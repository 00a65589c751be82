import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from auditloom.functions import dates, identity, numbers, text
from auditloom.functions.fuzzy import close_match


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "v string").select(column_of(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("<span>87</span>%", 87.0), ("<td>12,5</td>", 12.5), ("1.190,00", 1190.0), ("1,90", 1.9), ("€ 1.190,00", 1190.0), ("19%", 19.0),
    ("(12,50)", -12.5), ("1,190.00", 1.19), ("1.2,3,4", None), ("%%%", None), ("5d", 5.0), ("null", None), (None, None), ("1,234,567", 1234567.0),
])
def test_rule_number(spark, raw, want):
    assert one(spark, numbers.rule_number, raw) == want


@pytest.mark.parametrize("raw,want", [("1.190,00", 1190.0), ("1,190.00", 1190.0), ("1.190.000", 1190.0), ("12%", 12.0), ("none", None)])
def test_score_number(spark, raw, want):
    assert one(spark, numbers.score_number, raw) == want


@pytest.mark.parametrize("raw,order,want", [
    ("15/03/2024", "DMY", "2024-03-15"), ("2024/3/5", "DMY", "2024-03-05"), ("03/04/2024", "DMY", "2024-04-03"), ("03/04/2024", "MDY", "2024-03-04"),
    ("13/13/2024", "DMY", "13/13/2024"), ("May 2024", "DMY", "may 2024"), ("", "DMY", None),
])
def test_normalize_date(spark, raw, order, want):
    assert one(spark, lambda c: dates.normalize_date(c, order), raw) == want


def test_entities(spark):
    e = one(spark, text.extract_entities, "Invoice total 1.190,00 EUR ref INV-2025-10")
    assert e["amounts"] == [1190.0] and e["references"] == ["INV-2025"]


def test_names_and_keys(spark):
    assert one(spark, identity.match_key, "A.5.d.- Foo-U0223-25.pdf") == "a5dfoou022325"
    assert one(spark, identity.safe_stem, "Ünï (1).pdf") == "n-1"
    assert one(spark, identity.safe_stem, "///.pdf") in ("pdf", "document")
    assert one(spark, lambda c: text.parse_employee_name(c, ["community liaison"]), "Employee name 'Community Liaison' seen") is None
    assert one(spark, text.parse_payment_phrase, "stamp; Paid by bank, page 2") == "Paid by bank"
    assert one(spark, text.display_text, " vendor_vat-required ") == "Vendor vat required"


def test_close_match(spark):
    df = spark.createDataFrame([("hotel arts barcelona", "hotel artes barcelona"), ("abcd", "wxyz"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(close_match("a", "b")).collect()] == [True, False, None]


def test_folding_equals_the_decomposition_in_any_script(spark):
    def plain(value):
        return "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")

    rnd = random.Random(5)
    ranges = ((0x20, 0x250), (0x300, 0x530), (0x590, 0x700), (0x900, 0x980), (0x1E00, 0x2000), (0x3040, 0x3100), (0xF900, 0xFAFF))
    chars = [chr(c) for a, b in ranges for c in range(a, b) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Lu", "Lt")]
    chars = [c for c in chars if len(plain(c)) <= 1]
    texts = ["".join(rnd.choice(chars) for _ in range(60)) for _ in range(300)] + ["", "Ŵêłçömé ñandú ÅÇ Ёлка ή", "한국어 å̧", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", text.fold_any_script(F.col("v")).alias("v")).collect()
    got = {r["i"]: r["v"] for r in rows}
    for i, t in enumerate(texts[:301]):
        assert got[i] == plain(t), t
    assert got[301] == "wełcome nandu ac елка η" and got[302] == "한국어 a" and got[303] is None

"""Scalar functions applied to strings built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blanks, dates, identity, numbers, text
from . import scenario
from .registry import query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
DENYLIST = ("supplier liaison", "community manager")


def _case(key, *values):
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(key == i, v) if out is None else out.when(key == i, v)
    return out.otherwise(values[-1])


def amount_strings(spark, sf_dir):
    li = scenario.read(spark, sf_dir, "lineitem")
    c = scenario.cents(F.col("l_extendedprice"))
    eu, us = scenario.european(c), F.concat(
        F.format_number((c - c % 100) / 100, 0), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    flat = scenario.plain(c)
    return li.select(*LINE, _case(
        F.col("l_partkey") % 10,
        eu, us, F.concat(F.lit("("), flat, F.lit(")")), F.concat(F.lit(" € "), eu),
        F.concat(F.lit("<td>"), flat, F.lit("</td>%")), F.concat(F.lit("Total: "), flat, F.lit(" EUR")),
        F.lit("%%%"), F.concat(F.col("l_quantity").cast("int"), F.lit(",5")),
        F.concat(F.lit("1.2,3,"), F.col("l_linenumber")), F.lit("null")).alias("text"))


@query("normalize_numeric")
def normalize_numeric(spark, sf_dir):
    return amount_strings(spark, sf_dir).withColumn("number", numbers.rule_number(F.col("text")))


@query("normalize_number_eval")
def normalize_number_eval(spark, sf_dir):
    return amount_strings(spark, sf_dir).withColumn("number", numbers.score_number(F.col("text")))


def date_strings(spark, sf_dir):
    d = F.col("l_shipdate")
    return scenario.read(spark, sf_dir, "lineitem").select(*LINE, _case(
        F.col("l_partkey") % 7,
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "M.d.yyyy"),
        F.date_format(d, "yyyy/M/d"), F.date_format(d, "'Q1' yyyy"), F.date_format(d, "d-M-yy"), F.lit("")).alias("text"))


@query("normalize_date")
def normalize_date(spark, sf_dir):
    t = F.col("text")
    return date_strings(spark, sf_dir).withColumns({
        "dmy": dates.normalize_date(t), "mdy": dates.normalize_date(t, "MDY")})


@query("normalize_date_token")
def normalize_date_token(spark, sf_dir):
    t = F.col("text")
    return date_strings(spark, sf_dir).withColumns({
        "token": dates.date_token(t), "is_fragment": dates.is_date_fragment(t)})


@query("normalize_text")
def normalize_text(spark, sf_dir):
    return scenario.read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(blanks.normalize_text(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n")))).alias("digest"))


@query("sanitize_text")
def sanitize_text(spark, sf_dir):
    clean = text.sanitize_text(F.col("html"))
    return scenario.read(spark, sf_dir, "pages").select(
        "page_id", F.length(clean).alias("n_chars"), F.md5(clean).alias("digest"))


@query("snap_enum")
def snap_enum(spark, sf_dir):
    allowed = F.array(*[F.lit(t[0]) for t in scenario.TYPES])
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("-")))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("  "), F.lower("o_orderpriority"))).otherwise(F.lit("6-NONE"))
    return scenario.read(spark, sf_dir, "orders").select("o_orderkey", value.alias("raw")).withColumn(
        "snapped", text.snap_enum(F.col("raw"), allowed))


@query("match_key")
def match_key(spark, sf_dir):
    label = F.concat(F.lit(" A.5.d.- "), "url", F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(""))
    return scenario.read(spark, sf_dir, "pages").select("page_id", identity.match_key(label).alias("match_key"))


@query("safe_stem")
def safe_stem(spark, sf_dir):
    name = F.concat(F.replace(F.col("text"), F.lit("/"), F.lit(" ")), F.lit(".pdf"))
    return scenario.read(spark, sf_dir, "benchmark").select("item_id", identity.safe_stem(name).alias("stem"))


@query("source_hash")
def source_hash(spark, sf_dir):
    return scenario.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        identity.local_source_hash(F.concat(F.lit("/in/"), "o_orderkey", F.lit(".pdf")),
                                   dates.epoch_seconds(F.col("o_orderdate")), F.col("o_custkey")).alias("local_hash"),
        identity.drive_source_hash(F.col("o_orderkey").cast("string"),
                                   F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority"))).alias("drive_hash"))


@query("run_id")
def run_id(spark, sf_dir):
    h = identity.short_hash(F.col("event_type"))
    return scenario.read(spark, sf_dir, "events").select(
        "event_id", identity.run_id(F.col("ts"), F.concat(F.lit("Run "), "user_id", F.lit(".pdf")), h).alias("run_id"))


@query("dedup_key")
def dedup_key(spark, sf_dir):
    o = F.col("o_orderkey")
    return scenario.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        identity.dedup_key(F.when(o % 2 == 0, o.cast("string")).otherwise(""), F.concat(F.lit("file:///"), o),
                           F.when(o % 5 > 0, F.col("o_orderstatus"))).alias("dedup_key"))


@query("revision_of")
def revision_of(spark, sf_dir):
    o = F.col("o_orderkey")
    return scenario.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        identity.revision_of(F.when(o % 3 == 0, F.concat(F.lit("head-"), o)), F.when(o % 2 == 0, F.md5(o.cast("string"))).otherwise(""),
                             F.date_format("o_orderdate", "yyyy-MM-dd")).alias("revision"))


def descriptions(spark, sf_dir):
    o = F.col("o_orderkey")
    kind = _case(o % 6, F.lit("Invoice total "), F.lit("Nómina importe "), F.lit("Bank RECEIPT over "),
                 F.lit("stamped page "), F.lit("Factura por "), F.lit("Annex "))
    c = scenario.cents(F.col("o_totalprice"))
    body = F.concat(kind, scenario.european(c), F.lit(" EUR ref INV-"), o, F.lit("/AB2024 on "),
                    F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", due "), F.date_format("o_orderdate", "yyyy-MM-dd"),
                    F.lit("; fee "), scenario.plain(o % 1000), F.when(o % 4 == 0, " paid by card").otherwise(""))
    return scenario.read(spark, sf_dir, "orders").select("o_orderkey", body.alias("description"))


@query("extract_entities")
def extract_entities(spark, sf_dir):
    found = descriptions(spark, sf_dir).withColumn("e", text.extract_entities(F.col("description")))
    return found.select(
        "o_orderkey", F.size("e.amounts").alias("n_amounts"),
        F.element_at("e.amounts", 1).alias("least"), F.element_at("e.amounts", -1).alias("most"),
        F.array_join("e.dates", "|").alias("dates"), F.array_join("e.references", "|").alias("refs"),
        F.array_join("e.payment_markers", "|").alias("markers"))


@query("doc_subtype")
def doc_subtype(spark, sf_dir):
    return descriptions(spark, sf_dir).select("o_orderkey", text.doc_subtype(F.col("description")).alias("subtype"))


@query("normalize_category")
def normalize_category(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")))
    return scenario.read(spark, sf_dir, "part").select("p_partkey", text.normalize_category(raw).alias("category"))


@query("target_categories")
def target_categories(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("payment", "translated", "supplier quote", "seal", "total", "budget language")])
    rule_text = F.concat("p_name", F.lit(" "), words[(F.col("p_partkey") % 6).cast("int")])
    return scenario.read(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.target_categories(rule_text), "|").alias("categories"))


@query("display_text")
def display_text(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("--"), F.lower("p_brand"))
    return scenario.read(spark, sf_dir, "part").select("p_partkey", text.display_text(raw).alias("label"))


@query("keyword_set")
def keyword_set(spark, sf_dir):
    return scenario.read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.array_join(F.array_sort(text.keyword_set(F.col("text"))), " ")).alias("digest"),
        F.size(text.keyword_set(F.col("text"))).alias("n_words"))


def observations(spark, sf_dir):
    k = F.col("c_custkey")
    said = _case(k % 6,
                 F.concat(F.lit("The Employee  name '"), "c_name", F.lit("' is clear; Paid by bank transfer, ok")),
                 F.concat(F.lit("name '"), "c_mktsegment", F.lit("' and payment method: cash (signed)")),
                 F.lit("employee name 'Supplier Liaison'. Pagado por caja; fin"), F.lit("name 'ab'"),
                 F.lit("Payé par la banque, page 2"), F.lit("nothing seen"))
    return scenario.read(spark, sf_dir, "customer").select("c_custkey", said.alias("observation"))


@query("parse_employee_name")
def parse_employee_name(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("employee_name", text.parse_employee_name(F.col("observation"), DENYLIST))


@query("parse_payment_phrase")
def parse_payment_phrase(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("payment", text.parse_payment_phrase(F.col("observation")))


@query("observation_rows")
def observation_rows(spark, sf_dir):
    """Fallback values: (type, rule, field, parser) rows joined to observations."""
    wanted = spark.createDataFrame(
        [("PERS_LOCAL", "R_PL_010", "employee_name", "employee_name_quote"),
         ("PERS_LOCAL", "R_PL_010", "payment_method", "payment_phrase"),
         ("VIAJES", "R_VIA_011", "payment_method", "payment_phrase")],
        "invoice_type_id string, rule_id string, target_field string, parser_kind string")
    said = scenario.documents(spark, sf_dir).join(
        observations(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).join(wanted, "invoice_type_id")
    obs = F.col("observation")
    parsed = F.when(F.col("parser_kind") == "employee_name_quote", text.parse_employee_name(obs, DENYLIST)).when(
        F.col("parser_kind") == "payment_phrase", text.parse_payment_phrase(obs))
    return said.select("doc_id", "rule_id", "target_field", parsed.alias("value")).filter("value IS NOT NULL")


@query("fold_accents")
def fold_accents(spark, sf_dir):
    return scenario.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("digest"))


@query("clamp_confidence")
def clamp_confidence(spark, sf_dir):
    c = F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal") / 5000)
    return scenario.read(spark, sf_dir, "customer").select("c_custkey", numbers.clamp_unit(c).alias("confidence"))


@query("clean_updates")
def clean_updates(spark, sf_dir):
    k = F.col("c_custkey")
    updates = F.map_from_arrays(
        F.array(F.lit(" vendor "), F.lit("  "), F.lit("note"), F.lit("kind")),
        F.array(F.concat(F.lit(" "), "c_name", F.lit("  ")), F.lit("x"), F.when(k % 2 == 0, F.col("c_mktsegment")), F.lit("")))
    clean = text.clean_updates(updates)
    return scenario.read(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(F.array_sort(F.map_keys(clean)), "|").alias("names"),
        F.try_element_at(clean, F.lit("vendor")).alias("vendor"), F.try_element_at(clean, F.lit("note")).alias("note"))


@query("parse_iso_utc")
def parse_iso_utc(spark, sf_dir):
    ts, k = F.col("ts"), F.col("event_id")
    raw = _case(k % 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
                F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("soon"))
    return scenario.read(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds(dates.parse_iso_utc(raw)).alias("epoch"))


@query("size_mb")
def size_mb(spark, sf_dir):
    n = F.length("html").cast("bigint") * 1000
    return scenario.read(spark, sf_dir, "pages").select(
        "page_id", numbers.size_mb(n).alias("size_mb"), numbers.suggest_compression(n).alias("suggest_compression"))

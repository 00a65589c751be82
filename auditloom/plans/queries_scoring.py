"""Ground-truth matching and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blanks import normalize_text
from ..functions.text import fold_any_script
from ..operators import scoring as P
from ..sources import truth as T
from . import queries_rules as Q
from . import scenario
from .registry import query

COLUMN_MAP = {"Supplier": "vendor_name", "Number": "invoice_number", "Date": "invoice_date", "Currency": "currency",
              "Net": "net_amount", "VAT": "tax_amount", "Rate": "vat_rate", "Method": "payment_method", "Period": "pay_period", "Absent": "x"}


def wide_truth(spark, sf_dir):
    """A wide truth row per order, disagreeing here and there."""
    w = scenario.wide_documents(spark, sf_dir)
    k, c = F.col("doc_id"), F.col("o_custkey")
    return w.select(
        "doc_id", "invoice_type_id",
        F.when(c % 3 == 0, F.concat(F.lit(" customer#"), c, F.lit(" "))).when(c % 3 == 1, F.concat(F.lit("the Customer#"), c)).otherwise("zz").alias("Supplier"),
        F.concat(F.lit("INV-"), k).alias("Number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
        F.when(k % 5 > 0, "EUR").otherwise(" ").alias("Currency"),
        scenario.plain(F.col("net_c") + F.when(k % 7 == 0, 3).otherwise(0)).alias("Net"), scenario.european(F.col("tax_c")).alias("VAT"),
        F.concat(F.col("rate"), F.when(k % 9 == 0, ".001").otherwise("")).alias("Rate"),
        F.lit("bank").alias("Method"), F.when(k % 2 == 0, "2024").otherwise("May 2024").alias("Period"))


def truth(spark, sf_dir):
    return T.truth_unpivot(wide_truth(spark, sf_dir), COLUMN_MAP, ("doc_id", "invoice_type_id"))


def extracted(spark, sf_dir):
    k = F.col("doc_id")
    pay = F.when(k % 4 == 0, "12/05").otherwise("Bank transfer")
    period = (F.when(k % 6 == 0, "5").when(k % 6 == 1, "05/2024 y 2024").when(k % 6 == 2, "2023").when(k % 6 == 3, "may 2024")
              .when(k % 6 == 4, "2024").otherwise("x"))
    more = (("F_PAY", "payment_method", pay), ("F_PER", "pay_period", period))
    return scenario.field_results_of(scenario.wide_documents(spark, sf_dir), more)


def compared(spark, sf_dir):
    return P.compare_fields(extracted(spark, sf_dir), truth(spark, sf_dir))


@query("truth_unpivot")
def truth_unpivot(spark, sf_dir):
    return truth(spark, sf_dir).drop("invoice_type_id")


@query("truth_schema_filter")
def truth_schema_filter(spark, sf_dir):
    return T.truth_schema_filter(truth(spark, sf_dir), scenario.fields(spark)).groupBy("field_name").agg(F.count(F.lit(1)).alias("rows"))


@query("compare_value")
def compare_value(spark, sf_dir):
    return compared(spark, sf_dir).select("doc_id", "field_name", "match", "partial", "note")


@query("extraction_full_outer_truth")
def full_outer(spark, sf_dir):
    c = compared(spark, sf_dir)
    side = F.when(F.col("value_text").isNull() & F.col("truth_value").isNull(), "neither").when(
        F.col("value_text").isNull(), "truth").when(F.col("truth_value").isNull(), "extracted").otherwise("both")
    return c.groupBy("field_name", side.alias("side")).agg(F.count(F.lit(1)).alias("fields"))


def truth_rules(spark, sf_dir):
    docs = scenario.documents(spark, sf_dir).join(scenario.rules(spark), "invoice_type_id")
    k, r = F.col("doc_id"), F.col("rule_order")
    return docs.select("doc_id", "rule_id", F.when((k + r) % 3 == 0, "passed").when((k + r) % 3 == 1, "failed").otherwise("").alias("truth_status"))


@query("rule_accuracy")
def rule_accuracy(spark, sf_dir):
    return P.score_rules(Q.first_pass(spark, sf_dir), truth_rules(spark, sf_dir))


def scores(spark, sf_dir):
    docs = scenario.documents(spark, sf_dir)
    kinds = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "VIAJES").otherwise(F.col("invoice_type_id")).alias("invoice_type_id"))
    return P.score_documents(docs, compared(spark, sf_dir), Q.first_pass(spark, sf_dir), truth_rules(spark, sf_dir), kinds)


@query("score_documents")
def score_documents(spark, sf_dir):
    return scores(spark, sf_dir)


@query("batch_accuracy")
def batch_accuracy(spark, sf_dir):
    docs = scenario.documents(spark, sf_dir).select("doc_id", "invoice_type_id", "invoice_file")
    return P.batch_accuracy(docs.join(P.score_fields(compared(spark, sf_dir)), "doc_id", "left"))


@query("field_accuracy")
def field_accuracy(spark, sf_dir):
    return P.field_accuracy(compared(spark, sf_dir))


@query("similar_strings")
def similar_strings(spark, sf_dir):
    """Neighbouring lines of each document, paired inside the row; no SQL form."""
    docs = scenario.read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("_l")).filter(F.size("_l") > 1)
    pairs = docs.select("doc_id", "_l", F.explode(F.sequence(F.lit(2), F.size("_l"))).alias("line_no")).select(
        "doc_id", "line_no", normalize_text(F.element_at("_l", F.col("line_no"))).alias("a"),
        normalize_text(F.element_at("_l", F.col("line_no") - 1)).alias("b"))
    return P.similar(pairs, "a", "b").select("doc_id", "line_no", "similar")


@query("fold_any_script")
def fold_any(spark, sf_dir):
    return scenario.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(fold_any_script(F.col("text"))).alias("digest"))


def truth_files(spark, sf_dir):
    """Truth rows by part name and document names by order and part."""
    p = scenario.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("line_no"), F.when(k % 10 == 0, F.concat(F.lit("gd"), k)).alias("source_id"),
                    F.when(k % 20 == 0, (k % 5).cast("string")).alias("revision_id"),
                    F.when(k % 50 == 2, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" "), "p_brand")).alias("source_name"))


def named_documents(spark, sf_dir):
    li = scenario.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    rows = li.join(scenario.read(spark, sf_dir, "part"), "p_partkey")
    k = F.col("l_orderkey")
    return rows.select(k.alias("doc_id"), F.concat(F.lit("gd"), "p_partkey").alias("source_id"), (k % 5).cast("string").alias("revision_id"),
                       F.when(k % 3 == 0, F.concat("p_name", F.lit("-"), "p_brand", F.lit("-"), k, F.lit(".pdf")))
                        .when(k % 3 == 1, F.concat("p_type", F.lit(" "), "p_name", F.lit(".pdf"))).otherwise(F.concat(F.col("p_brand"), F.lit(".PDF"))).alias("file_name"))


@query("match_truth_by_name")
def match_truth_by_name(spark, sf_dir):
    return T.match_by_name(named_documents(spark, sf_dir), truth_files(spark, sf_dir))


@query("match_truth_by_source")
def match_truth_by_source(spark, sf_dir):
    return T.match_by_source(named_documents(spark, sf_dir), truth_files(spark, sf_dir))


@query("match_truth")
def match_truth(spark, sf_dir):
    return T.match_truth(named_documents(spark, sf_dir), truth_files(spark, sf_dir))


@query("resolve_truth_table")
def resolve_truth_table(spark, sf_dir):
    tables = scenario.read(spark, sf_dir, "orders").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(
        scenario.type_of(F.col("o_orderpriority")).alias("invoice_type_id"), F.concat(F.lit("truth_"), F.lower(F.substring("o_orderpriority", 3, 9))).alias("table_name")).distinct()
    overall = spark.createDataFrame([("", "truth_all")], "invoice_type_id string, table_name string")
    return T.resolve_truth(scenario.documents(spark, sf_dir).select("doc_id", "invoice_type_id"), tables.unionByName(overall)).select("doc_id", "table_name")


@query("json_over_csv_truth")
def json_over_csv_truth(spark, sf_dir):
    """Sibling truth JSON (local sources) ahead of the CSV row."""
    runs = scenario.runs(spark, sf_dir).filter("source_type = 'local' AND doc_id % 4 = 1")
    body = F.to_json(F.struct(F.create_map(F.lit("vendor_name"), F.concat(F.lit("J"), "doc_id"), F.lit("units"), F.lit("3")).alias("fields")))
    parsed = F.from_json(body, T.TRUTH_JSON)
    js = runs.select("doc_id", F.explode(parsed["fields"]).alias("field_name", "truth_value"))
    return T.json_over_csv(js, truth(spark, sf_dir).select("doc_id", "field_name", "truth_value"))

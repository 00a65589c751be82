"""Configuration and source queries over raw rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import config as C
from ..sources import documents as D
from . import scenario
from .registry import query


def raw_types(spark, sf_dir):
    o = scenario.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return o.select(F.concat(F.lit(" T"), k, F.lit(" ")).alias("invoice_type_id"), F.concat("c_name", F.lit("  ")).alias("display_name"),
                    F.col("c_mktsegment").alias("description"), F.lit("ctx\n").alias("agent_context"), F.when(k % 4 == 0, "False").otherwise("TRUE").alias("enabled"))


def some_type(spark, sf_dir):
    """A type for each part: types are as many as customers, at every size."""
    types = scenario.read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    return F.concat(F.lit("T"), F.col("p_partkey") % types)


def raw_fields(spark, sf_dir):
    p = scenario.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("F"), k).alias("field_id"), some_type(spark, sf_dir).alias("invoice_type_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("field_name"),
                    F.col("p_name").alias("field_label"), F.lit("string").alias("data_type"), F.when(k % 3 == 0, "true").otherwise("no").alias("required"),
                    F.lit("hint").alias("extraction_hint"), F.lit("body").alias("page_region"), F.concat("p_brand", F.lit(", ,"), "p_type", F.lit(" ,")).alias("aliases"))


def raw_allowed(spark, sf_dir):
    p = scenario.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("field_name"),
                    F.when(k % 5 == 0, "").otherwise(some_type(spark, sf_dir)).alias("invoice_type_id"),
                    F.when(k % 20 == 0, " ").otherwise(F.col("p_brand")).alias("value"), k.alias("line_no"))
    return rows.groupBy("field_name", "invoice_type_id", "value").agg(F.min("line_no").alias("line_no"))


def raw_rules(spark, sf_dir):
    o = scenario.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("R_"), k).alias("rule_id"), F.concat(F.lit("T"), F.col("o_custkey")).alias("invoice_type_id"), F.col("o_orderpriority").alias("rule_name"),
                    F.lit("F1").alias("field_id"), F.lit("required").alias("check_type"), F.lit(None).cast("string").alias("check_value"),
                    F.when(k % 2 == 0, "error").otherwise("warning").alias("severity"), F.lit("h").alias("agent_hint"), F.lit("m").alias("error_message"), F.lit("").alias("page_region"),
                    F.when(k % 6 == 0, "FALSE").otherwise("true").alias("enabled"), F.when(k % 3 == 0, " Grants ").when(k % 3 == 1, " ").alias("rule_group"))


@query("load_doc_types")
def load_doc_types(spark, sf_dir):
    return C.clean_types(raw_types(spark, sf_dir))


@query("load_fields")
def load_fields(spark, sf_dir):
    rows = C.clean_fields(raw_fields(spark, sf_dir), C.clean_types(raw_types(spark, sf_dir)), C.clean_allowed_values(raw_allowed(spark, sf_dir)))
    return rows.select("field_id", "invoice_type_id", "required", F.array_join("aliases", "|").alias("aliases"), F.array_join("allowed_values", "|").alias("allowed_values"))


@query("load_allowed_values")
def load_allowed_values(spark, sf_dir):
    return C.clean_allowed_values(raw_allowed(spark, sf_dir)).withColumn("allowed_values", F.array_join("allowed_values", "|"))


@query("load_rules")
def load_rules(spark, sf_dir):
    return C.clean_rules(raw_rules(spark, sf_dir), C.clean_types(raw_types(spark, sf_dir))).select("rule_id", "invoice_type_id", "check_value", "severity", "rule_group")


@query("filter_rule_groups")
def filter_rule_groups(spark, sf_dir):
    rules = C.clean_rules(raw_rules(spark, sf_dir), C.clean_types(raw_types(spark, sf_dir)))
    return C.filter_rule_groups(rules, [" GRANTS", ""]).select("rule_id", "rule_group")


@query("rules_for_type")
def rules_for_type(spark, sf_dir):
    rules = C.clean_rules(raw_rules(spark, sf_dir), C.clean_types(raw_types(spark, sf_dir)))
    return C.for_type(rules, "T7").select("rule_id")


@query("rules_for_present_types")
def rules_for_present_types(spark, sf_dir):
    docs = scenario.read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("T"), "c_custkey").alias("invoice_type_id"))
    rules = C.clean_rules(raw_rules(spark, sf_dir), C.clean_types(raw_types(spark, sf_dir)))
    return C.for_present_types(rules, docs).select("rule_id", "invoice_type_id")


@query("extraction_schema")
def extraction_schema(spark, sf_dir):
    rows = C.clean_fields(raw_fields(spark, sf_dir), C.clean_types(raw_types(spark, sf_dir)), C.clean_allowed_values(raw_allowed(spark, sf_dir)))
    one = rows.groupBy("invoice_type_id", "field_name").agg(F.min_by(F.struct(*rows.columns), "field_id").alias("_r")).select("_r.*")
    schema = C.extraction_schema(one)
    names = F.array_join(F.array_sort(F.map_keys("schema")), "|")
    return schema.select("invoice_type_id", names.alias("names"), F.size(F.map_filter("schema", lambda k, v: v["required"])).alias("required"))


@query("load_denylist")
def load_denylist(spark, sf_dir):
    lines = scenario.read(spark, sf_dir, "conversations").select(F.explode(F.split(F.concat(F.col("role"), F.lit(" A\n# "), "turn", F.lit("\n \n"), "conv_id"), "\n")).alias("value"))
    return C.clean_denylist(lines)


def manifest(spark, sf_dir):
    o = scenario.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("id"), k)).alias("id"), F.concat(F.lit("Doc "), k, F.lit(".pdf")).alias("name"),
                    F.when(k % 5 == 0, "text/csv").otherwise("application/pdf").alias("mimeType"), F.when(k % 3 == 0, "n/a").otherwise((k * 10).cast("string")).alias("size"),
                    F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modifiedTime"), F.when(k % 2 == 0, F.md5(k.cast("string"))).alias("md5Checksum"),
                    F.when(k % 4 == 0, F.concat(F.lit("h"), k)).alias("headRevisionId"), F.concat(F.lit("https://v/"), k).alias("webViewLink"), (k % 7 == 0).alias("trashed"), F.lit("f").alias("folder"))


@query("scan_remote_manifest")
def scan_remote_manifest(spark, sf_dir):
    refs, _ = D.manifest_refs(manifest(spark, sf_dir))
    return refs.select("display_name", "uri", "source_id", "revision_id", "size_bytes", F.unix_seconds("modified_at").alias("modified"), F.try_element_at("metadata", F.lit("web_view_link")).alias("link"))


@query("manifest_rejects")
def manifest_rejects(spark, sf_dir):
    return D.manifest_refs(manifest(spark, sf_dir))[1].select("name")


@query("exclude_outputs")
def exclude_outputs(spark, sf_dir):
    pages = scenario.read(spark, sf_dir, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "/out/").when(F.col("page_id") % 3 == 1, "/output/").otherwise("/in/"), "page_id").alias("uri"))
    return D.exclude_outputs(pages, "/out")


def config_refs(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in (*C.REQUIRED_FILES, *C.OPTIONAL_FILES, "notes.md")])
    o = scenario.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("folder"), F.concat(F.lit(" "), F.upper(F.element_at(names, (1 + k % 7).cast("int")))).alias("display_name"),
                    F.concat(F.lit("id"), F.lpad(k.cast("string"), 9, "0")).alias("source_id"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")).alias("revision_id"))


@query("validate_config_set")
def validate_config_set(spark, sf_dir):
    v = C.validate_config_set(config_refs(spark, sf_dir))
    return v.select("folder", F.array_join("duplicates", "|").alias("duplicates"), F.array_join("missing", "|").alias("missing"))


@query("config_fingerprint")
def config_fingerprint(spark, sf_dir):
    return C.config_fingerprint(config_refs(spark, sf_dir))

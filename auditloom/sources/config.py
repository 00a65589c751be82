"""Configuration tables: document types, fields, rules, allowed values, denylist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blanks import squeeze, text_or_empty

# Files of a configuration set.
REQUIRED_FILES = ("compliance_rules.csv", "extraction_fields.csv", "invoice_types.csv")
OPTIONAL_FILES = ("allowed_values.csv", "employee_name_role_denylist.txt", "ground_truth.csv")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _trimmed(df: DataFrame, columns: Iterable[str]) -> list:
    return [squeeze(text_or_empty(F.col(c))).alias(c) for c in columns]


def _is_true(column: str):
    return F.lower(text_or_empty(F.col(column))) == "true"


def clean_types(raw: DataFrame) -> DataFrame:
    return raw.filter(_is_true("enabled")).select(*_trimmed(raw, ("invoice_type_id", "display_name", "description", "agent_context")))


def clean_allowed_values(raw: DataFrame) -> DataFrame:
    """(field, type) → values in file order; ``line_no`` gives the order."""
    rows = raw.select(*_trimmed(raw, ("field_name", "invoice_type_id", "value")), "line_no").filter("value <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    return rows.groupBy("field_name", "invoice_type_id").agg(F.transform(ordered, lambda v: v["value"]).alias("allowed_values"))


def clean_fields(raw: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Fields of enabled types, with aliases split and allowed values looked up."""
    rows = raw.select(*_trimmed(raw, ("field_id", "invoice_type_id", "field_name", "field_label", "data_type", "extraction_hint", "page_region")),
                      _is_true("required").alias("required"),
                      F.filter(F.transform(F.split(text_or_empty(F.col("aliases")), ","), lambda a: squeeze(a)), lambda a: a != "").alias("aliases"))
    rows = rows.join(types.select("invoice_type_id"), "invoice_type_id", "left_semi")
    own = allowed.filter("invoice_type_id <> ''").select("field_name", "invoice_type_id", F.col("allowed_values").alias("_own"))
    shared = allowed.filter("invoice_type_id = ''").select("field_name", F.col("allowed_values").alias("_any"))
    return rows.join(own, ["field_name", "invoice_type_id"], "left").join(shared, "field_name", "left").withColumn(
        "allowed_values", F.coalesce("_own", "_any", F.array().cast("array<string>"))).drop("_own", "_any")


def clean_rules(raw: DataFrame, types: DataFrame) -> DataFrame:
    columns = ("rule_id", "invoice_type_id", "rule_name", "field_id", "check_type", "check_value", "severity", "agent_hint", "error_message", "page_region")
    group = F.lower(squeeze(text_or_empty(F.col("rule_group"))))
    order = ["rule_order"] if "rule_order" in raw.columns else []
    rows = raw.filter(_is_true("enabled")).select(
        *_trimmed(raw, columns), F.coalesce(F.nullif(group, F.lit("")), F.lit("general")).alias("rule_group"), *order)
    return rows.join(types.select("invoice_type_id"), "invoice_type_id", "left_semi")


def clean_denylist(lines: DataFrame) -> DataFrame:
    text = squeeze(F.col("value"))
    return lines.select(F.lower(text).alias("phrase")).filter((F.col("phrase") != "") & ~F.col("phrase").startswith("#"))


def filter_rule_groups(rules: DataFrame, groups: Iterable[str] | None) -> DataFrame:
    wanted = sorted({g.strip().lower() for g in groups or () if g and g.strip()})
    return rules.filter(F.lower(F.trim("rule_group")).isin(wanted)) if wanted else rules


def for_type(table: DataFrame, invoice_type_id: str) -> DataFrame:
    return table.filter(F.col("invoice_type_id") == invoice_type_id)


def for_present_types(table: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of types that occur in the batch."""
    return table.join(documents.select("invoice_type_id").distinct(), "invoice_type_id", "left_semi")


def extraction_schema(fields: DataFrame) -> DataFrame:
    """Per type: field name → description struct."""
    entry = F.struct("field_id", F.col("data_type").alias("type"), F.col("field_label").alias("label"), "required",
                     F.col("extraction_hint").alias("hint"), F.col("page_region").alias("region"), "aliases",
                     F.when(F.size("allowed_values") > 0, F.col("allowed_values")).alias("enum"))
    return fields.groupBy("invoice_type_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", entry)))).alias("schema"))


def load_config(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All configuration tables of a folder; a missing allowed-values file is empty."""
    types = clean_types(read_csv(spark, f"{folder}/invoice_types.csv"))
    try:
        raw = read_csv(spark, f"{folder}/allowed_values.csv").withColumn("line_no", F.monotonically_increasing_id())
    except Exception as error:  # the path does not exist
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raw = spark.createDataFrame([], "field_name string, invoice_type_id string, value string, line_no bigint")
    allowed = clean_allowed_values(raw)
    rules = read_csv(spark, f"{folder}/compliance_rules.csv").withColumn("rule_order", F.monotonically_increasing_id())
    return {
        "types": types, "allowed_values": allowed, "rules": clean_rules(rules, types),
        "fields": clean_fields(read_csv(spark, f"{folder}/extraction_fields.csv"), types, allowed),
    }


def load_denylist(spark: SparkSession, path: str) -> DataFrame:
    return clean_denylist(spark.read.text(path))


def validate_config_set(refs: DataFrame, key: str = "folder") -> DataFrame:
    """Duplicate and missing configuration files per folder.

    At most a handful of known file names exist, so the lists are bounded.
    """
    name = F.lower(F.trim("display_name"))
    known = refs.select(key, name.alias("name")).filter(F.col("name").isin(*REQUIRED_FILES, *OPTIONAL_FILES))
    counted = known.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"))
    need = F.array(*[F.lit(n) for n in REQUIRED_FILES])
    per = counted.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("name")))).alias("duplicates"), F.collect_set("name").alias("_have"))
    folders = refs.select(key).distinct().join(per, key, "left")
    none = F.array().cast("array<string>")
    return folders.select(key, F.coalesce("duplicates", none).alias("duplicates"), F.array_except(need, F.coalesce("_have", none)).alias("missing"))


def config_fingerprint(refs: DataFrame, key: str = "folder") -> DataFrame:
    """Twelve hex digits over the sorted ``name:id:revision`` lines of a folder."""
    name = F.lower(F.trim("display_name"))
    revision = F.coalesce(F.nullif("revision_id", F.lit("")), F.lit("unknown"))
    rows = refs.filter(name.isin(*REQUIRED_FILES, *OPTIONAL_FILES)).select(
        key, name.alias("name"), F.concat_ws(":", name, "source_id", revision).alias("line"))
    one = rows.groupBy(key, "name").agg(F.min("line").alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("name", "line")))
    return one.groupBy(key).agg(F.substring(F.sha2(F.array_join(F.transform(lines, lambda v: v["line"]), "\n"), 256), 1, 12).alias("fingerprint"))

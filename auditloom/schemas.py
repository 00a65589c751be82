"""Table contracts: fixed column lists, vocabularies and labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

SCHEMA_VERSION = "1"

# Output columns, in order.
HIGH_VALUE_FIELDS = (
    "vendor_name", "vendor_vat_id", "invoice_number", "invoice_date", "currency", "gross_amount", "net_amount",
    "tax_amount",
)
INVOICE_SUMMARY = (
    "schema_version", "run_id", "invoice_id", "invoice_file", "pdf_path", "source_type", "source_id", "source_uri",
    "source_hash", "revision_id", "invoice_type_id", "agent_status", "review_status", "finish_reason", "turns_used",
    "fields_extracted", "fields_flagged", "rules_total", "rules_passed", "rules_failed_error",
    "rules_failed_warning", "error_failed_rule_ids", "warning_failed_rule_ids", *HIGH_VALUE_FIELDS,
)
COMPLIANCE_RESULTS = (
    "schema_version", "run_id", "invoice_id", "invoice_file", "source_type", "source_id", "source_hash",
    "invoice_type_id", "rule_id", "rule_name", "field_id", "status", "normalized_status", "severity", "message",
    "agent_notes", "source_page", "evidence_refs", "policy_refs",
)
REVIEWER_SUMMARY = (
    "invoice_file", "invoice_type", "review_status", "primary_action", "vendor_name", "vendor_vat_id",
    "invoice_number", "invoice_date", "currency", "gross_amount", "net_amount", "tax_amount",
    "missing_critical_fields", "contradictions", "blocking_rules", "warning_rules", "not_checked_count",
)
REVIEW_QUEUE = (
    "priority", "recommended_action", "decision", "reviewer", "notes", "resolved_date", "invoice_file",
    "invoice_type", "review_status", "blocking_rules", "warning_rules", "review_reasons",
    "missing_critical_fields", "contradictions", "source_page", "evidence_refs", "policy_summary", "source_url",
    "source_uri",
)
REVIEW_ISSUES = (
    "priority", "issue_type", "severity", "recommended_action", "decision", "notes", "resolved_date",
    "invoice_file", "invoice_type", "review_status", "field", "rule", "issue", "source_page", "evidence_refs",
    "policy_summary", "source_url", "source_uri",
)
DASHBOARD = ("section", "metric", "value", "count")
RULE_GUIDE = (
    "rule", "invoice_type", "severity", "field", "condition", "guidance", "failure_message", "passed", "failed",
    "warning", "flagged", "skipped", "unknown", "total_results",
)
RULE_GUIDE_ENTRIES = ("rule_id", "kind", "entry")
MATRIX_KEYS = ("invoice_file", "invoice_type", "review_status")
FIELD_TABLE = (
    "invoice_file", "invoice_type_id", "field_id", "field_name", "extracted_value", "confidence", "source_page",
    "source_region", "extraction_attempts", "flagged_for_review", "batch_review", "review_reason",
)
RULE_TABLE = (
    "invoice_file", "invoice_type_id", "rule_id", "rule_name", "field_id", "status", "severity", "message",
    "agent_notes",
)
RUN_SUMMARY = (
    "timestamp", "invoice_file", "pdf_path", "invoice_type_id", "agent_status", "turns_used", "finish_reason",
    "fields_extracted", "fields_flagged", "rules_total", "rules_passed", "rules_failed_error",
    "rules_failed_warning", "source_type", "source_id", "source_hash", "run_id",
)
BATCH_ACCURACY = (
    "filename", "invoice_type", "fields_total", "fields_exact", "fields_partial", "fields_wrong",
    "field_accuracy_pct", "exact_accuracy_pct",
)

# Workbook tables in order, with their header contracts.
WORKBOOK_TABLES = (
    ("Invoice Summary", REVIEWER_SUMMARY),
    ("Review", REVIEW_QUEUE),
    ("Review Issues", REVIEW_ISSUES),
    ("Dashboard", DASHBOARD),
    ("Compliance Matrix", None),
    ("Rule Guide", RULE_GUIDE),
    ("Rule Guide Entries", RULE_GUIDE_ENTRIES),
    ("Compliance Results", COMPLIANCE_RESULTS),
    ("Technical Run Data", INVOICE_SUMMARY),
)
WORKBOOK_FALLBACKS = {
    "Compliance Results": "canonical_compliance_results",
    "Technical Run Data": "canonical_invoice_summary",
}

# Status vocabularies and labels of missing fields.
CANONICAL_STATUSES = ("passed", "failed", "warning", "skipped", "flagged", "needs_review", "error", "unknown")
RESULT_STATUSES = ("passed", "failed", "warning", "flagged", "skipped", "unknown")
ACTION_STATUSES = ("failed", "flagged", "warning", "unknown")
ATTENTION_STATUSES = ("needs_review", "warning", "failed", "error", "unknown")
MISSING_LABELS = {
    "vendor_name": "Vendor name", "vendor_vat_id": "Vendor VAT ID", "invoice_number": "Invoice number",
    "invoice_date": "Invoice date", "currency": "Currency", "gross_amount": "Gross amount",
    "net_amount": "Net amount", "tax_amount": "Tax amount",
}


def workbook_filename(table: str) -> str:
    return table.lower().replace(" ", "_")


def require_keys(df: DataFrame, keys: Iterable[str], label: str) -> None:
    """Fail fast when a table lacks a column."""
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError(f"{label}: missing required key(s) {', '.join(absent)}; columns are {df.columns}")

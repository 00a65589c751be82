"""The whole chain from raw attempts to canonical tables, at once and by batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import evidence as E
from ..session import shared_folder
from . import audit as A
from . import canonical as C
from . import queries_evidence as QE
from . import scenario
from . import views as V
from .registry import query


def inputs(spark, sf_dir) -> A.Inputs:
    k = F.col("doc_id")
    updates = F.create_map(
        F.lit("currency"), F.when(k % 2 == 0, "EUR").otherwise("<i> </i>"), F.lit(" vendor_name "), F.concat(F.lit("Seller "), "rule_id"))
    return A.Inputs(
        runs=scenario.runs(spark, sf_dir), fields=scenario.fields(spark), rules=scenario.rules(spark),
        verdicts=scenario.visual_verdicts(spark, sf_dir).withColumn("field_updates", updates),
        support=E.payment_evidence(QE.links(spark, sf_dir)), learnings=scenario.learning_lines(spark, sf_dir))


def at_once(spark, sf_dir):
    """The whole chain; summaries, fields and verdicts are stored, as many steps read each of them."""
    given, folder = inputs(spark, sf_dir), shared_folder(spark, "audit")

    def keep(name, rows):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return A.audit(A.summaries(scenario.raw_attempts(spark, sf_dir), given), given, keep)


def by_batches(spark, sf_dir) -> A.AuditStore:
    """Both batches through a new store; the second touches a third of the documents."""
    store, given = A.AuditStore(spark, shared_folder(spark, "audit")), inputs(spark, sf_dir)
    attempts = scenario.raw_attempts(spark, sf_dir)
    for batch in (1, 2):
        store.apply(batch, attempts.where(F.col("batch") == batch), given)
    return store


@query("audit_pipeline")
def audit_pipeline(spark, sf_dir):
    return C.stringify_all(at_once(spark, sf_dir)["invoices"].select(*S.INVOICE_SUMMARY))


@query("audit_results")
def audit_results(spark, sf_dir):
    return C.stringify_all(at_once(spark, sf_dir)["results"].select(*[c for c in S.COMPLIANCE_RESULTS if c != "policy_refs"]))


@query("audit_pipeline_batches")
def audit_pipeline_batches(spark, sf_dir):
    return C.stringify_all(by_batches(spark, sf_dir).current("invoices").select(*S.INVOICE_SUMMARY))


@query("audit_counts")
def audit_counts(spark, sf_dir):
    """Counting views after two batches, from signed deltas alone."""
    return by_batches(spark, sf_dir).counts()


@query("audit_dashboard")
def audit_dashboard(spark, sf_dir):
    """The dashboard after two batches, from signed counts alone."""
    return by_batches(spark, sf_dir).dashboard()


@query("audit_review_queue")
def audit_review_queue(spark, sf_dir):
    return V.review_queue(by_batches(spark, sf_dir).current("facts")).drop("policy_summary")


@query("audit_review_issues")
def audit_review_issues(spark, sf_dir):
    return by_batches(spark, sf_dir).workbook(scenario.rules(spark))["Review Issues"].drop("policy_summary")


@query("audit_matrix")
def audit_matrix(spark, sf_dir):
    wide = by_batches(spark, sf_dir).workbook(scenario.rules(spark))["Compliance Matrix"]
    return wide.toDF(*[c.lower().replace(" - ", "_").replace(" ", "_") for c in wide.columns])

"""Claim-ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as K
from . import scenario
from .registry import query

NOW = 100000.0


def refs(spark, sf_dir):
    d = scenario.documents(spark, sf_dir)
    k = F.col("doc_id")
    return d.select(F.concat(F.lit("s"), k).alias("source_id"), F.concat(F.lit("file:///"), k).alias("uri"),
                    (F.col("o_custkey") % 3).cast("string").alias("revision_id"), F.col("invoice_file").alias("display_name"))


def ledger(spark, sf_dir):
    """Earlier ledger: most documents, in every state; some at another revision."""
    d = scenario.documents(spark, sf_dir).filter("o_custkey % 7 <> 6")
    k, c = F.col("doc_id"), F.col("o_custkey")
    states = F.array(*[F.lit(s) for s in ("done", "failed", "processing", "needs_attention", "legacy", "processing")])
    revision = F.when(k % 13 == 0, "old").otherwise((c % 3).cast("string"))
    return d.select(F.concat(F.lit("s"), k, F.lit("#"), revision).alias("key"), F.element_at(states, (1 + c % 6).cast("int")).alias("status"),
                    (c % 5).cast("int").alias("attempts"), (F.lit(96500.0) + k % 3500).alias("claimed_at"), F.lit(1.0).alias("updated_at"),
                    (1 + c % 4).cast("int").alias("version"), F.lit("r0").alias("run_id"), F.lit(False).alias("needs_review"),
                    F.lit("").alias("last_error"), F.col("invoice_file").alias("display_name"))


def decided(spark, sf_dir):
    return K.decide_claims(K.keyed_refs(refs(spark, sf_dir)), ledger(spark, sf_dir), F.lit(NOW))


def changes(spark, sf_dir):
    return K.apply_claims(decided(spark, sf_dir), F.lit("r1"), F.lit(NOW))


def terminal(spark, sf_dir):
    claimed = changes(spark, sf_dir).filter("status = 'processing'")
    n = F.length("key")
    num = F.regexp_extract("key", r"^s(\d+)#", 1).cast("bigint")
    outcomes = claimed.filter(num % 10 != 0).select("key", (num % 4 == 0).alias("needs_review"),
                                                  F.when(num % 5 == 1, F.concat(F.lit("boom "), n)).alias("error"))
    return K.mark_outcomes(claimed, outcomes, F.lit("r1"))


@query("decide_claim")
def decide_claim(spark, sf_dir):
    return decided(spark, sf_dir).select("key", "reason", "claimable")


@query("apply_claim")
def apply_claim(spark, sf_dir):
    return changes(spark, sf_dir).select("key", "status", "attempts", "claimed_at", "updated_at", "version", "run_id")


@query("mark_outcomes")
def mark_outcomes(spark, sf_dir):
    return terminal(spark, sf_dir).select("key", "status", "attempts", "version", "needs_review", "last_error")


@query("ledger_upsert")
def ledger_upsert(spark, sf_dir):
    after = K.upsert(K.upsert(ledger(spark, sf_dir), changes(spark, sf_dir)), terminal(spark, sf_dir))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.sum("attempts").alias("attempts"), F.sum("version").alias("versions"))


@query("ledger_latest")
def ledger_latest(spark, sf_dir):
    """Current rows of the append-only log: earlier state, claims, outcomes."""
    log = ledger(spark, sf_dir).unionByName(changes(spark, sf_dir)).unionByName(terminal(spark, sf_dir))
    return K.latest(log).select("key", "status", "version", "run_id")


@query("poll_summary")
def poll_summary(spark, sf_dir):
    return K.poll_summary(decided(spark, sf_dir), terminal(spark, sf_dir))


@query("poll_candidates")
def poll_candidates(spark, sf_dir):
    return K.poll_candidates(refs(spark, sf_dir)).select("source_id", "display_name")


@query("unseen_revisions")
def unseen_revisions(spark, sf_dir):
    return K.unseen_revisions(refs(spark, sf_dir), ledger(spark, sf_dir)).select("key")

"""The polling loop as a Structured Streaming job over listing manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import ledger as K

Processor = Callable[[DataFrame], DataFrame]
"""Claimed keys in; one row per processed key out (key, needs_review, error)."""


def each_document(work: Callable[[dict], bool]) -> Processor:
    """A processor from a function of one claimed row (true: needs review).

    An exception fails its own document only and becomes the error of its outcome.
    """

    def one(row: dict) -> dict:
        try:
            return {"key": row["key"], "needs_review": bool(work(row)), "error": None}
        except Exception as error:  # noqa: BLE001 - recorded with the document
            return {"key": row["key"], "needs_review": False, "error": f"{type(error).__name__}: {error}"}

    kinds = pa.schema([("key", pa.string()), ("needs_review", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(row) for row in batch.to_pylist()], kinds)

    return lambda claimed: claimed.mapInArrow(run, "key string, needs_review boolean, error string")


def read_log(spark: SparkSession, path: str, before_batch: int) -> DataFrame:
    """Ledger rows written by earlier batches (a repeated batch ignores its own)."""
    try:
        log = spark.read.schema(f"{K.LEDGER_SCHEMA}, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{K.LEDGER_SCHEMA}, batch bigint")
    return log.filter(F.col("batch") < before_batch)


def run_poll(
    spark: SparkSession, refs: DataFrame, ledger_path: str, process: Processor, now: float, batch_id: int,
    run_id: str, max_files: int | None = K.MAX_FILES_PER_POLL, max_attempts: int = K.MAX_ATTEMPTS,
    stale_seconds: int = K.STALE_SECONDS, from_ledger: bool = False,
) -> DataFrame:
    """One poll: claim, process, record; returns the summary.

    The ledger is an append-only log partitioned by batch.  A batch rewrites
    only its own partition, so a replayed batch leaves the log unchanged.  One
    poll at a time writes a ledger; batch ids only grow.

    ``refs`` is a whole listing, of which the first ``max_files`` are tried.
    With ``from_ledger`` it holds new files only: each is recorded, and the poll
    draws from all open keys, so what lies beyond the cap, failed or went stale
    comes up again without being listed.
    """
    when, who = F.lit(float(now)), F.lit(run_id)
    listed = K.keyed_refs(refs)
    log = read_log(spark, ledger_path, batch_id).drop("batch")
    if from_ledger:
        held = K.latest(log)
        waiting = held.filter(F.col("status").isin(*K.OPEN)).select("key", "display_name")
        listed = listed.unionByName(waiting).groupBy("key").agg(F.min("display_name").alias("display_name"))
        decided = K.decide_claims(listed, held, when, max_attempts, stale_seconds)
        tried = decided
        if max_files is not None:
            ahead = decided.filter("claimable").orderBy(F.lower("display_name"), "key").limit(max_files)
            tried = ahead.unionByName(decided.filter("NOT claimable"))
        others = decided.join(tried.select("key"), "key", "left_anti")
        changes = K.apply_claims(tried, who, when).unionByName(K.pending_rows(others, who, when))
    else:
        tried = K.keyed_refs(refs if max_files is None else K.poll_candidates(refs, max_files))
        held = K.latest(log.join(tried.select("key"), "key", "left_semi"))
        tried = K.decide_claims(tried, held, when, max_attempts, stale_seconds)
        changes = K.apply_claims(tried, who, when)

    def record(rows: DataFrame, step: str) -> DataFrame:
        target = f"{ledger_path}/batch={batch_id}/step={step}"
        rows.write.mode("overwrite").parquet(target)
        return spark.read.schema(K.LEDGER_SCHEMA).parquet(target)

    # Claims are durable before any work starts: a crash leaves them to go stale.
    written = record(changes, "claim")
    claimed = written.filter("status = 'processing'")
    try:
        terminal = record(K.mark_outcomes(claimed, process(claimed), who, max_attempts), "done")
    except Exception as error:  # noqa: BLE001 - the work as a whole failed: each claim gets the error and its retries
        outcomes = claimed.select("key", F.lit(False).alias("needs_review"), F.lit(f"{type(error).__name__}: {error}").alias("error"))
        terminal = record(K.mark_outcomes(claimed, outcomes, who, max_attempts), "done")
    ends = claimed.select("key", F.lit(True).alias("claimable"))
    seen = tried.select("key", F.lit(False).alias("_tried")).join(ends, "key", "left").select("key", F.coalesce("claimable", "_tried").alias("claimable"))
    return K.poll_summary(listed.select("key").join(seen, "key", "left"), terminal)


def stream_polls(
    manifests: DataFrame, ledger_path: str, checkpoint: str, process: Processor, clock: Callable[[], float],
    on_summary: Callable[[int, DataFrame], None] | None = None, max_files: int | None = None, **limits,
):
    """Run a poll per micro-batch of newly listed documents, then stop.

    The source bounds the intake (``maxFilesPerTrigger``); no listed document is lost to a cap.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        summary = run_poll(batch.sparkSession, batch, ledger_path, process, clock(), batch_id, f"poll-{batch_id}",
                           max_files=max_files, from_ledger=True, **limits)
        if on_summary is not None:
            on_summary(batch_id, summary)

    return (
        manifests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

"""Keyed state for continuously arriving documents and logs.

Both processors keep one small record per key.  Rows of a key reach its state in
the order of their ``seq`` within each micro-batch; the batch forms in
``operators.runlog`` and ``operators.ledger`` give the same answers and serve as
their tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import MAX_ATTEMPTS, STALE_SECONDS
from ..operators.runlog import EXEMPT_TOOL, MAX_FAILURES, STOP_REPEATS, WARN_REPEATS

GUARD_OUTPUT = "run_id bigint, seq bigint, streak bigint, signal string, cumulative_tokens bigint"
CLAIM_OUTPUT = "key string, seq bigint, reason string, claimable boolean, status string, attempts int, version int"


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator:
    """A key's events of one micro-batch in the order of ``seq``, whatever Arrow batches they came in.

    They are held together; ``maxFilesPerTrigger`` of the source bounds them.
    """
    return pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples()


class GuardProcessor(StatefulProcessor):
    """Repeat streak and token total of a run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("guard", "sig string, streak bigint, tokens bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sig, streak, tokens = self._state.get() if self._state.exists() else ("", 0, 0)
        out = []
        for row in _in_order(rows):
            tokens += int(row.tokens)
            signal = None
            if row.tool == EXEMPT_TOOL:
                streak = 0
            else:
                streak = streak + 1 if row.signature == sig else 0
                sig = row.signature
                signal = "stop" if streak >= STOP_REPEATS else "warn" if streak >= WARN_REPEATS else None
            out.append((key[0], int(row.seq), streak, signal, tokens))
        yield pd.DataFrame(out, columns=["run_id", "seq", "streak", "signal", "cumulative_tokens"])
        self._state.update((sig, streak, tokens))

    def close(self) -> None:
        pass


class ClaimProcessor(StatefulProcessor):
    """Claim, done and fail events of a document revision against its state.

    ``now`` travels with every event, so replays decide the same way.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("claim", "status string, attempts int, claimed_at double, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._state.get() if self._state.exists() else None
        out = []
        for row in _in_order(rows):
            held, reason, claimable = _step(held, row.action, float(row.now))
            out.append((key[0], int(row.seq), reason, claimable, held[0], held[1], held[3]))
        yield pd.DataFrame(out, columns=["key", "seq", "reason", "claimable", "status", "attempts", "version"])
        if held is not None:
            self._state.update(held)

    def close(self) -> None:
        pass


def _step(held, action: str, now: float):
    """(new state, reason, claimable) of one event."""
    status, attempts, claimed_at, version = held or (None, 0, 0.0, 0)
    if action != "claim":
        attempts = attempts or 1
        end = "done" if action == "done" else "needs_attention" if attempts >= MAX_ATTEMPTS else "failed"
        return (end, attempts, 0.0, version + 1), action, False
    spent = attempts >= MAX_ATTEMPTS
    if status == "processing":
        fresh = now - claimed_at <= STALE_SECONDS
        reason = "in_progress" if fresh else "stale_exhausted" if spent else "reclaim_stale"
    else:
        reason = {None: "new", "done": "already_done", "needs_attention": "parked",
                  "failed": "exhausted" if spent else "retry"}.get(status, "unknown_reset")
    if reason in ("new", "retry", "reclaim_stale", "unknown_reset"):
        return ("processing", attempts + 1, now, version + 1), reason, True
    if reason == "stale_exhausted":
        return ("needs_attention", attempts, claimed_at, version + 1), reason, False
    return held, reason, False


def guard_stream(log: DataFrame) -> DataFrame:
    """Streaming form of the run-log guards; needs run_id, seq, tool, signature, tokens."""
    return log.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=GuardProcessor(), outputStructType=GUARD_OUTPUT, outputMode="Append", timeMode="None"
    )


def claim_stream(events: DataFrame) -> DataFrame:
    """Streaming form of the claim ledger; needs key, seq, action and now."""
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ClaimProcessor(), outputStructType=CLAIM_OUTPUT, outputMode="Append", timeMode="None"
    )


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

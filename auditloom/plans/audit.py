"""The audit as one chain, and the same chain kept up to date batch by batch.

``audit`` takes merge summaries of the extraction attempts all the way to the canonical tables: held values,
backfill from passed visual checks, rule checks on typed values, visual verdicts, evidence slots and
policy references, the run's final status, both canonical tables.

``AuditStore`` keeps what a batch of attempts changes. State and canonical rows are tables partitioned
by batch; the rows of a document are those of the last batch that touched it. A batch reads the stored
summaries of its own documents only, evaluates the rules for these alone, and writes

* ``state``: their merge summaries, whole,
* ``fields`` and ``verdicts``: held values, and rule verdicts with evidence and policy,
* ``invoices`` and ``results``: their canonical rows, both derived from the written verdicts,
* ``facts`` and ``cells``: what the review views say about each document, and what the dashboard counts of it,
* ``deltas`` and ``dashboard``: signed counts, +1 for each cell of a new row and -1 for each of the row it replaces.

Counting views are sums of deltas and never read documents again. The other review views are read from the
facts and canonical rows in force (``workbook``), so no view runs a rule. Writing a batch anew replaces what it
wrote before and reads only earlier batches, so a repeated batch changes nothing. Batches count from 1
and the folder must be one that all executors share.

Defined results: attempts of documents without a run, or of fields outside the document's schema, are
left out; a document with a run and no attempt ever has no rows until its first one; an empty batch
writes empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import float_text
from ..operators import evidence as E
from ..operators import extraction as X
from ..operators import merge_state as M
from ..operators import rules as R
from ..operators.scale import grown, join_inside
from .. import schemas as S
from . import canonical as C
from . import views as V

KEYS = ("doc_id", "field_name")
Keep = Callable[[str, DataFrame], DataFrame]
PAYLOAD = ("value_text", "value_num", "source_page", "source_region")


@dataclass(frozen=True)
class Inputs:
    """Everything beside the attempts. ``runs`` has a row per document: its identity and type."""

    runs: DataFrame
    fields: DataFrame
    rules: DataFrame
    verdicts: DataFrame
    support: DataFrame
    learnings: DataFrame


def summaries(attempts: DataFrame, inputs: Inputs, chunk_span: int = M.CHUNK_ROWS) -> DataFrame:
    """Merge summary per (document, field) of raw attempts, typed and cleaned first."""
    typed = X.coerce_attempts(attempts.join(grown(inputs.runs.select("doc_id", "invoice_type_id")), "doc_id"), inputs.fields)
    typed = typed.withColumn("value_text", F.coalesce(float_text(F.col("value_num")), "value_text"))
    return M.attempt_summaries(typed, KEYS, payload=PAYLOAD, chunk_span=chunk_span)


def held_fields(state: DataFrame, inputs: Inputs) -> DataFrame:
    """Field results after the merge and the backfill from passed visual checks."""
    held = M.resolved(state).withColumn("batch_review", F.col("has_value") & X.in_batch_band(F.col("confidence"))).drop("has_value")
    schema = inputs.fields.select("invoice_type_id", "field_name", "field_id")
    rows = held.join(grown(inputs.runs.select("doc_id", "invoice_type_id")), "doc_id").join(F.broadcast(schema), ["invoice_type_id", "field_name"])
    rows = rows.withColumns({"flagged_for_review": F.lit(False), "review_reason": F.lit(None).cast("string")})
    types = inputs.runs.select("doc_id", F.col("invoice_type_id").alias("_type"))
    told = inputs.verdicts.join(grown(state.select("doc_id").distinct()), "doc_id", "left_semi").join(grown(types), "doc_id")
    filled = X.backfill_fields(rows.withColumn("_type", F.col("invoice_type_id")), told, inputs.fields, more=("_type",))
    return filled.withColumns({
        "invoice_type_id": F.col("_type"), "value_num": F.when(~F.col("backfilled"), F.col("value_num")),
        "batch_review": F.coalesce("batch_review", F.lit(False)),
    }).drop("_type", "backfilled")


def policies(inputs: Inputs) -> DataFrame:
    """Policy references of each rule in rank order, as JSON texts."""
    refs = E.policy_refs(inputs.rules, inputs.learnings)
    cell = F.to_json(F.struct("source", "snippet_id", "snippet"))
    listed = refs.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("rank", cell.alias("text")))).alias("_refs"))
    return listed.select("rule_id", F.array_join(F.transform("_refs", lambda r: r["text"]), "; ").alias("policy_refs"))


def verdicts_of(fields: DataFrame, inputs: Inputs, docs: DataFrame) -> DataFrame:
    """Verdicts of ``docs`` on their field results, with evidence slots, rule states and policy references."""
    known = inputs.runs.select("doc_id", "invoice_type_id").join(grown(docs), "doc_id", "left_semi")
    verdicts = R.merge_visual_verdicts(R.evaluate_rules(known, fields, inputs.rules, inputs.fields), inputs.verdicts)
    slots = E.evidence_slots(verdicts, inputs.rules, inputs.support).join(F.broadcast(policies(inputs)), "rule_id", "left")
    return slots.withColumn("rule_state", R.rule_state(F.col("status"), F.coalesce("policy_refs", F.lit("")) != ""))


def checked(state: DataFrame, inputs: Inputs, keep: Keep = lambda _, rows: rows) -> tuple[DataFrame, DataFrame]:
    """Field results, and verdicts with their evidence slots, rule states and policy references.

    ``keep`` (name, rows) may store a table that several steps read and return it as read back.
    """
    fields = keep("fields", held_fields(state, inputs))
    return fields, keep("verdicts", verdicts_of(fields, inputs, state.select("doc_id").distinct()))


def canonical(fields: DataFrame, verdicts: DataFrame, inputs: Inputs) -> dict[str, DataFrame]:
    """Both canonical tables of the documents in ``fields``, with ``doc_id``.

    Fields go by document once; what is gathered by document and field, and joined by document, follows in place.
    """
    fields = fields.repartition("doc_id")
    docs = inputs.runs.join(grown(fields.select("doc_id").distinct()), "doc_id", "left_semi")
    status = R.finish_status(verdicts, fields, docs).select("doc_id", F.col("status").alias("agent_status"), "finished")
    runs = docs.drop("agent_status", "finish_reason").join(grown(status), "doc_id").withColumn(
        "finish_reason", F.when(F.col("finished"), F.lit("completed")).otherwise("")).drop("finished")
    seen = F.when(F.col("source_page").isNotNull(), F.concat_ws(":", F.concat(F.lit("p"), "source_page"), "source_region"))
    shown = fields.groupBy("doc_id", "field_id").agg(F.min_by(seen, "field_name").alias("evidence_refs"))
    # Policy texts are the rule's: they are met again rather than carried with every verdict.
    evidence = join_inside(verdicts.select("doc_id", "rule_id", "field_id"), shown, "doc_id", ["field_id"])
    evidence = evidence.join(F.broadcast(policies(inputs)), "rule_id", "left")
    results = C.canonical_compliance_results(docs, verdicts.drop("policy_refs"), fields, evidence, ("doc_id",))
    return {"invoices": C.canonical_invoice_summary(runs, fields, verdicts, ("doc_id",)), "results": results}


def audit(state: DataFrame, inputs: Inputs, keep: Keep = lambda _, rows: rows) -> dict[str, DataFrame]:
    """Canonical tables of all documents in ``state``, without a store; in one plan, unless ``keep`` stores what many steps read."""
    return canonical(*checked(keep("state", state), inputs, keep), inputs)


# -- signed counts ------------------------------------------------------------

def _cells(table: str, rows: DataFrame) -> DataFrame:
    """Countable cells (section, metric, value) of canonical rows."""
    status = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("unknown")) if table == "invoices" else None

    def cell(section: str, metric: Column | str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.alias("value"))

    picked = (
        [cell("Invoice review", "Review status", status), cell("Run status", "Agent status", F.col("agent_status")),
         cell("Documents", F.col("invoice_type_id"), status)]
        if table == "invoices" else
        [cell("Compliance status", "Rule results", F.col("normalized_status")), cell("Rule results", F.col("rule_id"), F.col("normalized_status"))]
    )
    return rows.select(F.explode(F.array(*picked)).alias("_c")).select("_c.*")


def _signed(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Cells that came (+1) and went (-1), summed; zeros are left out."""
    both = new.withColumn("sign", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("sign", F.lit(-1)))
    return both.groupBy("section", "metric", "value").agg(F.sum("sign").alias("delta")).where("delta <> 0")


def signed_counts(new: dict[str, DataFrame], old: dict[str, DataFrame] | None) -> DataFrame:
    """(section, metric, value, delta): +1 for each cell that came, -1 for each that went; zeros are left out."""

    def all_cells(tables: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [_cells(name, rows) for name, rows in tables.items()])

    return _signed(all_cells(new), all_cells(old) if old else None)


def review_facts(tables: dict[str, DataFrame], fields: DataFrame, inputs: Inputs) -> DataFrame:
    """Facts of the review views, a row per document."""
    enriched = C.enrich_invoices(tables["invoices"], inputs.runs, fields)
    return V.invoice_facts(enriched, tables["results"], V.rule_labels(V.rule_sources(inputs.rules)))


class AuditStore:
    """Tables of an audit that grows by batches of attempts, under one shared folder."""

    CANONICAL = ("invoices", "results")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={int(batch)}"

    def _write(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        path = self._path(table, batch)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def log(self, table: str, before: int | None = None) -> DataFrame:
        """All rows ever written (before a batch), with their ``batch``; other batches' files are not read."""
        rows = self.spark.read.parquet(f"{self.folder}/{table}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def current(self, table: str, before: int | None = None, docs: DataFrame | None = None) -> DataFrame:
        """The rows in force: of each document those of the last batch that touched it."""
        rows = self.log(table, before)
        if docs is not None:
            rows = rows.join(grown(docs), "doc_id", "left_semi")
        last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return join_inside(rows, last, "doc_id", ["batch"], "left_semi").drop("batch")

    def apply(self, batch: int, attempts: DataFrame, inputs: Inputs, chunk_span: int = M.CHUNK_ROWS) -> dict[str, DataFrame]:
        """Fold a batch of attempts in; returns what it wrote. Batch 1 starts the store."""
        if batch < 1:
            raise ValueError("batches count from 1")
        # The fresh summaries decide which documents change; written once, since all below depends on them. Those of
        # the first batch are its state.
        fresh = self._write("arrivals" if batch > 1 else "state", batch, summaries(attempts, inputs, chunk_span))
        docs = fresh.select("doc_id").distinct()
        state = self._write("state", batch, M.append(self.current("state", batch, docs), fresh, KEYS)) if batch > 1 else fresh
        # Each is made of what was written before it, and the rule engine runs once.
        fields, verdicts = checked(state, inputs, lambda name, rows: self._write(name, batch, rows))
        tables = {name: self._write(name, batch, rows) for name, rows in canonical(fields, verdicts, inputs).items()}
        gone = {name: self.current(name, batch, docs) for name in self.CANONICAL} if batch > 1 else None
        deltas = self._write("deltas", batch, signed_counts(tables, gone))
        facts = self._write("facts", batch, review_facts(tables, fields, inputs))
        cells = V.dashboard_cells(facts, tables["results"], V.rule_labels(V.rule_sources(inputs.rules)), ("doc_id",))
        cells = self._write("cells", batch, cells)
        went = self.current("cells", batch, docs).drop("doc_id") if batch > 1 else None
        dashboard = self._write("dashboard", batch, _signed(cells.drop("doc_id"), went))
        return {**tables, "fields": fields, "verdicts": verdicts, "state": state, "deltas": deltas, "facts": facts, "dashboard": dashboard}

    def counts(self) -> DataFrame:
        """Counting views as they stand: sums of signed deltas, one small row per cell and batch."""
        return self._summed("deltas")

    def _summed(self, table: str) -> DataFrame:
        return self.log(table).groupBy("section", "metric", "value").agg(F.sum("delta").alias("count")).where("count <> 0")

    def dashboard(self) -> DataFrame:
        """The dashboard from signed counts: no document, verdict or rule is read."""
        return V.dashboard_table(self._summed("dashboard"))

    def workbook(self, rules: DataFrame) -> dict[str, DataFrame]:
        """All tables of the workbook from what is stored; observed rules come from the counts."""
        seen = self.counts().where("section = 'Rule results' and metric <> ''").select(F.col("metric").alias("rule_id")).distinct()
        tables = {name: self.current(name) for name in self.CANONICAL}
        return V.workbook_tables(
            tables["invoices"].select(*S.INVOICE_SUMMARY), tables["results"].select(*S.COMPLIANCE_RESULTS), self.current("facts"),
            V.rule_sources(rules), self._summed("dashboard"), seen)


def recount(tables: dict[str, DataFrame]) -> DataFrame:
    """The same counts from whole canonical tables."""
    return signed_counts({name: tables[name] for name in AuditStore.CANONICAL}, None).withColumnRenamed("delta", "count")

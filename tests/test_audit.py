"""The chain at once, by batches and by repeated batches."""

import pytest
from pyspark.sql import functions as F

from auditloom import schemas as S
from auditloom.plans import audit as A
from auditloom.plans import queries_audit, scenario
from auditloom.plans import views as V


@pytest.fixture(scope="module")
def given(spark, small_dir):
    return queries_audit.inputs(spark, small_dir)


@pytest.fixture(scope="module")
def attempts(spark, small_dir):
    return scenario.raw_attempts(spark, small_dir).cache()


def rows(frame, columns):
    return sorted(map(str, frame.select(*columns).collect()))


@pytest.fixture(scope="module")
def whole(given, attempts):
    return {name: rows.cache() for name, rows in A.audit(A.summaries(attempts, given), given).items()}


def test_batches_equal_one_run_and_touch_only_their_documents(spark, given, attempts, whole, tmp_path):
    store = A.AuditStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.apply(0, attempts, given)
    store.apply(1, attempts.where("batch = 1"), given)
    first = rows(store.current("invoices"), S.INVOICE_SUMMARY)
    for _ in range(2):  # a repeated batch changes nothing
        wrote = store.apply(2, attempts.where("batch = 2"), given)
        assert rows(store.current("invoices"), S.INVOICE_SUMMARY) == rows(whole["invoices"], S.INVOICE_SUMMARY) != first
        assert rows(store.current("results"), S.COMPLIANCE_RESULTS) == rows(whole["results"], S.COMPLIANCE_RESULTS)
        assert wrote["state"].where("doc_id % 3 <> 0").isEmpty() and wrote["results"].where("doc_id % 3 <> 0").isEmpty()
        assert {tuple(r) for r in store.counts().collect()} == {tuple(r) for r in A.recount(whole).collect()}
    book = store.workbook(given.rules)
    assert list(book) and set(book) == {n for n, _ in S.WORKBOOK_TABLES}
    # the facts again, from whole tables and without the store
    fields, _ = A.checked(A.summaries(attempts, given), given)
    facts = A.review_facts(whole, fields, given).cache()
    again = V.workbook_tables(
        whole["invoices"].select(*S.INVOICE_SUMMARY), whole["results"].select(*S.COMPLIANCE_RESULTS), facts, V.rule_sources(given.rules))
    for name, table in again.items():
        assert book[name].columns == table.columns and rows(book[name], table.columns) == rows(table, table.columns), name
    assert rows(store.dashboard(), S.DASHBOARD) == rows(again["Dashboard"], S.DASHBOARD)
    assert "/dashboard/" in str(store.dashboard().inputFiles()) and "/facts/" not in str(store.dashboard().inputFiles())


def test_typed_values_reach_the_tables(whole):
    amounts = [r[0] for r in whole["invoices"].select("net_amount").where("net_amount <> ''").collect()]
    assert amounts and all("," not in a and "<" not in a and float(a) >= 0 for a in amounts)
    assert all(r[0].startswith('{"source":') for r in whole["results"].select("policy_refs").distinct().collect())


def test_signed_counts_cancel_out(whole):
    less = {name: t.where(F.col("doc_id") > 40) for name, t in whole.items()}
    assert A.signed_counts(less, less).isEmpty()
    assert all(r["delta"] < 0 for r in A.signed_counts(less, whole).collect())

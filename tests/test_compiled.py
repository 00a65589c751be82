"""Code that the JVM compiles, work done once, and rows that stay on their page, document or invoice."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from auditloom import schemas as S
from auditloom.operators import extraction as X
from auditloom.operators import layout as L
from auditloom.operators import rules as R
from auditloom.operators.scale import join_inside, ordered
from auditloom.plans import audit as A
from auditloom.plans import canonical as C
from auditloom.plans import scenario
from auditloom.plans import views as V

#: Bytes of a method up to which the JVM compiles it.
COMPILED = 8000


@pytest.fixture()
def static(spark):
    """Plans as they are before adaptive execution, so that their code can be generated without running them."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _longest(spark, df) -> int:
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def _invoices(spark):
    cells = {**{c: F.lit("") for c in S.INVOICE_SUMMARY}, "invoice_id": F.concat(F.lit("i"), "id"), "invoice_type_id": F.lit("VIAJES"),
             "invoice_file": F.concat(F.lit("f"), "id"), "review_status": F.lit("failed"), "currency": F.lit("EUR")}
    return spark.range(2).select(*[v.alias(c) for c, v in cells.items()])


def _results(spark):
    rows = spark.createDataFrame(
        [("i0", "R_VIA_005", "Currency rule", "failed", "currency missing", "error", "supplier quotation"),
         ("i0", "R_VIA_001", "Vendor rule", "failed", "", "warning", ""), ("i0", "R_VIA_003", "Rate rule", "passed", "OK", "error", ""),
         ("i9", "R_VIA_001", "Vendor rule", "odd", "x", "error", "")],
        "invoice_id string, rule_id string, rule_name string, status string, message string, severity string, agent_notes string")
    cells = {**{c: F.lit("") for c in S.COMPLIANCE_RESULTS if c not in rows.columns},
             "normalized_status": C.normalize_rule_status(F.col("status"), F.col("severity"))}
    return rows.withColumns(cells)


def test_fields_and_attempts_are_made_by_compiled_code(spark, static, tmp_path):
    spark.createDataFrame([(k, 34 * k, "F", "1-URGENT", datetime.date(1995, 1, 2), 1.0) for k in (1, 2)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date, o_totalprice double"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 2.5, 0.1, 0.05, 3.0)], "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    fields = scenario.field_results(spark, str(tmp_path))
    assert _longest(spark, fields) < COMPILED
    got = {(r["doc_id"], r["field_id"], r["field_name"]): (r["value_text"], r["confidence"], r["source_page"], r["flagged_for_review"]) for r in fields.collect()}
    assert len(got) == 24 and got[1, "F_NET", "net_amount"] == ("2,25", 0.59, 3, False) and got[2, "F_VENDOR", "vendor_name"] == ("", 0.14, 3, False)
    attempts = fields.select("doc_id", "invoice_type_id", "field_name", F.col("doc_id").alias("seq"), "value_text", "confidence")
    typed = X.coerce_attempts(attempts, scenario.fields(spark)).orderBy("seq")
    assert _longest(spark, typed) < COMPILED


def test_facts_are_made_by_compiled_code(spark, static):
    labels = spark.createDataFrame([("R_VIA_005", "Currency allowed", "VIAJES"), ("R_VIA_001", "Vendor required", "VIAJES")], "rule_id string, label string, invoice_type_id string")
    facts = V.invoice_facts(_invoices(spark), _results(spark), labels)
    assert _longest(spark, facts) < COMPILED
    assert facts.where("invoice_id = 'i0'").first()["contradiction_list"] == ["Currency value exists but Currency allowed still needs review", V.TRAVEL_CONTRADICTION]


def test_statuses_are_looked_up(spark):
    rows = spark.createDataFrame([(" Failed", "WARNING "), ("failed", None), ("passed", "warning"), ("odd", "error"), (None, "warning"), ("skipped", "")],
                                 "status string, severity string")
    seen = rows.select(C.normalize_rule_status(F.col("status"), F.col("severity")), V.result_status(F.col("status"))).collect()
    assert [tuple(r) for r in seen] == [("warning", "failed"), ("failed", "failed"), ("passed", "passed"), ("unknown", "unknown"), ("unknown", "unknown"), ("skipped", "skipped")]


def test_rows_are_made_once_for_a_sort(spark, static):
    out = ordered(spark.range(9).select((F.col("id") % 3).alias("a"), (-F.col("id")).alias("b")), F.col("a"), "b")
    assert _plan(out).count("Exchange ") == 2 and "rangepartitioning" in _plan(out)
    assert [tuple(r) for r in out.collect()] == sorted(tuple(r) for r in out.collect())


def test_fields_become_maps_by_one_list(spark, static):
    fields = spark.createDataFrame([(1, "F_B", "b", "x", 1), (1, "F_A", "a", None, 2), (None, "F_A", "a", "y", 3)],
                                   "doc_id long, field_id string, field_name string, value_text string, source_page int")
    facts = R.field_map(fields)
    assert _plan(facts).count("partial_collect") == 1
    got = {r["doc_id"]: ({k: v["text"] for k, v in r["_values"].items()}, r["_names"]) for r in facts.collect()}
    assert got == {1: ({"b": "x", "a": None}, {"F_A": "a", "F_B": "b"}), None: ({"a": "y"}, {"F_A": "a"})}


def test_issues_of_facts_are_those_of_the_results(spark, static):
    invoices, results, labels = _invoices(spark), _results(spark), V.rule_labels(V.rule_sources(scenario.rules(spark)))
    once = V.review_issues(V.invoice_facts(invoices, results, labels, with_issues=True), results, labels)
    again = V.review_issues(V.invoice_facts(invoices, results, labels), results, labels)
    assert _plan(once).count("Scan ExistingRDD[invoice_id") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    assert {r["issue_type"] for r in once.collect()} == {"blocking_rule", "warning_rule", "missing_critical_field", "internal_contradiction"}


def test_cells_of_the_matrix_are_not_shuffled(spark, static):
    invoices, results, labels = _invoices(spark), _results(spark), V.rule_labels(V.rule_sources(scenario.rules(spark)))
    long = V.compliance_matrix_long(invoices.unionByName(invoices.limit(1)), results, labels)
    lines = _plan(long).splitlines()
    assert [next(i for i, line in enumerate(lines) if word in line) for word in ("Generate", "Join")] == sorted(
        next(i for i, line in enumerate(lines) if word in line) for word in ("Generate", "Join"))
    got = sorted((r["invoice_id"], r["rule_id"], r["status"]) for r in long.collect())
    assert got == sorted([("i0", "R_VIA_005", "failed"), ("i0", "R_VIA_001", "warning"), ("i0", "R_VIA_003", "passed")] * 2
                         + [("i1", r, "not_checked") for r in ("R_VIA_005", "R_VIA_001", "R_VIA_003")])


def test_lines_meet_labels_and_crops_of_their_page(spark, static):
    lines = spark.createDataFrame(
        [(1, 1, 1, "Net amount", 0.9, 10, 10, 110, 30), (1, 1, 2, "12,50", 0.8, 20, 130, 100, 150), (1, 1, 3, "far", 0.8, 20, 40, 100, 60), (1, 2, 4, "other", 0.8, 20, 35, 100, 55)],
        "doc_id long, page_num int, line_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int").withColumns(
        {"image_width": F.lit(600), "image_height": F.lit(800), "invoice_type_id": F.lit("VIAJES")})
    found = L.localize_values(lines, scenario.fields(spark))
    # only labels are gathered by field; what they meet goes by page
    dealt = {line.split("hashpartitioning(")[1].count("field_name") for line in _plan(found).splitlines() if "Exchange hashpartitioning(doc_id" in line}
    after = _plan(found).split("SortMergeJoin")[1]
    assert dealt == {0, 1} and "field_name" not in after.split("\n")[0].split("],")[0]
    assert [(r["line_no"], r["value_text"]) for r in found.where("field_name = 'net_amount'").collect()] == [(1, "far")]
    crops = spark.createDataFrame([(1, 1, "body", 0, 0, 300, 135), (1, 3, "body", 0, 0, 9, 9)], "doc_id long, page_num int, region string, x1 int, y1 int, x2 int, y2 int")
    inside = L.lines_in_crop(crops, lines)
    assert "Generate" not in _plan(inside)
    assert sorted(r["line_no"] for r in inside.collect()) == [1, 2, 3]


def test_join_inside_takes_several_keys(spark):
    left = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, None, "a")], "k long, p int, r string")
    right = spark.createDataFrame([(1, 1, "a", 7), (1, 2, "b", 8), (1, None, "a", 9)], "k long, p int, r string, y int")
    met, plain = join_inside(left, right, ["k", "p"], ["r"]), left.join(right, ["k", "p", "r"], "left")
    assert sorted(map(str, met.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_rows_made_of_updates_alone_take_columns_of_their_verdict(spark, static):
    held = spark.createDataFrame([(1, "VIAJES", "currency", "F_CURR", None, "T1"), (1, "VIAJES", "units", "F_UNITS", "3", "T1")],
                                 "doc_id long, invoice_type_id string, field_name string, field_id string, value_text string, _type string").withColumns({
        "confidence": F.lit(0.5), "source_page": F.lit(1), "source_region": F.lit("r"), "extraction_attempts": F.lit(1),
        "flagged_for_review": F.lit(False), "review_reason": F.lit(None).cast("string")})
    told = spark.createDataFrame([(1, "VIAJES", "R", 1, 2, True, {"currency": "EUR", "vendor_name": "Ann"}, "T1")],
                                 "doc_id long, invoice_type_id string, rule_id string, rule_order int, page_num int, passes boolean, field_updates map<string,string>, _type string")
    out = X.backfill_fields(held, told, scenario.fields(spark), more=("_type",))
    assert {(r["field_name"], r["value_text"], r["_type"], r["backfilled"]) for r in out.collect()} == {
        ("currency", "EUR", "T1", True), ("units", "3", "T1", False), ("vendor_name", "Ann", "T1", True)}
    assert "SortMergeJoin [doc_id" in _plan(out) and "FullOuter, ((field_name" in _plan(out)


def test_the_chain_stores_what_many_steps_read(spark):
    calls = []
    state = spark.createDataFrame([], "doc_id long, field_name string, summary " + A.M.summary_type(
        {"value_text": "string", "value_num": "double", "source_page": "int", "source_region": "string"}))
    empty = A.Inputs(
        runs=spark.createDataFrame([], "doc_id long, run_id string, invoice_id string, invoice_file string, pdf_path string, source_type string, source_id string, "
                                       "source_uri string, source_hash string, revision_id string, invoice_type_id string, agent_status string, finish_reason string, turns_used int"),
        fields=scenario.fields(spark), rules=scenario.rules(spark),
        verdicts=spark.createDataFrame([], "doc_id long, invoice_type_id string, rule_id string, rule_order int, page_num int, passes boolean, confidence double, "
                                           "observation string, field_updates map<string,string>"),
        support=spark.createDataFrame([], "doc_id long, any_link boolean, any_marker boolean, support_pages long"),
        learnings=spark.createDataFrame([], "invoice_type_id string, line_no long, text string"))
    tables = A.audit(state, empty, lambda name, rows: calls.append(name) or rows)
    assert calls == ["state", "fields", "verdicts"] and all("doc_id" in t.columns for t in tables.values())
    assert "hashpartitioning(run_id" not in _plan(tables["results"]) + _plan(tables["invoices"])

"""Rows of a document stay where they are: joins and aggregates by document, texts beside their blocks."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from auditloom import schemas as S
from auditloom.operators import learnings as N
from auditloom.operators import rules as R
from auditloom.operators import scoring as P
from auditloom.operators.scale import dealt, grown, join_inside
from auditloom.plans import canonical as C
from auditloom.plans import queries_views as QV
from auditloom.plans import scenario
from auditloom.plans import views as V


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def verdicts(spark):
    docs = spark.createDataFrame([(1, "VIAJES"), (2, "EQUIPOS"), (None, "EQUIPOS")], "doc_id long, invoice_type_id string")
    fields = spark.createDataFrame(
        [(1, "F_VENDOR", "vendor_name", "A", 1), (None, "F_VENDOR", "vendor_name", "B", 2)],
        "doc_id long, field_id string, field_name string, value_text string, source_page int")
    base = R.evaluate_rules(docs, fields, scenario.rules(spark), scenario.fields(spark))
    told = spark.createDataFrame(
        [(1, "R_VIA_010", True, 0.9, "seen", 2), (1, "R_VIA_010", False, 0.8, "gone", 3)],
        "doc_id long, rule_id string, passes boolean, confidence double, observation string, page_num int")
    return docs, fields, base, told


def test_verdicts_are_not_dealt_again_by_rule(spark, verdicts):
    docs, fields, base, told = verdicts
    merged = R.merge_visual_verdicts(base, told)
    assert "rule_id" not in "".join(line for line in _plan(merged).splitlines() if "Exchange hashpartitioning" in line)
    seen = {(r.doc_id, r.status) for r in merged.where("rule_name = 'vendor_required'").collect()}
    assert seen == {(1, "passed"), (2, "failed"), (None, "passed")}
    assert sorted(r.status for r in merged.where("rule_id = 'R_VIA_010'").collect()) == ["failed", "passed"]


def test_prior_verdicts_are_met_in_place(spark, verdicts):
    docs, fields, base, _ = verdicts
    prior = base.where("rule_name = 'vendor_required' and doc_id = 2").withColumns({"status": F.lit("passed"), "message": F.lit("earlier")})
    out = R.evaluate_rules(docs, fields, scenario.rules(spark), scenario.fields(spark), prior)
    assert "rule_id" not in "".join(line for line in _plan(out).splitlines() if "Exchange hashpartitioning" in line)
    assert out.count() == base.count()
    assert [r.message for r in out.where("rule_name = 'vendor_required' and doc_id = 2").collect()] == ["earlier"]


def test_join_inside_is_the_join_by_both_keys(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (None, "a", 4), (2, "b", 5)], "k long, r string, x int")
    right = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (1, None, 12), (None, "a", 13), (2, "c", 14)], "k long, r string, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        mine, plain = join_inside(left, right, "k", ["r"], how), left.join(right, ["k", "r"], how)
        assert sorted(map(str, mine.select(*sorted(plain.columns)).collect())) == sorted(map(str, plain.select(*sorted(plain.columns)).collect()))


def test_grown_sides_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "a")], "k long, r string")
    assert "Broadcast" not in _plan(rows.join(grown(rows.withColumnRenamed("r", "s")), "k"))


def test_results_are_not_dealt_by_cell(spark):
    results = spark.createDataFrame(
        [("i1", "r1", "passed"), ("i1", "r1", "passed"), ("i1", "r2", "failed")], "invoice_id string, rule_id string, normalized_status string")
    cells = V.reject_ambiguous(results)
    assert "SortAggregate" not in _plan(cells)
    assert sorted(map(tuple, cells.collect())) == [("i1", "r1", "passed"), ("i1", "r2", "failed")]
    with pytest.raises(Exception, match="duplicate compliance result for i1/r2"):
        V.reject_ambiguous(results.unionByName(results.where("rule_id = 'r2'").withColumn("normalized_status", F.lit("passed")))).collect()


def test_new_notes_meet_each_text_once(spark):
    texts = spark.createDataFrame([(1, "The Quick brown fox jumps over the lazy dog, twice or more."), (2, "abc"), (3, None)], "learning_id long, content string")
    new = spark.createDataFrame(
        [(1, "quick BROWN fox"), (2, " b "), (3, "over the lazy dog, twice or more."), (4, "fox jumped over the lazy dog, twice"), (5, "zz"), (6, "")],
        "new_id long, content string")
    found = N.contained_in(new, texts)
    assert sorted(r.new_id for r in found.collect()) == [1, 2, 3]
    # a block travels as a number beside the number of its text
    assert "_bs" not in _plan(found)
    assert [r.new_id for r in N.contained_in(texts.withColumnsRenamed({"learning_id": "new_id"}).unionByName(
        spark.createDataFrame([(9, "BROWN fox")], "new_id long, content string")), texts.withColumnRenamed("learning_id", "new_id"), earlier="new_id").collect()] == [9]


def _nodes(plan):
    children = plan.children()
    return [plan, *[n for i in range(children.size()) for n in _nodes(children.apply(i))]]


def _outputs(df, kind: str) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan()
    return [n.output().mkString(",") for n in _nodes(plan) if n.nodeName() == kind]


def test_rules_leave_the_maps_of_a_document_behind(spark):
    docs = spark.createDataFrame([(1, "T"), (2, "T")], "doc_id long, invoice_type_id string")
    fields = spark.createDataFrame(
        [(1, "F_A", "a", "x", 1, None), (1, "F_N", "n", "1,5", 1, 1.5), (2, "F_A", "a", "null", 1, None), (2, "F_N", "n", "y", 1, None)],
        "doc_id long, field_id string, field_name string, value_text string, source_page int, value_num double")
    rules = spark.createDataFrame([
        ("R1", "T", "one", "F_X", "required_one_of", "F_A, z", "error", "none", 1), ("R2", "T", "if", "F_A", "conditional_check", "if a=x then n=1.5", "error", "other", 2),
        ("R3", "T", "sum", "F_N", "cross_field", "n", "error", "", 3), ("R4", "T", "near", "F_N", "range", "1,2", "error", "out", 4),
        ("R5", "T", "form", "F_N", "regex", r"1\.5$", "error", "form", 5)],
        "rule_id string, invoice_type_id string, rule_name string, field_id string, check_type string, check_value string, severity string, error_message string, rule_order int")
    out = R.evaluate_rules(docs, fields, rules)
    assert sum("_values#" in columns for columns in _outputs(out, "Project")) <= 2
    got = {(r["doc_id"], r["rule_id"]): r["status"] for r in out.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == dict.fromkeys(("R1", "R2", "R3", "R4", "R5"), "passed")
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"R1": "failed", "R2": "skipped", "R3": "skipped", "R4": "failed", "R5": "failed"}


def test_page_rows_meet_their_type_before_they_become_lines(spark, tmp_path):
    spark.createDataFrame([(1, 10, "O", "1-URGENT", "1995-01-02", 1.0)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string, o_totalprice double"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 5, 2.5, "1995-01-03"), (2, 1, 5, 2.5, "1995-01-03")],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_shipdate string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = scenario.ocr_lines(spark, str(tmp_path))
    nodes = [n.nodeName() for n in _nodes(lines._jdf.queryExecution().optimizedPlan())]
    assert nodes.index("Generate") < nodes.index("Join")
    assert [(r["doc_id"], r["line_no"], r["invoice_type_id"]) for r in lines.orderBy("line_no").collect()] == [(1, n, "VIAJES") for n in (3, 4, 5)]
    assert lines.columns[-1] == "invoice_type_id" and lines.columns[0] == "doc_id"


def _orders(spark, folder) -> str:
    spark.createDataFrame([(k, 10, "O", "1-URGENT", datetime.date(1995, 1, 2), 1.0) for k in (1, 2, None)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date, o_totalprice double"
                          ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 2.5, 0.1, 0.05, 3.0), (1, 4.0, 0.0, 0.05, 2.0)],
                          "l_orderkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double"
                          ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_sums_of_documents_are_not_broadcast_and_fields_are_mapped_in_place(spark, tmp_path):
    folder = _orders(spark, tmp_path)
    assert "Broadcast" not in _plan(scenario.wide_documents(spark, folder))
    # both inputs are dealt by doc_id once; their fields become maps without a further shuffle
    assert _plan(R.field_map(scenario.field_results(spark, folder))).count("Exchange hashpartitioning") == 2
    got = {r["doc_id"]: (r["units"], r["net_c"]) for r in scenario.wide_documents(spark, folder).collect()}
    assert got == {1: (5, 625), 2: (None, None), None: (None, None)}


def test_runs_meet_verdict_and_field_tables_by_sorting(spark):
    runs = spark.createDataFrame([(1, "a.pdf"), (None, "b.pdf")], "doc_id long, invoice_file string")
    rows = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long").withColumns(
        {c: F.lit(0.5) for c in {*S.RULE_TABLE, *S.FIELD_TABLE, "value_text"} - {"doc_id", "invoice_file"}})
    for table in (C.rule_table, C.field_table):
        out = table(runs, rows)
        assert "Broadcast" not in _plan(out) and [r["invoice_file"] for r in out.collect()] == ["a.pdf", "a.pdf"]


def test_truth_meets_values_in_place_and_only_what_is_asked_is_read(spark):
    values = spark.createDataFrame(
        [(1, "invoice_date", "03/04/2024"), (1, "units", "5"), (1, "currency", " EUR "), (1, None, "x"), (None, "units", "5"), (2, "units", "1,5"), (2, "pay_period", "x2")],
        "doc_id long, field_name string, value_text string").withColumns({"confidence": F.lit(0.5), "flagged_for_review": F.lit(None).cast("boolean")})
    truth = spark.createDataFrame(
        [(1, "invoice_date", "2024-04-03"), (1, "currency", "eur"), (1, None, "x"), (None, "units", "5"), (2, "units", "1.5"), (2, "pay_period", "X2"), (3, "units", "7")],
        "doc_id long, field_name string, truth_value string")
    compared = P.compare_fields(values, truth)
    assert not [line for line in _plan(compared).splitlines() if "Exchange hashpartitioning" in line and "field_name" in line]
    got = sorted(((r["doc_id"], r["field_name"], r["value_text"], r["truth_value"], r["match"]) for r in compared.collect()), key=str)
    assert got == sorted([
        (1, "invoice_date", "03/04/2024", "2024-04-03", True), (1, "units", "5", None, None), (1, "currency", " EUR ", "eur", True),
        (1, None, "x", None, None), (1, None, None, "x", False), (None, "units", "5", None, None), (None, "units", None, "5", False),
        (2, "units", "1,5", "1.5", True), (2, "pay_period", "x2", "X2", True), (3, "units", None, "7", False)], key=str)
    unnamed = P.compare_values(spark.createDataFrame([(None, "5", "5.0"), (None, "A", "a")], "field_name string, value_text string, truth_value string"))
    assert [(r["match"], r["partial"]) for r in unnamed.orderBy("value_text").collect()] == [(False, False), (True, False)]


def test_tasks_hold_a_bounded_number_of_documents(spark):
    """The partitions follow the rows and stay apart, however few bytes they shuffle; adaptive execution left one of the second."""
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert dealt(docs, "doc_id", 10).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt(docs, "doc_id", 1000, 25)
    sums = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    met = spread.join(grown(sums), "doc_id", "left").withColumn("task", F.spark_partition_id())
    held = met.groupBy("task").count().collect()
    assert len(held) == 40 and sum(r["count"] for r in held) == 1000 and max(r["count"] for r in held) < 75


def test_field_pages_of_a_document_are_dealt_once(spark, small_dir):
    """Dealt documents grow into fields in place; the fields were dealt by document and field, then by document."""
    results = QV.base(spark, small_dir)[1]
    lines = [line for line in _plan(V.status_pivot(results)).splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert lines and not [line for line in lines if "field_id" in line]
    assert "REPARTITION_BY_NUM" in "".join(lines)

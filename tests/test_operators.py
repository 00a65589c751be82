import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom import schemas as S
from auditloom.operators import learnings as N
from auditloom.operators import ledger as K
from auditloom.operators import runlog as G
from auditloom.operators.evidence import amounts_touch
from auditloom.operators.scale import Prefix, running
from auditloom.plans import canonical as C
from auditloom.plans import queries_views as QV
from auditloom.plans import scenario, views
from auditloom.sources import config, documents, truth, workbook_dir
from auditloom.sinks import tables as sinks


def test_running_equals_plain_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq int, v int")
    got = running(df, ["k"], "seq", [Prefix("s", "sum", F.col("v")), Prefix("m", "max", F.col("v"), False), Prefix("l", "last", F.col("v"), False), Prefix("n", "min", F.col("v"))], 7)
    w = Window.partitionBy("k").orderBy("seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum("v").over(upto).alias("s"), F.max("v").over(before).alias("m"), F.last("v", True).over(before).alias("l"), F.min("v").over(upto).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_guards_in_small_chunks(spark):
    tools = ["a", "a", "a", "check_compliance", "a", "a", "b", "b", "b", "b", "b", "b", "a"]
    rows = [(1, i, t, "{}", i % 3 == 0) for i, t in enumerate(tools)]
    df = spark.createDataFrame(rows, "run_id int, seq int, tool string, params string, success boolean")
    got = [r.streak for r in G.duplicate_action_streak(df).orderBy("seq").collect()]
    assert got == [0, 1, 2, 0, 1, 2, 0, 1, 2, 3, 4, 5, 0]


@pytest.mark.parametrize("status,attempts,claimed,want", [
    (None, 0, 0.0, "new"), ("done", 1, 0.0, "already_done"), ("failed", 2, 0.0, "retry"), ("failed", 3, 0.0, "exhausted"), ("processing", 1, 9000.0, "in_progress"),
    ("processing", 1, 8200.0, "in_progress"), ("processing", 1, 8199.0, "reclaim_stale"), ("processing", 3, 0.0, "stale_exhausted"), ("needs_attention", 1, 0.0, "parked"), ("odd", 9, 0.0, "unknown_reset"),
])
def test_claim_reason(spark, status, attempts, claimed, want):
    df = spark.createDataFrame([(status, attempts, claimed)], "s string, a int, c double")
    assert df.select(K.claim_reason(F.col("s"), F.col("a"), F.col("c"), F.lit(10000.0))).first()[0] == want


def test_contained_in_against_brute_force(spark):
    rng = random.Random(5)
    existing = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    new = [e[i:i + n] for e in existing[:30] for i, n in [(rng.randint(0, 20), rng.choice([1, 3, 8, 20, 33, 50]))]]
    new += ["".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 4, 6, 7, 9, 15, 31, 40)]
    new = [n.strip() for n in new if n.strip()]
    got = {r.new_id for r in N.contained_in(spark.createDataFrame(list(enumerate(new)), "new_id int, content string"),
                                            spark.createDataFrame([(e,) for e in existing], "content string")).collect()}
    assert got == {i for i, n in enumerate(new) if any(n in e for e in existing)}


def test_name_match_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 7)))
    docs, rows = [(i, word() + ".pdf") for i in range(50)], [(i, word(), None, None) for i in range(40)]
    got = {r.doc_id: r.line_no for r in truth.match_by_name(spark.createDataFrame(docs, "doc_id int, file_name string"),
                                                            spark.createDataFrame(rows, "line_no int, source_name string, source_id string, revision_id string")).collect()}
    want = {}
    for d, name in docs:
        key = name.removesuffix(".pdf")
        hits = [n for n, s, _, _ in rows if s in key or key in s]
        if hits:
            want[d] = min(hits)
    assert got == want


def test_id_row_never_falls_back_to_name(spark):
    docs = spark.createDataFrame([(1, "id1", "r2", "foo.pdf")], "doc_id int, source_id string, revision_id string, file_name string")
    rows = spark.createDataFrame([(0, "foo", "id1", "r1")], "line_no int, source_name string, source_id string, revision_id string")
    assert truth.match_truth(docs, rows).count() == 0


def test_amount_tolerance_is_the_float_comparison(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 300) / 100, rng.randint(0, 300) / 100) for _ in range(400)]
    df = spark.createDataFrame([([a], [b]) for a, b in pairs], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(amounts_touch(F.col("a"), F.col("b"))).collect()]
    assert got == [abs(a - b) <= 0.02 for a, b in pairs]


def test_ambiguous_cell_is_an_error(spark, small_dir):
    _, results, _, _ = QV.base(spark, small_dir)
    clash = results.unionByName(results.withColumn("message", F.lit("other")))
    with pytest.raises(Exception, match="duplicate compliance result"):
        views.reject_ambiguous(clash).collect()


def test_rule_guide_entries_are_whole(spark, small_dir):
    _, results, _, _ = QV.base(spark, small_dir)
    entries = views.rule_guide_entries(results)
    failing = results.filter("normalized_status IN ('failed', 'flagged')").select("rule_id", "invoice_file").distinct().count()
    assert entries.filter("kind = 'failing'").count() == failing > 500


def test_stale_headers_and_missing_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="stale or invalid headers"):
        workbook_dir.validate_headers("Dashboard", ["a"])
    with pytest.raises(ValueError, match="raw rule IDs"):
        workbook_dir.validate_headers("Compliance Matrix", [*S.MATRIX_KEYS, "R_X"])
    with pytest.raises(ValueError, match="dashboard.csv, compliance_matrix.csv"):
        workbook_dir.scan_workbook_dir(spark, str(tmp_path))
    with pytest.raises(ValueError, match="missing required key"):
        S.require_keys(spark.range(1), ["invoice_id"], "invoice row")


def test_workbook_round_trip(spark, small_dir, tmp_path):
    runs = scenario.runs(spark, small_dir)
    fields = scenario.field_results(spark, small_dir)
    from auditloom.plans import queries_rules as Q

    results = Q.results(spark, small_dir)
    tables = views.workbook(runs, fields, results, scenario.rules(spark), scenario.evidence(results))
    assert set(tables) == {n for n, _ in S.WORKBOOK_TABLES}
    sinks.write_workbook({n: tables[n] for n in tables}, str(tmp_path))
    back = workbook_dir.scan_workbook_dir(spark, str(tmp_path))
    assert back["Technical Run Data"].count() == runs.count()
    assert back["Review"].count() == tables["Review"].count()
    sinks.table_sink(back["Dashboard"], str(tmp_path / "d"), "append")
    sinks.table_sink(back["Dashboard"], str(tmp_path / "d"), "append")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2 * back["Dashboard"].count()
    sinks.table_sink(back["Dashboard"], str(tmp_path / "d"), "replace")
    assert spark.read.parquet(str(tmp_path / "d")).count() == back["Dashboard"].count()
    sinks.write_canonical(tables["Technical Run Data"], tables["Compliance Results"], str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/canonical_invoice_summary")).count() == runs.count()
    outcome = C.outcome(tables["Technical Run Data"])
    sinks.publish_results(tables["Compliance Results"], outcome, str(tmp_path / "p"), 0)
    sinks.publish_results(tables["Compliance Results"], outcome, str(tmp_path / "p"), 0)
    assert spark.read.parquet(str(tmp_path / "p/status")).count() == runs.count()


def test_folder_and_config_sources(spark, tmp_path):
    for n in ("b.PDF", "a.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"x" * 3)
    (tmp_path / "a_truth.json").write_text('{"invoice_type_id": "VIAJES", "fields": {"total": 2.5}}')
    assert [r.display_name for r in documents.scan_documents(spark, str(tmp_path)).collect()] == ["a.pdf", "b.PDF"]
    assert documents.document_digests(spark, str(tmp_path)).select("content_sha256").distinct().count() == 1
    row = truth.scan_truth_json(spark, str(tmp_path)).first()
    assert row.stem == "a" and row.truth.fields == {"total": "2.5"}
    (tmp_path / "invoice_types.csv").write_text("invoice_type_id,display_name,description,agent_context,enabled\nT1,One,d,c,true\nT2,Two,d,c,false\n")
    (tmp_path / "extraction_fields.csv").write_text(
        'field_id,invoice_type_id,field_name,field_label,data_type,required,extraction_hint,page_region,aliases\nF1,T1,n,N,string,true,"a, b",top,"x, y"\nF2,T2,m,M,string,true,h,top,\n')
    (tmp_path / "compliance_rules.csv").write_text(
        "rule_id,invoice_type_id,rule_name,field_id,check_type,check_value,severity,agent_hint,error_message,page_region,enabled,rule_group\nR1,T1,a,F1,required,,error,h,m,top,true,\n")
    cfg = config.load_config(spark, str(tmp_path))
    assert cfg["fields"].first().aliases == ["x", "y"] and cfg["fields"].count() == 1
    assert cfg["rules"].first().rule_group == "general" and cfg["allowed_values"].count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_equals_one_window_at_any_chunk_and_span(spark, keys):
    rnd = random.Random(7)
    rows = [(i * 3 + rnd.randrange(3), rnd.randrange(3), rnd.choice([None, *range(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "at bigint, k int, v bigint").repartition(5)
    hows = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor, "last": lambda c: F.last(c, ignorenulls=True)}
    window = Window.partitionBy(*keys).orderBy("at")
    ends = {True: window.rowsBetween(Window.unboundedPreceding, 0), False: window.rowsBetween(Window.unboundedPreceding, -1)}
    want = df.select("*", *[f(F.col("v")).over(ends[e]).alias(f"{h}_{e}") for h, f in hows.items() for e in ends])
    found = running(df, keys, "at", [Prefix(f"{h}_{e}", h, F.col("v"), e) for h in hows for e in ends], chunk_rows=10, chunk_span=4)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    if not keys:
        assert running(df.limit(0), [], "at", [Prefix("n", "sum", F.lit(1))]).collect() == []


def test_notes_inside_earlier_notes_of_the_batch_are_skipped(spark):
    held = spark.createDataFrame([(7, "An old remark about totals")], "learning_id int, content string")
    notes = ["Check the vendor name twice", "vendor NAME", "Check the vendor name twice and sign", "old remark", "check the vendor name twice", "  ", None, "x"]
    new = spark.createDataFrame([(i, n, "GENERAL", "approaches") for i, n in enumerate(notes)], "new_id bigint, content string, invoice_type_id string, category string")
    want, said = [], ["an old remark about totals"]
    for n in notes:
        text = (n or "").strip()
        if text and not any(text.lower() in s for s in said):
            want.append(text)
            said.append(text.lower())
    got = N.insert_learnings(held, new, "2024-01-01").orderBy("learning_id").collect()
    assert [(r["learning_id"], r["content"]) for r in got] == [(8 + i, t) for i, t in enumerate(want)]


def test_a_crop_names_its_page_or_its_image(spark):
    cases = [("{}", "either"), ('{"region": "top"}', "either"), ('{"page_num": 1}', "'region'"), ('{"image_path": "a"}', "'region'"),
             ('{"image_path": "a", "region": "top"}', None)]
    log = spark.createDataFrame([(i, "crop_region", p, "why") for i, (p, _) in enumerate(cases)], "seq int, tool string, params string, reasoning string")
    for r in G.validate_actions(log).collect():
        said = cases[r["seq"]][1]
        assert (r["contract_error"] is None) if said is None else said in r["contract_error"]


def test_header_faults_name_each_column():
    assert workbook_dir.header_faults("Dashboard", list(S.DASHBOARD)) == []
    assert len(workbook_dir.header_faults("Dashboard", [*S.DASHBOARD, "more"])) == 1
    assert workbook_dir.header_faults("Compliance Matrix", [*S.MATRIX_KEYS, "Label"]) == []
    assert len(workbook_dir.header_faults("Compliance Matrix", ["a", "R_X"])) == len(S.MATRIX_KEYS) + 1


def test_truth_csv_is_read_by_column_name(spark, tmp_path):
    from auditloom.sources import truth

    folder = tmp_path / "truth"
    folder.mkdir()
    (folder / "a.csv").write_text('Total,Source file,Notes,Extra\n"1,5",doc one.pdf,"two\nlines, ""quoted""",x\n,doc two.pdf,,\n')
    schema = "`Source file` string, Notes string, Total string, Date string"
    rows = truth.scan_truth_csv(spark, str(folder), schema).orderBy("Source file").collect()
    assert [tuple(r) for r in rows] == [("doc one.pdf", 'two\nlines, "quoted"', "1,5", None), ("doc two.pdf", None, None, None)]
    with pytest.raises(ValueError, match="no source column"):
        truth.scan_truth_csv(spark, str(folder), schema, "File")
    assert truth.scan_truth_csv(spark, str(folder), schema, "File", "Extra").count() == 2
    long = truth.truth_unpivot(truth.scan_truth_csv(spark, str(folder), schema), {"Total": "total_amount", "Notes": "notes"}, ("Source file",))
    assert sorted(r["field_name"] for r in long.collect()) == ["notes", "total_amount"]


def test_run_log_lines_feed_the_guards(spark, tmp_path):
    lines = [{"run_id": "r", "turn": i, "ts": "2024-05-05T00:00:00Z", "tool": "note", "params": '{"text": "a"}', "reasoning": "why", "result": "{}", "elapsed_ms": 5}
             for i in range(4)]
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "agent_log_1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    log = G.scan_run_log(spark, str(folder))
    assert log.count() == 4 and log.schema["ts"].dataType.simpleString() == "timestamp"
    checked = G.validate_actions(log).collect()
    assert all(r["contract_error"] is None for r in checked)
    streaks = G.duplicate_action_streak(log.withColumn("seq", F.col("turn").cast("bigint"))).orderBy("seq").collect()
    assert streaks[-1]["streak"] > streaks[0]["streak"]
    assert G.scan_run_log(spark, str(folder), streaming=True).isStreaming


def test_run_summaries_accumulate(spark, tmp_path):
    summary = spark.createDataFrame([tuple(str(i) for _ in S.INVOICE_SUMMARY) for i in range(3)], list(S.INVOICE_SUMMARY))
    rows = C.run_summary(summary, F.lit("20240101_000000"))
    path = str(tmp_path / "summary")
    for _ in range(2):
        sinks.append_run_summary(rows, path)
    back = spark.read.parquet(path)
    assert back.columns == list(S.RUN_SUMMARY) and back.count() == 6

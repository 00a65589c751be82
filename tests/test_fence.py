import json
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from pyspark.sql import functions as F

from auditloom.streaming import fence


def refs(spark, names, revision="1"):
    return spark.createDataFrame([(n, f"file:///{n}", revision, f"{n}.pdf") for n in names], "source_id string, uri string, revision_id string, display_name string")


def fine(claimed):
    return claimed.select("key", F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("error"))


def test_a_number_is_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/c/000000000001"
    with ThreadPoolExecutor(8) as pool:
        took = list(pool.map(lambda i: fence.put_if_absent(spark, path, f"writer {i}"), range(8)))
    assert took.count(True) == 1 and (tmp_path / "c/000000000001").read_text() == f"writer {took.index(True)}"
    assert [p.name for p in (tmp_path / "c").iterdir()] == ["000000000001"]


def test_concurrent_polls_claim_each_key_once(spark, tmp_path):
    ledger = fence.FencedLedger(spark, str(tmp_path / "ledger"), 8)
    listing = refs(spark, [f"d{i:02}" for i in range(40)])
    start = Barrier(3)
    read = ledger.version

    def version():
        # all polls have read the empty ledger before any of them commits
        found = read()
        if found == 0:
            start.wait(60)
        return found

    ledger.version = version
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda i: fence.fenced_poll(ledger, listing, fine, 10.0, f"r{i}", max_files=None).first(), range(3)))
    ledger.version = read
    assert sorted((r["claimed"], r["processed_ok"], r["raced"]) for r in got) == [(0, 0, 40), (0, 0, 40), (40, 40, 0)]
    claims = ledger.rows_of(ledger.entries(0, ledger.version())).filter("status = 'processing'")
    assert claims.count() == 40 == claims.select("key").distinct().count()
    assert ledger.state().filter("status = 'done' AND attempts = 1 AND version = 2").count() == 40


def test_only_the_overlap_is_raced(spark, tmp_path):
    ledger = fence.FencedLedger(spark, str(tmp_path / "ledger"), 8)
    when, who = F.lit(5.0), F.lit("a")

    def claims(names):
        keyed = fence.K.keyed_refs(refs(spark, names))
        return fence.K.apply_claims(fence.K.decide_claims(keyed, ledger.state(0), when), who, when)

    first, held, raced = ledger.commit(claims(["a", "b"]), 0, "one")
    assert (first, held.count(), raced.count()) == (1, 2, 0)
    second, held, raced = ledger.commit(claims(["b", "c"]), 0, "two")
    assert second == 2 and [r["key"] for r in held.collect()] == ["c#1"] and [r["key"] for r in raced.collect()] == ["b#1"]
    assert {r["key"] for r in ledger.state().collect()} == {"a#1", "b#1", "c#1"}


def test_outcome_of_a_claim_taken_over_is_dropped(spark, tmp_path):
    ledger = fence.FencedLedger(spark, str(tmp_path / "ledger"), 8)

    def slow(claimed):
        # while this poll works, its claim goes stale and another poll takes it over
        other = fence.fenced_poll(ledger, refs(spark, ["a"]), fine, 5000.0, "second").first()
        assert (other["claimed"], other["processed_ok"]) == (1, 1)
        return claimed.select("key", F.lit(True).alias("needs_review"), F.lit(None).cast("string").alias("error"))

    late = fence.fenced_poll(ledger, refs(spark, ["a"]), slow, 0.0, "first").first()
    end = ledger.state().first()
    assert (end["status"], end["run_id"], end["attempts"], end["needs_review"]) == ("done", "second", 2, False)
    assert late["claimed"] == 1 and late["needs_review"] == 0


def test_snapshots_hold_the_state_and_prune_what_is_read(spark, tmp_path):
    ledger = fence.FencedLedger(spark, str(tmp_path / "ledger"), 64)

    def work(claimed):
        return fine(claimed.filter("key NOT LIKE 'bad%'"))

    for i in range(3):
        fence.fenced_poll(ledger, refs(spark, [f"n{i}_{k}" for k in range(30)] + ["bad"]), work, float(i), f"r{i}", max_files=None, snapshot_every=100)
    before = sorted(map(tuple, ledger.state().collect()))
    ledger.compact()
    assert sorted(map(tuple, ledger.state().collect())) == before and len(before) == 91
    listed = fence.K.keyed_refs(refs(spark, ["n1_3", "unseen"]))
    part = ledger.state(listed=listed)
    assert part.filter("key = 'n1_3#1'").count() == 1
    # the scan is given the two buckets and the open rows; the others are left out before any file is opened
    scan = next(line for line in part._jdf.queryExecution().toString().splitlines() if "PartitionFilters: [" in line and "bucket" in line.split("PartitionFilters: [")[1])
    assert "open#" in scan.split("PartitionFilters: [")[1]
    assert part.count() <= 10 < ledger.state().count()
    again = fence.fenced_poll(ledger, refs(spark, ["n1_3", "new"]), work, 9.0, "r9").first()
    assert (again["scanned"], again["claimed"], again["skipped"], again["raced"]) == (2, 1, 1, 0)
    # a snapshot broken off is not read
    (tmp_path / "ledger/snapshots/999999999999-x").mkdir()
    assert ledger.snapshot()[0] == 6 and ledger.state().count() == 92


def test_failed_work_and_caps(spark, tmp_path):
    ledger = fence.FencedLedger(spark, str(tmp_path / "ledger"), 8)

    def broken(claimed):
        raise RuntimeError("no model")

    got = fence.fenced_poll(ledger, refs(spark, ["a", "b", "c"]), broken, 1.0, "r0", max_files=2).first()
    assert (got["scanned"], got["claimed"], got["failed"]) == (3, 2, 2)
    assert sorted(r["status"] for r in ledger.state().collect()) == ["failed", "failed", "pending"]
    got = fence.fenced_poll(ledger, refs(spark, []), fine, 2.0, "r1", snapshot_every=1).first()
    assert (got["claimed"], got["processed_ok"]) == (3, 3) and ledger.snapshot()[0] == 4
    entry = json.loads((tmp_path / "ledger/commits/000000000001").read_text())
    assert entry["version"] == 1 and entry["writer"] == "r0"

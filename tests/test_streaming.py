import uuid

from pyspark.sql import functions as F

from auditloom.operators import runlog as G
from auditloom.plans import queries_runlog as QR
from auditloom.streaming import poll, stateful


def drain(df, spark, folder):
    name = "t" + uuid.uuid4().hex[:8]
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", folder).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name)


def test_guard_stream_equals_batch_windows(spark, small_dir, tmp_path):
    log = QR.log(spark, small_dir).select("run_id", "seq", "tool", "params", "tokens")
    signed = log.withColumn("signature", G.signature(F.col("tool"), F.col("params")))
    signed.repartition(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(signed.schema).parquet(str(tmp_path / "log"))
    got = drain(stateful.guard_stream(stream), spark, str(tmp_path / "ck")).select("run_id", "seq", "streak", "signal", "cumulative_tokens")
    dup = G.duplicate_action_streak(log).select("run_id", "seq", "streak", "signal")
    want = dup.join(G.token_cap(log, 0, 0).select("run_id", "seq", "cumulative_tokens"), ["run_id", "seq"])
    assert got.count() == log.count() and got.exceptAll(want).count() == 0


def test_claim_stream_walks_the_states(spark, tmp_path):
    steps = [("claim", 0.0), ("fail", 1.0), ("claim", 2.0), ("claim", 3.0), ("claim", 5000.0), ("claim", 9000.0), ("claim", 9001.0)]
    rows = [("k", i, a, t) for i, (a, t) in enumerate(steps)]
    df = spark.createDataFrame(rows, "key string, seq bigint, action string, now double")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    got = drain(stateful.claim_stream(stream), spark, str(tmp_path / "ck")).orderBy("seq").collect()
    assert [r.reason for r in got] == ["new", "fail", "retry", "in_progress", "reclaim_stale", "stale_exhausted", "parked"]
    assert got[-1].status == "needs_attention" and got[-1].attempts == 3


def refs(spark, names, revision="1"):
    return spark.createDataFrame([(n, f"file:///{n}", revision, f"{n}.pdf") for n in names], "source_id string, uri string, revision_id string, display_name string")


def summary(df):
    return tuple(df.first())


def test_polls_claim_skip_retry_and_park(spark, tmp_path):
    ledger = str(tmp_path / "ledger")

    def work(claimed):
        return claimed.filter("key NOT LIKE 'bad%'").select("key", (F.col("key").startswith("odd")).alias("needs_review"), F.lit(None).cast("string").alias("error"))

    def go(batch, names, **kw):
        return summary(poll.run_poll(spark, refs(spark, names), ledger, work, 10.0 + batch, batch, f"r{batch}", **kw))

    assert go(0, ["a", "odd", "bad"]) == (3, 3, 1, 1, 1, 0)
    assert go(1, ["a", "odd", "bad"]) == (3, 1, 0, 0, 1, 2)
    assert go(2, ["a", "odd", "bad"]) == (3, 1, 0, 0, 1, 2)
    assert go(3, ["a", "odd", "bad"]) == (3, 0, 0, 0, 0, 3)
    assert go(3, ["a", "odd", "bad"]) == (3, 0, 0, 0, 0, 3)
    assert go(4, [f"n{i}" for i in range(5)], max_files=2) == (5, 2, 2, 0, 0, 0)
    again = poll.run_poll(spark, refs(spark, ["a"], "2"), ledger, work, 99.0, 5, "r5")
    assert summary(again)[1] == 1


def test_stream_of_manifests(spark, tmp_path):
    refs(spark, ["x", "y"]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(refs(spark, ["x"]).schema).parquet(str(tmp_path / "in"))
    seen = []
    q = poll.stream_polls(stream, str(tmp_path / "ledger"), str(tmp_path / "ck"),
                          lambda c: c.select("key", F.lit(False).alias("needs_review"), F.lit(None).cast("string").alias("error")),
                          lambda: 50.0, lambda i, s: seen.append(summary(s)))
    assert q.awaitTermination(120)
    assert seen == [(2, 2, 2, 0, 0, 0)]


def ended(spark, ledger):
    return {r["key"]: r["status"] for r in poll.K.latest(spark.read.parquet(ledger).drop("batch", "step")).collect()}


def test_stream_loses_no_document_and_retries_failed_ones(spark, tmp_path):
    inbox, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    names = [f"d{i:03}" for i in range(120)]
    schema = refs(spark, ["x"]).schema

    def work(row):
        if row["key"].startswith("d007") and row["attempts"] == 1:
            raise ValueError("unreadable")
        return False

    def go(listed, clock, **kw):
        refs(spark, listed).coalesce(1).write.mode("append").parquet(inbox)
        q = poll.stream_polls(spark.readStream.schema(schema).parquet(inbox), ledger, str(tmp_path / "ck"), poll.each_document(work), lambda: clock, **kw)
        assert q.awaitTermination(120)
        return ended(spark, ledger)

    first = go(names, 10.0)
    assert len(first) == 120 and [k for k, s in first.items() if s != "done"] == ["d007#1"] and first["d007#1"] == "failed"
    assert set(go(["late"], 20.0).values()) == {"done"}
    capped = go([f"e{i}" for i in range(5)], 30.0, max_files=2)
    assert sorted(capped[f"e{i}#1"] for i in range(5)) == ["done", "done", "pending", "pending", "pending"]
    assert set(go(["f"], 40.0).values()) == {"done"}


def test_failing_processor_is_recorded(spark, tmp_path):
    def work(claimed):
        raise RuntimeError("no model")

    got = poll.run_poll(spark, refs(spark, ["a"]), str(tmp_path / "ledger"), work, 1.0, 0, "r")
    assert summary(got) == (1, 1, 0, 0, 1, 0)
    assert ended(spark, str(tmp_path / "ledger")) == {"a#1": "failed"}


def test_only_a_missing_ledger_is_empty(spark, tmp_path):
    assert poll.read_log(spark, str(tmp_path / "none"), 1).count() == 0


def test_guard_stream_keeps_order_beyond_one_arrow_batch(spark, tmp_path):
    rows = spark.range(25_000).select(F.lit(1).cast("bigint").alias("run_id"), (24_999 - F.col("id")).alias("seq"), F.lit("t").alias("tool"),
                                      F.col("id").cast("string").alias("signature"), F.lit(1).cast("bigint").alias("tokens"))
    rows.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    got = drain(stateful.guard_stream(stream), spark, str(tmp_path / "ck"))
    assert got.count() == 25_000 and got.where("cumulative_tokens <> seq + 1").count() == 0

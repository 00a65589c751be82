"""A claim ledger for several writers: commits numbered by put-if-absent, snapshots by bucket.

A poll reads the ledger as of some commit, writes its rows aside and takes the next number for them. Of two polls
that want the same number one gets it; the other drops the rows whose keys have moved on since it read (they are
*raced*), and tries the number after. So every key has one claim at a time, however many polls run.

Numbers are taken by a hard link on local file systems and by a rename that refuses to overwrite elsewhere, which is
atomic on HDFS; an object store without such a rename can't hold the commits.

Snapshots hold the row in force of every key, split by whether the key is open and by key bucket. A poll reads the
open rows, the buckets of the keys it lists and the commits since the last snapshot, not the whole history.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as K
from .poll import Processor

BUCKETS = 256
#: Commits after which a poll writes a new snapshot.
SNAPSHOT_EVERY = 32
ENTRY = "version bigint, folder string, writer string"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A small file with its whole text, or false if there is one of that name."""
    aside = f"{path}.{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    target, source = hadoop.fs.Path(path), hadoop.fs.Path(aside)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        here, there = (Path(p.toUri().getPath()) for p in (source, target))
        here.write_text(text)
        try:
            os.link(here, there)
            return True
        except FileExistsError:
            return False
        finally:
            here.unlink()
    out = fs.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, plain)
        return True
    except Py4JJavaError as error:
        fs.delete(source, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


class FencedLedger:
    """Rows of ``ledger.LEDGER_COLUMNS`` under one folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max((int(n) for n in names_in(self.spark, f"{self.path}/commits") if n.isdigit()), default=0)

    def snapshot(self) -> tuple[int, str | None]:
        """Version and folder of the last whole snapshot."""
        for name in reversed(names_in(self.spark, f"{self.path}/snapshots")):
            if "_SUCCESS" in names_in(self.spark, f"{self.path}/snapshots/{name}"):
                return int(name.split("-")[0]), f"{self.path}/snapshots/{name}"
        return 0, None

    def entries(self, after: int, upto: int) -> list:
        """Commits numbered above ``after`` to ``upto``; their count is bounded by the spacing of snapshots."""
        files = [f"{self.path}/commits/{n:012d}" for n in range(after + 1, upto + 1)]
        return self.spark.read.schema(ENTRY).json(files).orderBy("version").collect() if files else []

    def rows_of(self, entries: list) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], K.LEDGER_SCHEMA)
        return self.spark.read.schema(K.LEDGER_SCHEMA).parquet(*[f"{self.path}/data/{e['folder']}" for e in entries])

    def state(self, version: int | None = None, listed: DataFrame | None = None) -> DataFrame:
        """Rows in force as of ``version``; with ``listed`` keys, theirs and those of open keys only."""
        version = self.version() if version is None else version
        base, folder = self.snapshot()
        if base > version:
            base, folder = 0, None
        log = self.rows_of(self.entries(base, version))
        if folder is not None:
            held = self.spark.read.schema(f"{K.LEDGER_SCHEMA}, open boolean, bucket int").parquet(folder)
            if listed is not None:
                # at most as many numbers as there are buckets: partitions are pruned before the scan
                wanted = [r[0] for r in listed.select(bucket_of(F.col("key"), self.buckets)).distinct().collect()]
                held = held.filter(F.col("open") | F.col("bucket").isin(wanted))
            log = log.unionByName(held.drop("open", "bucket"))
        return K.latest(log)

    def commit(self, rows: DataFrame, read_version: int, writer: str) -> tuple[int, DataFrame, DataFrame]:
        """Append ``rows``, made from the state as of ``read_version``; a row's version is one above the row it replaces.

        Returns the number taken, the rows that hold, and the keys that another writer moved in between.
        """
        folder = uuid.uuid4().hex
        rows.select(*K.LEDGER_COLUMNS).write.parquet(f"{self.path}/data/{folder}")
        mine = self.rows_of([{"folder": folder}])
        raced = mine.select("key").limit(0)
        while not put_if_absent(self.spark, f"{self.path}/commits/{read_version + 1:012d}",
                                json.dumps({"version": read_version + 1, "folder": folder, "writer": writer})):
            now = self.version()
            moved = self.rows_of(self.entries(read_version, now)).groupBy("key").agg(F.max("version").alias("_theirs"))
            met = mine.join(moved, "key", "left")
            lost = met.filter(F.col("_theirs") >= F.col("version"))
            held = met.filter(F.col("_theirs").isNull() | (F.col("_theirs") < F.col("version"))).select(*K.LEDGER_COLUMNS)
            raced, folder, read_version = raced.unionByName(lost.select("key")), uuid.uuid4().hex, now
            held.write.parquet(f"{self.path}/data/{folder}")
            mine = self.rows_of([{"folder": folder}])
        return read_version + 1, mine, raced

    def compact(self) -> int:
        """A snapshot of the state as of the last commit; commits and their rows stay where they are."""
        version = self.version()
        rows = self.state(version).withColumns({"open": F.col("status").isin(*K.OPEN), "bucket": bucket_of(F.col("key"), self.buckets)})
        rows.repartition("open", "bucket").write.partitionBy("open", "bucket").parquet(f"{self.path}/snapshots/{version:012d}-{uuid.uuid4().hex}")
        return version


def fenced_poll(
    ledger: FencedLedger, refs: DataFrame, process: Processor, now: float, run_id: str, max_files: int | None = K.MAX_FILES_PER_POLL,
    max_attempts: int = K.MAX_ATTEMPTS, stale_seconds: int = K.STALE_SECONDS, snapshot_every: int = SNAPSHOT_EVERY,
) -> DataFrame:
    """One poll beside others on the same ledger; the summary has a further column ``raced``.

    Draws from the listing and from all open keys, as ``run_poll`` does with ``from_ledger``. A poll that dies leaves
    claims that go stale. The outcome of a document whose claim went stale and was taken over is dropped: the
    later claim decides.
    """
    when, who = F.lit(float(now)), F.lit(run_id)
    listed = K.keyed_refs(refs)
    read = ledger.version()
    held = ledger.state(read, listed)
    waiting = held.filter(F.col("status").isin(*K.OPEN)).select("key", "display_name")
    listed = listed.unionByName(waiting).groupBy("key").agg(F.min("display_name").alias("display_name"))
    decided = K.decide_claims(listed, held, when, max_attempts, stale_seconds)
    tried = decided
    if max_files is not None:
        tried = decided.filter("claimable").orderBy(F.lower("display_name"), "key").limit(max_files).unionByName(decided.filter("NOT claimable"))
    later = decided.join(tried.select("key"), "key", "left_anti")
    changes = K.apply_claims(tried, who, when).unionByName(K.pending_rows(later, who, when))
    at, written, raced = ledger.commit(changes, read, run_id)
    claimed = written.filter("status = 'processing'")
    try:
        ends = K.mark_outcomes(claimed, process(claimed), who, max_attempts)
        at, terminal, _ = ledger.commit(ends, at, run_id)
    except Exception as error:  # noqa: BLE001 - the work as a whole failed: each claim gets the error and its retries
        outcomes = claimed.select("key", F.lit(False).alias("needs_review"), F.lit(f"{type(error).__name__}: {error}").alias("error"))
        at, terminal, _ = ledger.commit(K.mark_outcomes(claimed, outcomes, who, max_attempts), at, run_id)
    if at - ledger.snapshot()[0] >= snapshot_every:
        ledger.compact()
    marks = claimed.select("key", F.lit(True).alias("claimable")).unionByName(raced.select("key", F.lit(False).alias("claimable")))
    seen = tried.select("key", F.lit(False).alias("_tried")).join(marks, "key", "left").select("key", F.coalesce("claimable", "_tried").alias("claimable"))
    return K.poll_summary(listed.select("key").join(seen, "key", "left"), terminal).withColumn("raced", F.lit(raced.count()))

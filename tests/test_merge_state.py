import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import extraction as X
from auditloom.operators import merge_state as M

SCHEMA = "doc_id int, field_name string, seq bigint, value_text string, confidence double, page int"
KEYS = ("doc_id", "field_name")


def plainly(attempts):
    """The rule as it reads, one attempt after the other."""
    held, tries = None, 0
    for _, value, confidence, page in sorted(attempts):
        tries += 1
        confidence = 0.5 if confidence is None else confidence
        if value is None:
            if held is None or held[0] is None:
                held = (None, None, confidence, tries)
        elif held is None or confidence > held[2]:
            held = (value, page, confidence, tries)
    return (*held, tries)


def table(seed, keys=40):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        for seq in rnd.sample(range(60), rnd.randint(1, 25)):
            rows.append((k, "f", seq, rnd.choice([None, "a", "b", "c"]), rnd.choice([None, 0.1, 0.3, 0.5, 0.65, 0.9]), rnd.randint(1, 9)))
    return rows


def expected(rows):
    by = {}
    for d, f, seq, v, c, p in rows:
        by.setdefault((d, f), []).append((seq, v, c, p))
    return {k: plainly([(s, *rest) for s, *rest in v]) for k, v in by.items()}


def found(held):
    return {(r["doc_id"], r["field_name"]): (r["value_text"], r["page"], r["confidence"], r["extraction_attempts"], r["retry_count"]) for r in held.collect()}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_chunks_of_any_size_give_the_same(spark, span):
    rows = table(span)
    attempts = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(X.merge_extractions(attempts, payload=("value_text", "page"), chunk_rows=span)) == expected(rows)


def test_batches_fold_to_the_whole(spark):
    rows = table(11)
    attempts = spark.createDataFrame(rows, SCHEMA)
    stored = None
    for low, high in ((0, 5), (5, 6), (6, 31), (31, 60)):
        part = M.attempt_summaries(attempts.where(F.col("seq").between(low, high - 1)), KEYS, payload=("value_text", "page"), chunk_span=10)
        stored = M.append(stored, part, KEYS)
    assert found(M.resolved(stored)) == expected(rows)


def test_composing_is_associative(spark):
    rows = table(12, 60)
    attempts = spark.createDataFrame(rows, SCHEMA)
    one, two, three = (M.attempt_summaries(attempts.where(F.col("seq").between(20 * n, 20 * n + 19)), KEYS, payload=("value_text", "page")) for n in range(3))
    left = M.append(M.append(one, two, KEYS), three, KEYS)
    right = M.append(one, M.append(two, three, KEYS), KEYS)
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in right.collect()}
    assert M.resolved(M.append(None, one.limit(0), KEYS)).collect() == []

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from auditloom.operators import extraction as X

SCHEMA = "doc_id int, field_name string, seq int, value_text string, confidence double"


def fold(attempts):
    """Straight reading of the merge: state and one attempt at a time."""
    held = None
    for n, (value, conf) in enumerate(attempts, 1):
        if value is None:
            if held is None or held[0] is None:
                held = (None, conf, n)
        elif held is None or conf > held[1]:
            held = (value, conf, n)
    return held


def merged(spark, groups, chunk_rows):
    rows = [(g, "f", i, v, c) for g, items in enumerate(groups) for i, (v, c) in enumerate(items)]
    random.Random(1).shuffle(rows)
    out = X.merge_extractions(spark.createDataFrame(rows, SCHEMA), chunk_rows=chunk_rows).collect()
    return {r.doc_id: (r.value_text, r.confidence, r.extraction_attempts) for r in out}


def test_documented_cases(spark):
    got = merged(spark, [[("x", .9), (None, .95), ("y", .9), ("z", .97)], [(None, .9), ("v", .8), (None, .1), ("w", .5)]], 100)
    assert got[0][:2] == ("z", .97) and got[1][:2] == ("w", .5)


attempt = st.tuples(st.sampled_from([None, "a", "b", "c"]), st.sampled_from([0.1, 0.3, 0.5, 0.7, 0.9]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(attempt, min_size=1, max_size=14), min_size=20, max_size=40), st.sampled_from([1, 2, 3, 5, 100]))
def test_chunked_merge_equals_fold(spark, groups, chunk_rows):
    got = merged(spark, groups, chunk_rows)
    assert got == {g: fold(items) for g, items in enumerate(groups)}

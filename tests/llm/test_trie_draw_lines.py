"""Conversation trie, importance draw and line dedup against plain versions on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditloom.llm import importance, line_dedup, ordering
from auditloom.llm.prefix_trie import conversation_trie
from auditloom.llm.queries import op11_conversation_trie, op12_importance_resampling, op13_line_dedup
from pyspark.sql import functions as F

NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
LONG = "A line of boilerplate that is certainly long enough"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = sorted(own.get(c - int(math.fmod(c, 100)), []))
        paths[c] = [x[2:] for x in base[:h] + sorted(turns)[h:]]
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
    ends = {k: sha(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k))) for k, m in nodes.items()}
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends[k]) for k, m in nodes.items())


def trie_rows(frame):
    return Counter(tuple(r) for r in conversation_trie(frame).select(*NODE).collect())


CONVERSATION = "conv_id bigint, turn bigint, role string, text string, depth int, block string, turns string, last int, n1 string"


def test_trie_of_awkward_conversations(spark):
    rnd = random.Random(5)
    ids = [None, *range(0, 24), 100, 103, 205, -5, -100, -101, 350]
    rows = [(rnd.choice(ids), rnd.choice([None, *range(9)]), rnd.choice([None, "", "user", "x"]), rnd.choice([None, "", "a", "é🎉"])) for _ in range(260)]
    rows = list({r[:2]: r for r in rows}.values())
    rows += [(600 + i % 3, n, "user", f"turn {n}") for i in range(3) for n in range(40)]  # whole blocks alike
    frame = spark.createDataFrame([(*r, 1, "b", None, 2, "n") for r in rows], CONVERSATION).repartition(3)
    assert trie_rows(frame) == plain_trie(rows)
    assert conversation_trie(frame.limit(0)).collect() == []


def test_trie_takes_repeated_rows_as_turns_and_streams_long_lists(spark):
    rows = [(c, 0, "user", "hello") for c in range(1, 2600)] + [(7, 1, "a", "b")] * 2
    frame = spark.createDataFrame([(*r, 1, "b", None, 2, "n") for r in rows], CONVERSATION).repartition(3)
    assert trie_rows(frame) == plain_trie(rows)


def test_trie_query_equals_plain_version(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in op11_conversation_trie(spark, small_dir).select(*NODE).collect()) == plain_trie(rows)


def test_numbers_run_on_over_slices(spark):
    frame = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    for keys in ([], ["k"]):
        seen = defaultdict(list)
        for r in ordering.numbered(frame, keys, [F.col("v").desc()], "n").collect():
            seen[r["k"] if keys else 0].append((r["n"], -r["v"]))
        assert all([n for n, _ in sorted(x)] == list(range(len(x))) and sorted(v for _, v in x) == [v for _, v in sorted(x)] for x in seen.values())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(lowered(text))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), Counter(zlib.crc32(x.encode()) % importance.BUCKETS for x in words + pairs)


def plain_draw(docs, target):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10000)]
    rows = []
    for i, n, f in found:
        weight = sum(c * gain[b] for b, c in f.items()) // max(1, sum(f.values()))
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_draw_of_awkward_documents(spark):
    rnd = random.Random(3)
    pick = lambda n: " ".join(rnd.choice(["the", "Über", "a1", "x" * 90, "naïve-té", "🎉", "b", "c"]) for _ in range(n))
    docs = [(i, pick(rnd.choice([0, 1, 5, 25, 60, 300]))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, pick(40)), (502, "--- !!"), (3, docs[3][1]), (503, "word " * 400_000), (504, "y" * 3_000_000), (505, pick(30)), (505, pick(30))]
    frame = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in docs], "doc_id bigint, text string, rank int, planes string, n_words int").repartition(3)
    target = spark.createDataFrame([(1, "a1 the b the"), (2, None), (None, "")], "item_id bigint, text string")
    got = importance.resample(frame, target, "item_id").select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == plain_draw(docs, ["a1 the b the", None, ""])
    assert importance.resample(frame.limit(0), target, "item_id").collect() == []
    nothing = importance.resample(frame.limit(20), target.limit(0), "item_id")
    assert nothing.count() == 20


def test_draw_query_equals_plain_version(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("text").collect()]
    assert Counter(tuple(r) for r in op12_importance_resampling(spark, small_dir).collect()) == plain_draw(docs, target)


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_pieces_of_long_texts_and_planes(monkeypatch, size):
    monkeypatch.setattr(importance, "SLICE_BYTES", size)
    rnd = random.Random(size)
    for _ in range(150):
        text = "".join(rnd.choice(["a", "B", "é", "0", " ", "-", "  ", "z" * 70, "\n", "x" * 130]) for _ in range(rnd.randint(1, 200)))
        data = np.frombuffer(text.encode(), np.uint8)
        counts, words = importance.counted(data, np.array([0, len(data)]))
        want = features(text)
        assert words[0] == want[0] and {int(b): int(counts[0][b]) for b in np.flatnonzero(counts[0])} == dict(want[1])
        planes = importance.to_planes(counts)
        assert not planes[0] or (importance.from_planes(planes[0]) == counts[0]).all()
        gain = np.random.default_rng(size).integers(-9000, 9000, importance.BUCKETS)
        assert importance.weighted_sums(planes, *importance.signed_planes(gain))[0] == int((counts[0] * gain).sum())


def plain_lines(docs, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is not None, i or 0)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    keeper = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out[i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    return out


def line_rows(frame):
    kept = line_dedup.kept_text(F.col("text"), F.col("dropped_runs"))
    return Counter(tuple(r) for r in line_dedup.dedup_lines(frame).select("doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256)).collect())


def test_lines_of_awkward_documents(spark):
    rnd = random.Random(9)
    shared = [f"{LONG} {k}" for k in range(6)] + [" " + LONG, "é" * 40, "x" * 39]
    pick = lambda: rnd.choice([*shared, shared[0].upper() + "\r", f" \t{shared[1]}\x0b", "", "short", f"own line {rnd.random()} that nobody else in this table has"])
    docs = [(i, "\n".join(pick() for _ in range(rnd.choice([0, 1, 3, 12])))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "\n\n"), (None, shared[0] + "\n" + shared[1]), (None, shared[2]), (3, docs[3][1]), (3, shared[3]), (80, "\n".join(shared * 500))]
    docs += [(900 + i, f"{LONG} everywhere\n{i}") for i in range(500)]
    frame = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in docs], "doc_id bigint, text string, position int, slice string, h1 int").repartition(5)
    assert line_rows(frame) == plain_lines(docs)
    assert line_dedup.dedup_lines(frame.limit(0)).collect() == []


def test_bitmap_runs_hold_positions_not_texts(spark):
    docs = [(i, f"a\n{LONG}\n{LONG}\nb\n{LONG}") for i in range(6)]
    marks = line_dedup.keep_bitmaps(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["dropped_runs"]] for r in marks} == {i: [(1, 2), (4, 1)] for i in range(5)}
    assert not any("text" in f and f != "text_hash" for f in marks[0].asDict())


def test_lines_query_equals_plain_version(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op13_line_dedup(spark, small_dir).collect()) == plain_lines(docs)

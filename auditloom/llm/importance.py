"""Importance resampling towards a target, with exact weights from bit-sliced counts.

Features of a document are its words and pairs of neighbouring words, each hashed to one of ``BUCKETS``
buckets. A document's bucket counts are written once as bit planes: plane j holds, for every bucket, bit
j of its count, 10,000 bits in all, and only as many planes as its largest count needs. Everything
else comes from planes. Corpus totals per bucket are sums of bits times powers of two, first inside a
task and then in Spark. The gains of the buckets (target against corpus) become signed planes in two's
complement, and a document's weighted sum is

    sum over j, k of +-2^(j+k) * popcount(count plane j AND gain plane k),

an exact integer. Scores add hash-random Gumbel noise, so the highest scores are a draw without
replacement in proportion to the exponential of the weights; ranks come from ranges of (score, id).

Only the totals, one number per bucket, reach the driver. Texts are cut into pieces between words; a
text of any length is held as its pieces and one array of counts.

Defined results: null text has no words; a document without words has weight 0; fewer than ``min_words``
words are never drawn; ties in score go to the smaller ``doc_id``, null last; rows that share a ``doc_id``
share their noise and rank one after the other; empty tables give empty results, an empty target counts
as zeros. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize
from .ordering import numbered
from .rolling import LOWER, text_slices

BUCKETS = 10_000
#: A plane as whole 64-bit words.
PLANE_BYTES = -(-BUCKETS // 64) * 8
MIN_WORDS, DRAW_PERCENT, NOISE_SEED = 20, 25, 7
#: Documents whose counts are dense at once, bytes of text at once, longest word hashed in step with others.
DENSE_DOCS, SLICE_BYTES, STEP_BYTES = 64, 1 << 20, 64

#: Fixed value: bytes of words (digits, lower-case letters, anything beyond ASCII).
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def _byte_table() -> np.ndarray:
    """Step of the reflected CRC-32 for each byte."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """For n up to STEP_BYTES: what n zero bytes make of each byte of a checksum at each place."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).astype(np.uint32)
    tables = [state]
    for _ in range(STEP_BYTES):
        state = STEP[state & 255] ^ (state >> np.uint32(8))
        tables.append(state)
    return np.stack(tables)


SHIFT = _shift_tables()
_ONES = np.uint32(0xFFFFFFFF)


def _shifted(checksum: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after ``n`` zero bytes: XOR with the checksum of n bytes gives that of the whole."""
    out = SHIFT[n, 0, checksum & 255]
    for place in (1, 2, 3):
        out ^= SHIFT[n, place, (checksum >> np.uint32(8 * place)) & 255]
    return out


def _word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts, joined: text, start and bucket of each word; text and bucket of each pair of words."""
    inside = IS_WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.concatenate([inside[1:], [False]])
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    length = end - start
    text = np.searchsorted(offsets, start, "right") - 1
    # all words in step, one byte at a time, longest first; a long word by itself
    steps = np.minimum(length, STEP_BYTES + 1)
    order = np.argsort(-steps.astype(np.int8), kind="stable")
    ordered, left = start[order], np.bincount(steps, minlength=STEP_BYTES + 2)
    state = np.full(len(start), _ONES)
    live = len(start)
    for k in range(STEP_BYTES):
        live -= left[k]
        if not live:
            break
        now = state[:live]
        state[:live] = STEP[(now ^ data[ordered[:live] + k]) & 255] ^ (now >> np.uint32(8))
    raw = np.empty_like(state)
    raw[order] = state
    for i in np.flatnonzero(length > STEP_BYTES):
        raw[i] = np.uint32(zlib.crc32(data[start[i]:end[i]])) ^ _ONES
    word = raw ^ _ONES
    spaced = STEP[(raw ^ np.uint32(32)) & 255] ^ (raw >> np.uint32(8)) ^ _ONES
    first = np.flatnonzero(text[:-1] == text[1:])
    second = first + 1
    pair = _shifted(spaced[first], np.minimum(length[second], STEP_BYTES)) ^ word[second]
    for i in np.flatnonzero(length[second] > STEP_BYTES):
        pair[i] = zlib.crc32(data[start[second[i]]:end[second[i]]], int(spaced[first[i]]))
    return text, start, word % BUCKETS, text[first], pair % BUCKETS


def _long_counts(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Bucket counts and words of one long text, in pieces that share one word."""
    counts, words, begin, size = np.zeros(BUCKETS, np.int64), 0, 0, SLICE_BYTES
    while True:
        stop = begin + size
        while stop < len(data) and IS_WORD[data[stop]]:
            gap = np.flatnonzero(~IS_WORD[data[stop:stop + SLICE_BYTES]])
            stop += int(gap[0]) if len(gap) else SLICE_BYTES
        piece = data[begin:stop]
        _, start, word, _, pair = _word_buckets(piece, np.array([0, len(piece)]))
        if stop < len(data) and len(start) == 1 and start[0] == 0:
            size *= 2
            continue
        known = int(begin > 0 and len(start) > 0)
        counts += np.bincount(word[known:], minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)
        words += len(start) - known
        if stop >= len(data):
            return counts, words
        if len(start):
            begin, size = begin + int(start[-1]), SLICE_BYTES
        else:
            # nothing shared: a piece of separators only, which can only be the first
            data, begin = data[stop:], 0


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts (texts x buckets) and words of joined texts."""
    data, n = LOWER[data], len(offsets) - 1
    if n == 1 and len(data) > SLICE_BYTES:
        counts, words = _long_counts(data)
        return counts[None, :], np.array([words])
    text, _, word, pair_text, pair = _word_buckets(data, offsets)
    cells = np.concatenate([text * BUCKETS + word, pair_text * BUCKETS + pair])
    return np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS), np.bincount(text, minlength=n)


def to_planes(counts: np.ndarray) -> list[bytes]:
    """Bit planes of each row of counts, lowest first, as many as its largest count needs."""
    most = counts.max(axis=1)
    kind = np.uint16 if most.max(initial=0) < 1 << 16 else np.uint64
    counts, deep = counts.astype(kind), [int(x).bit_length() for x in most]
    packed = np.zeros((max(deep, default=0), len(counts), PLANE_BYTES), np.uint8)
    for j in range(len(packed)):
        packed[j, :, :-(-BUCKETS // 8)] = np.packbits((counts >> kind(j)).astype(np.uint8) & 1, axis=1)
    return [packed[:d, i].tobytes() for i, d in enumerate(deep)]


def from_planes(planes: bytes) -> np.ndarray:
    """Bucket counts of planes."""
    rows = np.frombuffer(planes, np.uint8).reshape(-1, PLANE_BYTES)
    bits = np.unpackbits(rows, axis=1)[:, :BUCKETS].astype(np.int64)
    return (bits << np.arange(len(rows))[:, None]).sum(axis=0)


def feature_planes(texts: DataFrame, keep: str) -> DataFrame:
    """(``keep``, n_words, n_features, planes) of each text, written as a table."""
    rows = texts.select(F.col(keep).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = StructType([StructField("id", rows.schema["id"].dataType)]).add("n_words", "long").add("n_features", "long").add("planes", "binary")

    def plane_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DENSE_DOCS):
                for part, data, offsets in text_slices(batch.slice(at, DENSE_DOCS), "text", SLICE_BYTES):
                    counts, words = counted(data, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(words, pa.int64()), pa.array(np.maximum(0, 2 * words - 1), pa.int64()), pa.array(to_planes(counts), pa.binary())],
                        names=["id", "n_words", "n_features", "planes"])

    return materialize(rows.mapInArrow(plane_rows, out).withColumnRenamed("id", keep), "planes")


def bucket_totals(planes: DataFrame) -> np.ndarray:
    """Features in each bucket, over all texts: one number per bucket reaches the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column("planes"):
                if len(planes := value.as_py()):
                    total += from_planes(planes)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    rows = planes.select("planes").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS, np.int64)
    for r in rows:
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: the log of its share in the target over its share in the corpus, in thousandths."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all) / (float(s + 1) * float(t_all))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def signed_planes(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Two's complement planes of signed values as 64-bit words, and what a bit in each plane is worth."""
    width = max(int(np.abs(values).max(initial=0)).bit_length(), 1) + 1
    bits = (values[None, :] >> np.arange(width)[:, None]) & 1
    planes = np.zeros((width, PLANE_BYTES), np.uint8)
    planes[:, :-(-BUCKETS // 8)] = np.packbits(bits.astype(np.uint8), axis=1)
    return planes.view(np.uint64), [1 << k for k in range(width - 1)] + [-(1 << (width - 1))]


def weighted_sums(planes: list[bytes], gain_planes: np.ndarray, worth: list[int]) -> np.ndarray:
    """Sum of gains over the features of each document: AND, popcount and powers of two."""
    words = PLANE_BYTES // 8
    rows = np.frombuffer(b"".join(planes), np.uint64).reshape(-1, words)
    deep = np.array([len(p) // PLANE_BYTES for p in planes])
    of_plane = np.zeros(len(rows), np.int64)
    for plane, value in zip(gain_planes, worth):
        of_plane += value * np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64)
    doc = np.repeat(np.arange(len(planes)), deep)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(deep) - deep, deep)
    sums = np.zeros(len(planes), np.int64)
    np.add.at(sums, doc, of_plane << level)
    return sums


def noise(doc_id: object) -> int:
    """Gumbel noise of a document in thousandths, from a hash of its id."""
    name = "" if doc_id is None else str(doc_id)
    draw = (int(hashlib.sha256(f"{NOISE_SEED}:{name}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
    return math.floor(-1000 * math.log(-math.log(draw)))


def importance_scores(planes: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) from feature planes."""
    gain_planes, worth = signed_planes(gain)
    out = StructType([planes.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight", "score")]])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = np.array(part.column("n_features"), np.int64)
                weight = weighted_sums(part.column("planes").to_pylist(), gain_planes, worth) // np.maximum(n, 1)
                score = weight + np.array([noise(i) for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), part.column("n_features"), pa.array(weight), pa.array(score)], names=out.names)

    return materialize(planes.mapInArrow(scored, out), "scores")


def resample(docs: DataFrame, target: DataFrame, target_id: str, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Weight, score and rank (null: not drawn) of every document, drawn towards the texts of ``target``."""
    planes = feature_planes(docs, "doc_id")
    gain = gains(bucket_totals(planes), bucket_totals(feature_planes(target, target_id)))
    scores = importance_scores(planes, gain)
    able = scores.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = numbered(able, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scores.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("place").unionByName(rest)

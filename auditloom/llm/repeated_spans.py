"""Removal of byte strings of ``LENGTH`` bytes that start more than once: radix passes over suffixes.

Suffixes are ordered only through ``LENGTH`` bytes, most significant digits first, and only as far as
they are undecided; suffixes that fall into a group of one leave the sort. Three passes:

1. The first digit is ``DIGIT`` bytes at an anchor. The anchor of a window is the smallest hash among
   the digits that lie inside it, a function of the window's own bytes, so equal windows have equal
   digits at equal places; windows that follow each other mostly share their anchor, hence one row
   stands for about fifty suffixes. Digits met once are done.
2. The next digit is all bytes of the windows of one anchor. If those are equal, all windows are
   repeated and done. What remains are anchors whose digit repeats in different surroundings, near the
   ends of repeated passages.
3. For these each window is a suffix of its own, ordered by all its bytes: equal groups are exactly the
   repeated windows.

Texts travel once, in compressed blocks; the passes exchange digits (64-bit hashes of the bytes) with
the blocks and get back a few bits for each row. A passage that occurs everywhere is one row per block.

Defined results: null or empty text has no bytes; texts shorter than a window lose nothing; a run of
equal bytes longer than a window repeats within itself; repeated rows repeat each other; null ids pass
through; further columns are ignored; texts of any length stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .rolling import RangeHash, mixed, text_slices

LENGTH = 200
DIGIT = 100
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 19
_CODEC = "zstd"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[RangeHash, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the bytes; per anchor its place and the first and last start of the windows it stands for."""
    ranges = RangeHash(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return ranges, none, none, none
    width = LENGTH - DIGIT + 1  # digits inside one window
    at = np.arange(n - DIGIT + 1)
    bits = np.uint64(max(16, int(n).bit_length()))
    order = (ranges.of(at, at + DIGIT) >> bits << bits) | at.astype(np.uint64)
    # minimum over each run of ``width`` digits: of a block's tail and of the next block's head
    blocks = -(-len(order) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:len(order)] = order
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - LENGTH + 1)
    least = np.minimum(tail[starts], head[starts + width - 1]) & ((np.uint64(1) << bits) - np.uint64(1))
    # windows must not reach into the next text
    doc_end = np.repeat(offsets[1:], np.diff(offsets))[starts]
    valid = starts + LENGTH <= doc_end
    starts, place = starts[valid], least[valid].astype(np.int64)
    if not len(starts):
        return ranges, none, none, none
    change = np.nonzero((place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))[0] + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change, [len(starts)]]) - 1
    return ranges, place[first], starts[first], starts[last]


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, payload): documents in compressed blocks of bounded size, written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, _, _ in text_slices(whole, "text", BLOCK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["payload"])

    rows = docs.select(F.col("doc_id").cast(kind), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    packed = rows.mapInArrow(run, "payload binary").withColumn("block", F.monotonically_increasing_id())
    return materialize(packed.select("block", "payload"), "blocks")


def _opened(payload: pa.Scalar) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def _slices(payload: pa.Scalar) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return text_slices(_opened(payload), "text", SLICE_BYTES)


def _class_key(ranges: RangeHash, place: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Hash of all bytes that the windows of an anchor cover, and of their place around it."""
    return mixed(ranges.of(s0, s1 + LENGTH) + mixed(((place - s0) * 1024 + (s1 - s0)).astype(np.uint64)))


def anchor_rows(blocks: DataFrame) -> DataFrame:
    """(digit, class, block, row, n): the distinct anchor classes of each block; ``row`` counts its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                digits, classes = [], []
                for _, data, offsets in _slices(payload):
                    ranges, place, s0, s1 = anchors(data, offsets)
                    digits.append(ranges.of(place, place + DIGIT))
                    classes.append(_class_key(ranges, place, s0, s1))
                digit, kind = np.concatenate(digits or [np.zeros(0, np.uint64)]), np.concatenate(classes or [np.zeros(0, np.uint64)])
                _, row, n = np.unique(kind, return_index=True, return_counts=True)
                keep = np.argsort(row)
                row, n = row[keep], n[keep]
                yield pa.RecordBatch.from_arrays([
                    pa.array(digit[row].view(np.int64)), pa.array(kind[row].view(np.int64)), pa.array(np.full(len(row), block, np.int64)),
                    pa.array(row.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))], ["digit", "class", "block", "row", "n"])

    return blocks.mapInArrow(run, "digit bigint, class bigint, block bigint, row int, n int")


#: What is known of an anchor class: all its windows are repeated; its windows take part in the last pass.
ALL, LAST_PASS = 1, 2


def anchor_codes(rows: DataFrame) -> DataFrame:
    """(block, codes): per block ``row * 4 + code`` of the anchor classes that are not done and unique."""
    kind = Window.partitionBy("digit", "class")
    ordered = kind.orderBy("block", "row")
    known = rows.repartition("digit").withColumn("nth", F.row_number().over(ordered)).withColumn("copies", F.sum("n").over(kind))
    known = known.withColumn("classes", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("digit")))
    code = F.when(F.col("copies") > 1, ALL).otherwise(0) + F.when((F.col("classes") > 1) & (F.col("nth") == 1), LAST_PASS).otherwise(0)
    return known.select("block", (F.col("row") * 4 + code).alias("code")).where("code % 4 > 0").groupBy("block").agg(F.collect_list("code").alias("codes"))


def _coded(payload: pa.Scalar, codes: np.ndarray) -> Iterator[tuple]:
    """The slices of a block with the code of each anchor."""
    slices = []
    for part, data, offsets in _slices(payload):
        ranges, place, s0, s1 = anchors(data, offsets)
        slices.append((part, data, offsets, ranges, s0, s1, _class_key(ranges, place, s0, s1)))
    kinds = np.concatenate([x[-1] for x in slices]) if slices else np.zeros(0, np.uint64)
    _, first, group = np.unique(kinds, return_index=True, return_inverse=True)
    by_row = np.zeros(len(kinds), np.int64)
    by_row[codes // 4] = codes % 4
    code = by_row[first][group]  # copies within the block share the code of the first
    owner = np.zeros(len(kinds), bool)
    owner[codes[codes % 4 >= LAST_PASS] // 4] = True
    at = 0
    for part, data, offsets, ranges, s0, s1, kind in slices:
        yield part, data, offsets, ranges, s0, s1, code[at:at + len(kind)], owner[at:at + len(kind)]
        at += len(kind)


def _spread(s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts of the given ranges, and which range each belongs to."""
    n = s1 - s0 + 1
    of = np.repeat(np.arange(len(n)), n)
    return s0[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def window_rows(coded: DataFrame) -> DataFrame:
    """(key, block, row, known): windows of the anchors in the last pass; ``row`` counts the open ones, -1: known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, codes in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("codes").to_pylist(), strict=True):
                base = 0
                for _, _, _, ranges, s0, s1, code, owner in _coded(payload, np.array(codes or [], np.int64)):
                    start, of = _spread(s0[owner], s1[owner])
                    key = ranges.of(start, start + LENGTH)
                    still = (code[owner] & ALL == 0)[of]
                    row = np.where(still, base + np.cumsum(still) - 1, -1)
                    base += int(still.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), block, np.int64)), pa.array(row.astype(np.int32))],
                                                     ["key", "block", "row"])

    return coded.mapInArrow(run, "key bigint, block bigint, row int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(block, repeated): the open windows of each block whose bytes occur in another anchor class."""
    same = F.count("*").over(Window.partitionBy("key"))
    return windows.repartition("key").withColumn("same", same).where("same > 1 and row >= 0").groupBy("block").agg(F.collect_list("row").alias("repeated"))


def _runs(cover: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes in a text, from its first byte."""
    step = np.diff(np.concatenate([[0], cover[a:b].view(np.int8), [0]]))
    return list(zip(np.nonzero(step == 1)[0].tolist(), np.nonzero(step == -1)[0].tolist(), strict=True))


def remove_repeats(docs: DataFrame, keep_spans: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_spans`` the removed spans and the text left (bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", spans array<struct<start:bigint,end:bigint>>, kept binary" * keep_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, codes, repeated in zip(batch.column("payload"), batch.column("codes").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
                hit = np.zeros(max(repeated, default=-1) + 1 if repeated else 0, bool)
                hit[np.array(repeated or [], np.int64)] = True
                base = 0
                for part, data, offsets, _, s0, s1, code, owner in _coded(payload, np.array(codes or [], np.int64)):
                    full = code & ALL > 0
                    edge = np.zeros(len(data) + LENGTH + 1, np.int32)
                    np.add.at(edge, s0[full], 1)
                    np.add.at(edge, s1[full] + LENGTH, -1)
                    still = owner & ~full
                    start, _ = _spread(s0[still], s1[still])
                    rows = np.arange(base, base + len(start))
                    base += len(start)
                    start = start[rows < len(hit)][hit[rows[rows < len(hit)]]]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + LENGTH, -1)
                    cover = np.cumsum(edge)[:len(data)] > 0
                    out = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                        runs = _runs(cover, a, b)
                        left = data[a:b][~cover[a:b]].tobytes() if runs else data[a:b].tobytes()
                        out["n_bytes"].append(b - a)
                        out["n_removed"].append(b - a - len(left))
                        out["n_spans"].append(len(runs))
                        out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                        if keep_spans:
                            out["spans"].append([{"start": x, "end": y} for x, y in runs])
                            out["kept"].append(left)
                    columns = [part.column("doc_id"), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"])]
                    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                    if keep_spans:
                        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                        columns += [pa.array(out["spans"], span), pa.array(out["kept"], pa.binary())]
                        names += ["spans", "kept"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    blocks = blocks_of(docs)
    codes = materialize(anchor_codes(anchor_rows(blocks)), "codes")
    repeated = materialize(repeated_windows(window_rows(blocks.join(codes.hint("shuffle_hash"), "block").select("block", "payload", "codes"))), "repeated")
    answers = codes.join(repeated, "block", "left")
    return blocks.join(answers.hint("shuffle_hash"), "block", "left").select("payload", "codes", "repeated").mapInArrow(run, schema)

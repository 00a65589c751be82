"""Best-fit packing: a configuration linear program over the histogram of lengths, rounded.

Documents are tokenized in tasks; only texts longer than a sequence are cut. What the driver sees is the
histogram of piece lengths (at most one count per possible length). A configuration is a multiset of
lengths that fits in one sequence. The linear program over configurations (least total, every length
covered) is solved by multiplicative weights: prices start at the best of some dual feasible functions and
move with the share of each length that a round covers, a knapsack over the prices finds the best filling of
every remaining capacity, and the rounds' answers add up to fractional counts. These are rounded down, what
that leaves is solved again, and the last fractions are packed by best fit, in counts.

The plan is a list of slots: of length L, the pieces ranked r0 to r1 go to sequences b to b + r1 - r0 at
a fixed offset. Ranks of pieces within a length are distributed prefix sums over hash buckets, so a
length that most pieces share (the full one) is no single group; slots are looked up inside tasks.

Defined results: null text counts as empty and is one piece, its end mark; null ids and repeated rows
are packed like others; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import segment_encoder

CAPACITY = 2048
#: Pieces of one hash bucket, about.
BUCKET_ROWS = 50_000
#: The linear program: rounds of pricing and how many of them only settle prices; the first step of the weights, and the
#: round by which it has halved; how far an answer may lie below the best one, narrowing alike; then how often the program is solved
#: again, and the share of the volume that a rounding has to take for that.
ROUNDS = 40
WARM_UP = 20
STRENGTH = 0.1
SETTLE = 8
SLACK = 0.01
PASSES = 4
TAKEN_SHARE = 0.1
SLICE_ROWS = 256


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32 bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = segment_encoder(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                rows, ids = defaultdict(list), []
                for doc, text in enumerate(batch.column("_text").to_pylist()):
                    data = encode(text) + end
                    n = len(data) // 4
                    cut = n % capacity or capacity
                    for k, (a, b) in enumerate(zip([0, *range(cut, n, capacity)], range(cut, n + 1, capacity), strict=True)):
                        part = data[4 * a:4 * b]
                        for name, value in (("doc", doc), ("piece", k), ("start", a), ("length", b - a), ("crc", zlib.crc32(part))):
                            rows[name].append(value)
                        if keep_ids:
                            ids.append(part)
                columns = [batch.column("doc_id").take(pa.array(rows["doc"], pa.int64())), pa.array(rows["piece"], pa.int32()),
                           pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["crc"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def _fillings(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knapsack by capacity: worth of the best filling, the length it takes last, and the capacity it really uses."""
    value, last, used = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c], used[c] = value[c - 1], used[c - 1]
        m = fits[c]
        if m:
            with_last = value[c - lengths[:m]] + prices[:m]
            k = int(with_last.argmax())
            if with_last[k] > value[c]:
                value[c], last[c], used[c] = with_last[k], lengths[k], c
    return value, last, used


def first_prices(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Prices by length at which no configuration is worth more than 1: the best known family member for ``counts``.

    Members: the share of a sequence; pieces beyond a threshold of room count whole and those below the threshold
    nothing; whole multiples of a unit fraction. Their total worth is a lower bound of any packing.
    """
    size = np.arange(capacity + 1)
    family = [size / capacity]
    for small in np.nonzero(counts[:capacity // 2 + 1])[0]:
        family.append(np.where(size > capacity - small, 1.0, np.where(size >= small, size / capacity, 0.0)))
    family += [np.maximum(np.minimum(((parts + 1) * size - 1) // capacity, parts), 0) / parts for parts in range(1, 21)]
    return max(family, key=lambda prices: float(prices @ counts))


def fractional_configurations(counts: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[int, ...], float]:
    """A fractional cover of ``counts`` (pieces by length) by configurations, scaled to cover the volume once.

    In each round the knapsack finds the best configuration through each length at the present prices. All within
    ``SLACK`` of the best one are answers of the oracle; they share the round's pieces, the least covered lengths
    first. Lengths that the answers cover less than the average get dearer. Rounds after ``WARM_UP`` add up.
    """
    lengths = np.nonzero(counts)[0]
    if not len(lengths):
        return {}
    size = np.arange(capacity + 1) / capacity
    # among equals the longer piece is the dearer, as it has fewer places to go
    start = (0.95 * first_prices(counts, capacity) + 0.05 * size) * (1 + 0.001 * size)
    log_price = np.zeros(capacity + 1)
    covered = np.zeros(capacity + 1)
    mass: dict[tuple[int, ...], float] = defaultdict(float)
    volume = lengths * counts[lengths]
    for round_no in range(ROUNDS):
        prices = start[lengths] * np.exp(log_price[lengths])
        value, last, used = _fillings(lengths, prices, capacity)
        worth = prices + value[capacity - lengths]
        least = (1 - SLACK / (1 + round_no / SETTLE)) * worth.max()
        good = lengths[worth >= least]
        price_of = np.zeros(capacity + 1)
        price_of[lengths] = prices
        budget = np.zeros(capacity + 1)
        budget[lengths] = counts[lengths]
        for first in good[np.argsort(covered[good], kind="stable")]:
            config, c = [int(first)], int(used[capacity - first])
            while c:
                config.append(int(last[c]))
                c = int(used[c - last[c]])
            # pieces that the round has used up fall out as long as the rest is still a good answer
            while True:
                config = [length for length in config if budget[length] > 0]
                if not config or price_of[config].sum() < least:
                    break
                sizes, times = np.unique(config, return_counts=True)
                step = (budget[sizes] / times).min()
                budget[sizes] -= step * times
                budget[sizes[budget[sizes] <= 1e-9 * counts[sizes]]] = 0
                if round_no >= WARM_UP:
                    mass[tuple(sorted(config, reverse=True))] += float(step)
        share = 1 - budget[lengths] / counts[lengths]
        covered[lengths] += share
        log_price[lengths] += STRENGTH / (1 + round_no / SETTLE) * ((share * volume).sum() / volume.sum() - share)
    scale = volume.sum() / sum(sum(config) * x for config, x in mass.items())
    return {config: x * scale for config, x in mass.items()}


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), covering the histogram exactly.

    Fractional masses are rounded down, the largest first, and the program is solved again for what that
    leaves while rounding still takes a share of it; best fit packs the fractions that remain.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    found: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        found.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.arange(capacity + 1)
    for _ in range(PASSES):
        before = int((lengths * left).sum())
        if not before:
            break
        for config, x in sorted(fractional_configurations(left, capacity).items(), key=lambda item: (-item[1], item[0])):
            sizes, times = np.unique(config, return_counts=True)
            whole = min(int(x), int((left[sizes] // times).min()))
            if whole:
                left[sizes] -= whole * times
                found.append((config, whole))
        if before - int((lengths * left).sum()) < TAKEN_SHARE * before:
            break
    return found + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length over counts: equal bins stay together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in np.nonzero(left)[0][::-1]:
        length, n = int(length), int(left[length])
        moved: list[tuple[tuple[int, ...], int, int]] = []
        for room in sorted(r for r in bins if r >= length):
            for config in list(bins[room]):
                if not n:
                    break
                # a bin takes as many as fit, bins of one kind first
                per_bin = min(room // length, n)
                k = min(bins[room][config], n // per_bin)
                bins[room][config] -= k
                if not bins[room][config]:
                    del bins[room][config]
                n -= k * per_bin
                moved.append((config + (length,) * per_bin, room - per_bin * length, k))
            if not bins[room]:
                del bins[room]
        per_bin = capacity // length
        if n >= per_bin:
            moved.append(((length,) * per_bin, capacity - per_bin * length, n // per_bin))
        if n % per_bin:
            moved.append(((length,) * (n % per_bin), capacity - (n % per_bin) * length, 1))
        for config, room, k in moved:
            bins[room][config] = bins[room].get(config, 0) + k
    return [(config, k) for kinds in bins.values() for config, k in kinds.items()]


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, sequences of the first ranks, offsets; ascending by rank."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for config, times in found:
        offset = 0
        for length in config:
            out[length].append((ranks[length], base, offset))
            ranks[length] += times
            offset += length
        base += times
    return {length: tuple(np.array(rows, np.int64).T) for length, rows in out.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Materialized ``pieces`` (doc_id, piece, start, length, ids_crc32, ..) with sequence_id and offset."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(configurations(histogram, capacity))
    buckets = max(8, math.ceil(sum(histogram.values()) / BUCKET_ROWS))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    parts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.join(parts, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1).select(*pieces.columns, "_rank")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields] + ["sequence_id bigint", "offset bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at = np.nonzero(length == value)[0]
                firsts, bases, offsets = plan[int(value)]
                k = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at] = bases[k] + rank[at] - firsts[k]
                offset[at] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Placement of every piece of every document; with ``keep_ids`` also its token ids."""
    return place(materialize(token_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity)

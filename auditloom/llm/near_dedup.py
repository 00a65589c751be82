"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets are one class, found by a 128-bit key of the set, whose 64-bit hash is
the id below; what follows works on one representative per class. Signatures are cut into bands; equal bands make candidates. In a first
round each member of a bucket meets only the bucket's smallest member, so a group of thousands costs
one pair per member. In a second round, what is not yet connected inside a bucket meets across the
components, the largest one's members left out among themselves: in pieces of two blocks signatures are
compared, plausible pairs are confirmed on full sets at once, the most similar first, and pairs that the
piece has connected are skipped. So no candidate link between different groups is lost, yet pairs are
never written out: a piece returns at most one link for each of its ids.

A pair is judged by batches of its signatures: with m of n equal and a uniform prior, the similarity is
beta distributed and P(similarity >= threshold) is a binomial tail; below ``MISS`` the pair is dropped.
Survivors are confirmed on the full shingle sets, 100 * intersection >= 75 * union.

Chances: a link at the threshold is no candidate with (1 - 0.75^4)^32, about 5 in a million; the
judgement drops it at ``MISS`` per batch. Shingles are 64-bit hashes.

Defined results: null or empty text has no shingles, is its own component and is kept; rows without id
are linked with nothing, their component is null and they are kept; rows that share an id are each
judged by their own text; repeated rows get equal results, and ``keep_one`` leaves one row of each group;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import materialize, ordered_by, unpacked, whole_row
from .components import components
from .rolling import IS_SPACE, LOWER, RangeHash, mixed, text_slices

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signatures for the rounds inside buckets, where many pairs lie just below the threshold.
LONG_HASHES = 768
#: Chance to drop a link at one look at the signatures, and signatures per look.
MISS = 1e-5
BATCH = 16
#: Ids of one block of a bucket.
BLOCK = 512
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 2**63, LONG_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, LONG_HASHES, dtype=np.uint64)
_K = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    n_docs = len(offsets) - 1
    data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space])[:len(data)] | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:] if len(data) else np.zeros(0, bool)
    starts, ends = np.nonzero(~space & before)[0], np.nonzero(~space & after)[0] + 1
    words = RangeHash(data).of(starts, ends)
    first = np.searchsorted(starts, offsets)  # words before each text
    grams = np.zeros(0, np.uint64)
    m = len(words) - SHINGLE_WORDS + 1
    if m > 0:
        acc = words[:m].copy()
        for k in range(1, SHINGLE_WORDS):
            acc = acc * _K + words[k:k + m]
        grams = mixed(acc)
    sets = []
    for d in range(n_docs):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= SHINGLE_WORDS:
            sets.append(np.unique(grams[a:b - SHINGLE_WORDS + 1]))
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    acc = acc * _K + w
            sets.append(mixed(np.array([acc], np.uint64)))
        else:
            sets.append(grams[:0])
    return sets


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """128-bit keys of sets (empty: none)."""
    return [np.array([s.sum(), mixed(s ^ _K).sum()], np.uint64).tobytes() if len(s) else None for s in sets]


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minima of so many hash functions over a set, 32 bits each."""
    best = np.full(hashes, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at:at + 2048] * _MULTIPLY[:hashes, None]
        part += _ADD[:hashes, None]
        best = np.minimum(best, (part >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return best


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (binary), bands (64-bit keys), short (16 bits of each signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in text_slices(whole, "_text", SLICE_BYTES):
                sets = shingle_sets(data, offsets)
                keys = set_keys(sets)
                rows = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
                acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
                for k in range(ROWS):
                    acc = acc * _K + rows.reshape(-1, BANDS, ROWS)[:, :, k]
                bands = mixed(acc).view(np.int64)
                short = rows.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    pa.array([b.tobytes() for b in bands], pa.binary()), pa.array([s.tobytes() for s in short], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "bands", "short"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands binary, short binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, id): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], ["band", "id"])

    return classes.select("id", "bands").mapInArrow(run, "band bigint, id bigint")


def least_matches(hashes: int = HASHES, threshold: float = PERCENT / 100, miss: float = MISS) -> list[tuple[int, int, int]]:
    """Looks (from, to, fewest matches up to there that leave P(similarity >= threshold) >= miss); they grow by halves."""
    found, start = [], 0
    while start < hashes:
        n = min(hashes, max(BATCH, start + start // 2))
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
        found.append((start, n, m))
        start = n
    return found


def long_signatures(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, signs, shingles): ``LONG_HASHES`` signatures of 16 bits beside the full sets of the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [signature(np.frombuffer(x.as_buffer(), np.uint64), LONG_HASHES).astype(np.uint16).tobytes() for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signs, pa.binary()), batch.column("shingles")], ["id", "signs", "shingles"])

    return sets.join(ids, "id", "left_semi").select("id", "shingles").mapInArrow(run, "id bigint, signs binary, shingles binary")


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sequential look at their signatures doesn't rule out."""
    bounds = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint16).reshape(-1, HASHES)
            right = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint16).reshape(-1, HASHES)
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for start, n, least in bounds:
                matches[alive] += (left[alive, start:n] == right[alive, start:n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.take(pa.array(alive)).select(["a", "b"])

    one = classes.select(F.col("id").alias("a"), F.col("short").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("short").alias("sb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, shingles): sorted hashes of the full sets of the classes in ``ids`` (id, doc_id), one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in text_slices(whole, "text", SLICE_BYTES):
                sets = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(set_keys(sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 ["doc_id", "set_key", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = rows.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id bigint, set_key binary, shingles binary").where("set_key is not null")
    found = materialize(found.select("doc_id", F.xxhash64("set_key").alias("id"), "shingles"), "sets")
    if repeated.isEmpty():
        return found.select("id", "shingles")
    many = found.join(repeated, "doc_id", "left_semi").join(ids, ["id", "doc_id"], "left_semi").groupBy("id").agg(F.any_value("shingles").alias("shingles"))
    return materialize(found.join(repeated, "doc_id", "left_anti").select("id", "shingles").union(many), "sets")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the pairs: confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)):
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted batches, each whole."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches(([*rest.to_batches(), batch] if rest is not None else [batch]))
        rows = rest.num_rows
        if not rows:
            continue
        change = np.zeros(rows - 1, bool)
        for k in keys:
            column = rest.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.nonzero(change)[0] + 1)]
        whole = rest.combine_chunks()
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield from whole.slice(start, stop - start).to_batches()
        rest = whole.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield from rest.combine_chunks().to_batches()


def block_links(placed: DataFrame, signs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between components inside buckets: enough of them to connect all that any link connects.

    Members of a bucket's largest component need not meet each other, so only the others form blocks that
    meet the whole bucket: blocks of the others and chunks of the largest component, about ``BLOCK`` ids
    each, and every (block, block or chunk) is one piece of work. A piece looks at the signatures, then at
    the full sets of plausible pairs, the most similar first, and skips pairs that its own links connect
    already; so what it returns grows with its ids, not with its pairs. A pair belongs to the first band
    that its ids share.
    """
    bounds = least_matches(LONG_HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["band", "lo", "hi"]):
            ids, comps = g.column("id").to_numpy(), np.unique(g.column("component").to_numpy(), return_inverse=True)[1]
            signs = np.frombuffer(b"".join(g.column("signs").to_pylist()), np.uint16).reshape(-1, LONG_HASHES)
            bands = np.frombuffer(b"".join(g.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
            own, lo, hi = g.column("own").to_numpy(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            if lo == hi:
                i, j = np.triu_indices(len(ids), 1)
            else:
                i, j = (x.ravel() for x in np.meshgrid(np.nonzero(own == lo)[0], np.nonzero(own == hi)[0], indexing="ij"))
            across = comps[i] != comps[j]
            i, j = i[across], j[across]
            same = np.zeros(len(i), np.int64)
            for start, n, least in bounds:
                part = signs[:, start:n]
                for at in range(0, len(i), 1 << 16):
                    same[at:at + (1 << 16)] += (part[i[at:at + (1 << 16)]] == part[j[at:at + (1 << 16)]]).sum(axis=1)
                keep = same >= least
                i, j, same = i[keep], j[keep], same[keep]
            if len(i):  # only in the first band that the pair shares
                first = np.concatenate([(bands[i[at:at + (1 << 16)]] == bands[j[at:at + (1 << 16)]]).argmax(axis=1) for at in range(0, len(i), 1 << 16)])
                keep = bands[i, first] == g.column("band")[0].as_py()
                i, j, same = i[keep], j[keep], same[keep]
            if not len(i):
                continue
            best = np.argsort(-same, kind="stable")
            sets, root = g.column("shingles"), list(range(int(comps.max()) + 1))

            def top(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            x, y = [], []
            for p, q in zip(i[best].tolist(), j[best].tolist()):
                one, two = top(comps[p]), top(comps[q])
                if one != two and linked(np.frombuffer(sets[p].as_buffer(), np.uint64), np.frombuffer(sets[q].as_buffer(), np.uint64)):
                    root[one] = two
                    x.append(int(ids[p]))
                    y.append(int(ids[q]))
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    each = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    sizes = each.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).select(
        "band", F.col("most.component").alias("largest"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("most.n") / BLOCK).cast("int").alias("chunks"))
    rows = placed.select("band", "id", "component").join(sizes, "band")
    inside = F.col("component") == F.col("largest")
    mix = F.xxhash64("id")
    rows = rows.withColumn("own", F.when(inside, F.col("blocks") + F.pmod(mix, "chunks")).otherwise(F.pmod(mix, "blocks")).cast("int"))
    last = F.when(inside, F.col("blocks")).otherwise(F.col("blocks") + F.col("chunks")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component")
    rows = rows.join(signs, "id").join(classes.select("id", "bands"), "id")
    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, n_shingles, set_key, component (of class ids), component_id and kept; and the doc_ids of several rows."""
    signed = materialize(signatures(docs), "signed")
    repeated = materialize(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    usable = signed.where("set_key is not null and doc_id is not null")
    classes = materialize(usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "short")).alias("r"))
                          .select("set_key", F.xxhash64("set_key").alias("id"), "r.doc_id", "r.bands", "r.short"), "classes")
    bands = band_rows(classes)
    leaders = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(bands.join(leaders, "band"), "members")
    star = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    tested = materialize(plausible(star, classes), "plausible")
    sets = full_sets(docs, classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id"), repeated)
    links = materialize(confirmed(tested, sets), "links")
    labels = components(links)
    placed = members.join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    open_bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    placed = materialize(placed.join(open_bands, "band"), "placed")
    signs = materialize(long_signatures(sets, placed.select("id").distinct()), "signs")
    labels = components(links.union(materialize(block_links(placed, signs, classes), "links")))
    placed = classes.join(labels, "id", "left").select("set_key", "doc_id", F.coalesce("component", "id").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    labels = placed.drop("doc_id").join(smallest, "component")
    out = signed.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", "n_shingles", "set_key", "component", component_id.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept")), repeated


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    return judged(docs)[0].select("doc_id", "n_shingles", "component_id", "kept")


def with_set_key(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, the key of the row's shingle set."""
    names = [*docs.columns, "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in text_slices(whole, "_text", SLICE_BYTES):
                columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(set_keys(shingle_sets(data, offsets)), pa.binary())], names)

    schema = StructType([*docs.schema.fields, StructField("_key", BinaryType())])
    return docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, of the smallest id; rows without id or shingles stay."""
    verdicts, repeated = judged(docs)
    any_repeated = not repeated.isEmpty()
    if any_repeated:
        verdicts = materialize(verdicts, "verdicts")
    gone = verdicts.where("not kept").select("doc_id").union(repeated).select(F.col("doc_id").alias("_gone")).distinct()
    single = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if not any_repeated:
        return single
    # ids of several rows: each row by its own text
    several = docs.select("doc_id", "text", whole_row(docs).alias("doc")).join(repeated, "doc_id", "left_semi")
    keyed = with_set_key(several)
    kept = verdicts.where("kept and component is not null").select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_set"), F.col("component").alias("_component")).distinct()
    rows = keyed.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_set")))
    order = Window.partitionBy("_component").orderBy("_key", ordered_by(rows, "doc"))
    first = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return single.union(unpacked(first, "doc", docs, {})).union(unpacked(keyed.where("_key is null"), "doc", docs, {}))

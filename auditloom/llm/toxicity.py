"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word enters as its own embedding and as the mean of the embeddings of its character trigrams, both
from hashed tables, so no vocabulary is collected. Two recurrent passes read a window of ``WINDOW``
words, attention pools their states, and a logistic unit scores the window. A document's score is that
of its most toxic window, over all overlapping windows of the whole text, scaled on training documents.

Training learns from documents, not windows: word log-odds pick a first window of each document, then
the network's own best window is taken anew in each round. It reads a bounded sample of labelled rows,
``TRAIN_DOCS`` documents at most, of ``TRAIN_CHARS`` characters at most each, drawn by the hash of the
id; scoring has no such bounds.

Defined results: a null or empty text has one empty window and gets its score; labels that are null or
name no document are not used; several labels of one document count as toxic if one is; repeated rows
get equal scores; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import LOWER, RangeHash, mixed, text_slices

TRAIN_DOCS = 3000
TRAIN_CHARS = 20_000
WINDOW, STRIDE = 40, 20
TABLE_SIZE = 1 << 13
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
SLICE_BYTES = 1 << 20
THRESHOLD = 0.7
#: Bytes that words are made of (digits, letters, bytes of characters beyond ASCII).
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of joined texts: row of each word's table entry and trigram rows of each distinct word.

    Returns the distinct-word number of each word, the words before each text, the word rows of the
    distinct words and their trigram rows joined with their offsets folded in as a pair of arrays.
    """
    data = LOWER[data]
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.nonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))[0] if len(data) else np.zeros(0, np.int64)
    ends = np.nonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])))[0] + 1 if len(data) else np.zeros(0, np.int64)
    keys = RangeHash(data).of(starts, ends)
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    lengths = (ends - starts)[first] + 2  # with a mark on either side
    padded = np.full(int(lengths.sum()) + 2, 32, np.uint32)
    begin = np.cumsum(lengths) - lengths
    source = np.repeat(starts[first] - begin - 1, lengths - 2) + _inner(begin, lengths)
    padded[_inner(begin, lengths)] = data[source]
    tri = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    rows = _inner(begin, lengths, 0)  # one trigram for each character of the word
    trigrams = (mixed(tri[rows].astype(np.uint64)) % np.uint64(TABLE_SIZE)).astype(np.int64)
    return number, np.searchsorted(starts, offsets), (distinct % np.uint64(TABLE_SIZE)).astype(np.int64), np.stack([trigrams, np.repeat(np.arange(len(distinct)), lengths - 2)])


def _inner(begin: np.ndarray, lengths: np.ndarray, shift: int = 1) -> np.ndarray:
    """Places of the characters between the marks."""
    n = lengths - 2
    of = np.repeat(np.arange(len(n)), n)
    return begin[of] + shift + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of all windows; each text has one at least, the last reaches its end."""
    n = np.diff(first)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + nth * STRIDE
    return start, np.minimum(WINDOW, first[text + 1] - start), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters with forward and backward passes over batches of windows."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": draw(TABLE_SIZE, WORD_DIM) * 3, "char": draw(TABLE_SIZE, CHAR_DIM) * 9,
                  "wx0": draw(d, 3 * h), "wx1": draw(d, 3 * h), "wh0": draw(h, 3 * h), "wh1": draw(h, 3 * h),
                  "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
                  "wa": draw(2 * h, ATTENTION), "va": draw(ATTENTION), "wo": draw(2 * h), "bo": np.zeros(1, np.float32)}
        self.p["word"] *= np.sqrt(TABLE_SIZE) / 30
        self.p["char"] *= np.sqrt(TABLE_SIZE) / 90
        self.scale = (1.0, 0.0)

    def inputs(self, word_rows: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
        """Vector of each distinct word."""
        chars = np.zeros((len(word_rows), CHAR_DIM), np.float32)
        if trigrams.shape[1]:
            at = np.concatenate([[0], np.nonzero(np.diff(trigrams[1]))[0] + 1])
            chars[trigrams[1][at]] = np.add.reduceat(self.p["char"][trigrams[0]], at, axis=0) / np.diff(np.append(at, trigrams.shape[1]))[:, None]
        return np.concatenate([self.p["word"][word_rows], chars], axis=1)

    def _pass(self, gates: np.ndarray, mask: np.ndarray, way: int) -> tuple[np.ndarray, list]:
        """States of one direction; gates: time x windows x 3h, without the recurrent part."""
        h, wh = HIDDEN, self.p[f"wh{way}"]
        steps, n, _ = gates.shape
        states, kept = np.zeros((steps, n, h), np.float32), [None] * steps
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            rec = state @ wh
            zr = _sigmoid(gates[t, :, :2 * h] + rec[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h:] + r * rec[:, 2 * h:])
            step = mask[t][:, None] * (1 - z) * (new - state)
            kept[t] = (state, z, r, new, rec[:, 2 * h:])
            state = state + step
            states[t] = state
        return states, kept

    def forward(self, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits; ids and mask: time x windows, ids into vectors."""
        gates = [vectors @ self.p[f"wx{w}"] + self.p[f"b{w}"] for w in (0, 1)]
        runs = [self._pass(gates[w][ids], mask, w) for w in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
        seen = np.tanh(both @ self.p["wa"])
        score = np.where(mask > 0, seen @ self.p["va"], -30.0)
        weight = np.exp(score - score.max(axis=0))
        weight = weight * (mask > 0)
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        return pooled @ self.p["wo"] + self.p["bo"][0], (runs, both, seen, weight, pooled)

    def gradients(self, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, cache: tuple, wrong: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the loss whose derivative by the logits is ``wrong``: parameters, and the word vectors."""
        runs, both, seen, weight, pooled = cache
        h, g = HIDDEN, {"wo": pooled.T @ wrong, "bo": np.array([wrong.sum()], np.float32)}
        d_pooled = wrong[:, None] * self.p["wo"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.tensordot(d_score, seen, ((0, 1), (0, 1)))
        d_seen = d_score[:, :, None] * self.p["va"] * (1 - seen**2)
        g["wa"] = np.tensordot(both, d_seen, ((0, 1), (0, 1)))
        d_both = d_both + d_seen @ self.p["wa"].T
        d_vectors = np.zeros_like(vectors)
        steps = len(ids)
        for way in (0, 1):
            wh, kept = self.p[f"wh{way}"], runs[way][1]
            d_gates, d_wh = np.zeros((*ids.shape, 3 * h), np.float32), np.zeros_like(wh)
            d_state = np.zeros((ids.shape[1], h), np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                d_state = d_state + d_both[t, :, way * h:(way + 1) * h]
                state, z, r, new, rec = kept[t]
                m = mask[t][:, None]
                d_new = d_state * m * (1 - z) * (1 - new**2)
                d_z = d_state * m * (state - new) * z * (1 - z)
                d_r = d_new * rec * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_wh += state.T @ d_rec
                d_state = d_state * (1 - m * (1 - z)) + d_rec @ wh.T
            g[f"wh{way}"] = d_wh
            g[f"b{way}"] = d_gates.sum(axis=(0, 1))
            flat, where = d_gates.reshape(-1, 3 * h), ids.ravel()
            g[f"wx{way}"] = vectors[where].T @ flat
            np.add.at(d_vectors, where, flat @ self.p[f"wx{way}"].T)
        return g, d_vectors

    def logits(self, vectors: np.ndarray, number: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of windows over the words ``number``, in batches."""
        gates = [(vectors @ self.p[f"wx{w}"] + self.p[f"b{w}"]).astype(np.float32) for w in (0, 1)]
        out = np.empty(len(start))
        for at in range(0, len(start), 1024):
            s, n = start[at:at + 1024], length[at:at + 1024]
            ids, mask = window_ids(number, s, n)
            states = [self._pass(gates[w][ids] if len(vectors) else np.zeros((WINDOW, len(s), 3 * HIDDEN), np.float32), mask, w)[0] for w in (0, 1)]
            both = np.concatenate(states, axis=2)
            score = np.where(mask > 0, np.tanh(both @ self.p["wa"]) @ self.p["va"], -30.0)
            weight = np.exp(score - score.max(axis=0)) * (mask > 0)
            weight /= np.maximum(weight.sum(axis=0), 1e-9)
            out[at:at + 1024] = (weight[:, :, None] * both).sum(axis=0) @ self.p["wo"] + self.p["bo"][0]
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * logit + self.scale[1])


def window_ids(number: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask of windows, time first."""
    step = np.arange(WINDOW)[:, None]
    mask = (step < length).astype(np.float32)
    at = np.minimum(start + step, max(0, len(number) - 1))
    return (number[at] if len(number) else np.zeros(at.shape, np.int64)), mask


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def train(texts: list[str], toxic: np.ndarray, prevalence: float, rounds: int = 9, seed: int = 5) -> Network:
    """Network fitted to documents; ``prevalence``: the share of toxic rows among all labelled ones."""
    net = Network()
    if len(texts) == 0 or toxic.min() == toxic.max():
        net.scale = (0.0, float(np.log((prevalence + 1e-3) / (1 - prevalence + 1e-3))))
        return net
    number, first, word_rows, trigrams = read_words(*joined(texts))
    start, length, text = windows(first)
    # a first choice of windows by the log-odds of words over documents
    seen = np.unique(np.stack([np.repeat(np.arange(len(texts)), np.diff(first)), number]), axis=1)
    with_toxic = np.bincount(seen[1], toxic[seen[0]], len(word_rows)) + 0.2
    with_clean = np.bincount(seen[1], 1 - toxic[seen[0]], len(word_rows)) + 0.2
    odds = np.log(with_toxic / (toxic.sum() + 1)) - np.log(with_clean / ((1 - toxic).sum() + 1))
    sums = np.concatenate([[0], np.cumsum(np.maximum(odds[number] - 1.0, 0))])
    score = sums[start + length] - sums[start]
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for round_no in range(rounds):
        if round_no >= 3:
            score = net.logits(net.inputs(word_rows, trigrams), number, start, length)
        order = np.lexsort((-score, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[(rank == 0) | (rank < 3) & (toxic[text[order]] == 0)]
        rng.shuffle(chosen)
        y = toxic[text[chosen]].astype(np.float32)
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for at in range(0, len(chosen), 128):
            pick = chosen[at:at + 128]
            ids, mask = window_ids(number, start[pick], length[pick])
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            lo = np.isin(trigrams[1], used)
            own = np.stack([trigrams[0][lo], np.searchsorted(used, trigrams[1][lo])])
            vectors = net.inputs(word_rows[used], own)
            logit, cache = net.forward(vectors, local, mask)
            wrong = ((_sigmoid(logit) - y[at:at + 128]) * balance[at:at + 128] / len(pick)).astype(np.float32)
            grads, d_vectors = net.gradients(vectors, local, mask, cache, wrong)
            grads["word"] = np.zeros_like(net.p["word"])
            np.add.at(grads["word"], word_rows[used], d_vectors[:, :WORD_DIM])
            per = d_vectors[:, WORD_DIM:] / np.maximum(np.bincount(own[1], minlength=len(used)), 1)[:, None]
            grads["char"] = np.zeros_like(net.p["char"])
            np.add.at(grads["char"], own[0], per[own[1]])
            steps += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (0.01 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-6)).astype(np.float32)
    logit = net.logits(net.inputs(word_rows, trigrams), number, start, length)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, logit)
    net.scale = _scaled(np.clip(top, -12, 12), toxic, prevalence)
    return net


def _scaled(x: np.ndarray, y: np.ndarray, prevalence: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit, rows weighted to the prevalence."""
    weight = np.where(y > 0, prevalence / max(y.mean(), 1e-9), (1 - prevalence) / max(1 - y.mean(), 1e-9)) / len(y)
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(50):
        p = _sigmoid(design @ beta)
        grad = design.T @ (weight * (p - y)) + 1e-4 * beta * [1, 0]
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(beta[0], 1e-3)), float(beta[1])


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """A bounded sample of labelled documents outside the held-out fold, and the prevalence in the fold."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0] or 0.0
    # Rows are drawn by id and hash; a join with the few that are drawn then reads their texts, so no text is shuffled.
    short = docs.where(F.length("text") <= TRAIN_CHARS).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    rows = short.select("id", "text_key").join(known, "id").distinct().withColumn("order", F.xxhash64("id"))
    parts = [rows.where(F.col("label") == k).orderBy("order", "text_key").limit(n) for k, n in ((1, TRAIN_DOCS // 3), (0, TRAIN_DOCS - TRAIN_DOCS // 3))]
    drawn = [(r["id"], r["text_key"], r["label"]) for part in parts for r in part.collect()]
    few = docs.sparkSession.createDataFrame([r[:2] for r in drawn], "id long, text_key long")
    read = short.join(F.broadcast(few), ["id", "text_key"])  # at most TRAIN_DOCS rows.groupBy("id", "text_key").agg(F.any_value("text").alias("text"))
    texts = {(r["id"], r["text_key"]): r["text"] for r in read.collect()}
    return [texts[r[:2]] for r in drawn], np.array([r[2] for r in drawn], np.int64), float(share)


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every document, over all windows of its whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, offsets in text_slices(whole, "text", SLICE_BYTES):
                number, first, word_rows, trigrams = read_words(data, offsets)
                start, length, text = windows(first)
                logit = net.logits(net.inputs(word_rows, trigrams), number, start, length)
                top = np.full(batch.num_rows, -np.inf)
                np.maximum.at(top, text, logit)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.probability(np.clip(top, -12, 12)))], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    texts, toxic, prevalence = training_sample(docs, labels)
    scored = score_documents(docs, train(texts, toxic, prevalence))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))

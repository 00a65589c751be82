"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A piece vocabulary merged by priority has this property: the encoding of a prefix is the encoding of a
shorter prefix plus one piece, and a sequence of pieces is an encoding exactly if every two neighbours
encode to themselves. So ``count[k] = count[j] + 1`` for the one piece from j to k that is valid after
the last piece of prefix j; validity of a pair is decided once by merging the pair alone.

No piece reaches from a visible character into a following space (checked when the model is loaded), so
the table of a text is the joined tables of its space-led words, and words repeat: each worker keeps
the tables of words it has met, in a bounded store. The table holds one signed byte per character, the
change of the count; its running sum is the exact count at each prefix. Truncation to a budget and the
cost of any prefix come from the table, without encoding again.

Defined results: null text counts as empty (0 bytes, 0 tokens, an empty table); null ids, repeated rows
and further columns pass through; texts of any length are processed whole, in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose tables a worker keeps; beyond it the store starts anew.
STORE_WORDS = 300_000
STORE_PREFIXES = 250_000
STORE_CHARS = 40
SLICE_ROWS = 256
MARK = "▁"
#: State of the empty prefix.
EMPTY = ("", 0, 0, None)


class PrefixCounter:
    """Prefix tables under one sentencepiece model with merges by priority and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        self.by_word = not any(a != MARK and b == MARK for p in self.score for a, b in zip(p, p[1:], strict=False))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple] = {}
        self.words: dict[str, bytes] = {}
        self.model = model

    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _valid(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= STORE_WORDS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merge(left + right) == [left, right]
        return known

    def _extend(self, text: str, k: int, before: tuple) -> tuple:
        """State of the prefix of ``k`` characters: last piece, count, step, state of the prefix before."""
        score, pairs = self.score, self.pairs
        if text[k - 1] not in score:  # falls back to bytes, which take part in no merge
            step = len(text[k - 1].encode("utf-8", "surrogatepass"))
            return "", before[1] + step, step, before
        start, j = before, k - 1
        while True:
            piece = text[j:k]
            if piece in score:
                left = start[0]
                known = not left or pairs.get((left, piece))
                if known or known is None and self._valid(left, piece):
                    return piece, start[1] + 1, start[1] + 1 - before[1], before
            start, j = start[3], j - 1

    def deltas(self, text: str) -> bytes:
        """Change of the token count at each character of a text whose spaces are marked.

        States of word beginnings are kept: words share them far more often than they are equal.
        """
        kept, n = self.prefixes, len(text)
        if len(kept) >= STORE_PREFIXES:
            kept.clear()
        k = n - 1 if n <= STORE_CHARS else 0
        state = None
        while k > 0 and (state := kept.get(text[:k])) is None:
            k -= 1
        state = state or EMPTY
        short = n <= STORE_CHARS
        while k < n:
            k += 1
            state = self._extend(text, k, state)
            if short and k < n:
                kept[text[:k]] = state
        steps = bytearray()
        while state[3] is not None:
            steps.append(state[2] & 255)
            state = state[3]
        steps.reverse()
        return bytes(steps)

    def _word(self, word: str) -> bytes:
        table = self.deltas(MARK + word)
        if len(word) <= STORE_CHARS:
            if len(self.words) >= STORE_WORDS:
                self.words.clear()
            self.words[word] = table
        return table

    def table(self, text: str) -> bytes:
        """One signed byte per character: how much it changes the token count of the prefix."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if not self.by_word:
            joined = self.deltas(MARK + text.replace(" ", MARK))
        elif "  " in text or text[0] == " ":
            joined = b"".join(self._runs(MARK + text.replace(" ", MARK)))
        else:
            get = self.words.get
            joined = b"".join([get(w) or self._word(w) for w in text.split(" ")])
        # the mark that the model puts in front belongs to the first character
        head = int.from_bytes(joined[:1], "little", signed=True) + int.from_bytes(joined[1:2], "little", signed=True)
        return head.to_bytes(1, "little", signed=True) + joined[2:]

    def _runs(self, marked: str) -> Iterator[bytes]:
        """Tables of the parts that begin with a run of marks and end before the next run."""
        at, n = 0, len(marked)
        while at < n:
            word = at
            while word < n and marked[word] == MARK:
                word += 1
            end = marked.find(MARK, word)
            end = n if end < 0 else end
            if word - at == 1:
                body = marked[word:end]
                yield self.words.get(body) or self._word(body)
            else:
                yield self.deltas(marked[at:end])
            at = end


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a model file, one per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_at(table: bytes, chars: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(np.frombuffer(table, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    at = np.nonzero(np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64) <= budget)[0]
    return int(at[-1]) + 1 if len(at) else 0


def prefix_counts(docs: DataFrame, model_path: str, budget: int, keep_table: bool = True, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ``carry``, n_bytes, n_tokens, budget_chars (longest prefix within ``budget``), prefix_table."""
    fields = [f for f in docs.schema.fields if f.name in carry]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["n_bytes bigint", "n_tokens bigint", "budget_chars bigint"] + ["prefix_table binary"] * keep_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                texts = batch.column("_text")
                tables = [count.table(t) for t in texts.to_pylist()]
                totals = [int(np.frombuffer(t, np.int8).sum(dtype=np.int64)) for t in tables]
                fits = [len(t) if n <= budget else longest_within(t, budget) for t, n in zip(tables, totals, strict=True)]
                columns = [batch.column(f.name) for f in fields]
                columns += [pc.cast(pc.binary_length(texts), pa.int64()), pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]
                names = [f.name for f in fields] + ["n_bytes", "n_tokens", "budget_chars"]
                if keep_table:
                    columns.append(pa.array(tables, pa.binary()))
                    names.append("prefix_table")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(*[f.name for f in fields], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, schema)

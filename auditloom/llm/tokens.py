"""Encoding of whole texts word by word, equal to encoding them at once.

A byte-level vocabulary first splits a text by a pattern and merges inside the parts. Between a visible
character and a single space there is always a split, so words can be encoded apart, with their leading
space, and the ids of words met before are kept in a bounded store. New words are merged by tiktoken with
the ranks of the same file, whose calls for single words are cheaper; the ids are equal. Texts where this does not hold (runs
of white space, control characters, spelled special tokens) go to the library as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

STORE_WORDS = 300_000
STORE_CHARS = 40
#: Fixed value: the split pattern of byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD = re.compile(r"\s |\s\s| \s|[\x1c-\x1f\x85]")
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def word_merger(tokenizer) -> Callable[[str], list[int]]:
    """Encoding of ordinary text under a byte-level vocabulary whose ids follow the order of its merges."""
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab(with_added_tokens=True).items() if token not in added}
    return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def segment_encoder(path: str) -> Callable[[str], bytes]:
    """Function from a text to its ids (unsigned 32 bit, little-endian) under a tokenizers file; one per worker process."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    store: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    merge = word_merger(tokenizer)

    def missing(words: list[str]) -> dict[str, bytes]:
        found = {word: array("I", merge(" " + word)).tobytes() for word in words}
        if len(store) + len(found) > STORE_WORDS:
            store.clear()
        store.update((w, ids) for w, ids in found.items() if len(w) <= STORE_CHARS)
        return found

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or text[0].isspace() or text[-1].isspace() or any(s in text for s in specials):
            return whole(text)
        first, _, rest = text.partition(" ")
        parts = list(map(store.get, words := rest.split(" "))) if rest else []
        if None in parts:
            found = missing(list({w for w, p in zip(words, parts, strict=True) if p is None}))
            parts = [p if p is not None else found[w] for w, p in zip(words, parts, strict=True)]
        return whole(first) + b"".join(parts)

    _ENCODERS[path] = encode
    return encode

"""BPE encoding and decoding with forced boundaries.

A byte pair that never occurs inside any vocabulary token is never merged over, whatever the merges around it, so a
text may be cut there, the fragments encoded independently and their ids concatenated. Two guards keep the
pre-tokeniser's pattern from seeing a cut: the character before it is not white space (its look-ahead concerns runs
of white space only) and the one after it is no apostrophe (contractions start with one). Strings of added tokens
are never cut.

The fragments between a word's last character and the next blank are found with one scan and kept in a bounded
cache; a new fragment is cut at all of its forced boundaries before it is encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import bound_batches, sized_batches

#: Bounds of the per-worker cache: entries, and the longest fragment that is kept.
CACHE, LONGEST = 120_000, 48

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Byte strings by id, concatenated for a whole array of ids at once."""

    def __init__(self, strings: dict[int, bytes]):
        size = max(strings, default=-1) + 1
        every = [strings.get(i, b"") for i in range(size)]
        self.length = np.array([len(x) for x in every], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(every), np.uint8)

    def join(self, ids: np.ndarray, step: int = 1 << 18) -> bytes:
        parts = []
        for s in range(0, len(ids), step):
            at = ids[s : s + step]
            n = self.length[at]
            ends = np.cumsum(n)
            where = np.repeat(self.start[at] - (ends - n), n)
            where += np.arange(len(where))
            parts.append(self.flat[where].tobytes())
        return b"".join(parts)


class ForcedBoundaryBpe:
    """encode(text) -> ids and decode(ids) -> text, as the tokenizers library gives for the same file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: cuts are certain for byte-level vocabularies with the usual pattern and without normaliser only")
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if all(c in symbols for c in token)}
        for t in spec["added_tokens"]:
            ranks.pop(t["content"].encode(), None)
        token_bytes = {i: t for t, i in ranks.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.joined = {(a, b) for t in token_bytes.values() for a, b in zip(t, t[1:], strict=False)}
        self.pieces = self._by_ranks(spec, ranks)
        self.text_of, self.decimal_of = Table(token_bytes), Table({i: b"%d," % i for i in token_bytes})
        self.cache: dict[str, bytes | None] = {}
        self.cuts: dict[str, bool] = {}
        # A word's end is also a boundary before a mark, if the vocabulary has no such pair
        marks = ".,;:?!"
        letters = [c for c in map(chr, range(0x41, 0x180)) if c.isalpha() and all(self.is_cut(c, m) for m in marks)]
        self.words = re.compile(rf"[ \n]*(?:[{''.join(letters)}]+(?=[{marks}])|[^ \n]+)|[ \n]+" if letters else r"[ \n]*[^ \n]+|[ \n]+")

    @staticmethod
    def _by_ranks(spec: dict, ranks: dict[bytes, int]):
        """A faster encoder of the same merges, if ids follow the order of merges; else None."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(ranks) != 256 + len(pairs):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the byte-level pre-tokeniser's
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def is_cut(self, x: str, y: str) -> bool:
        """Is the place between the characters x and y a certain boundary?"""
        known = self.cuts.get(x + y)
        if known is None:
            if len(self.cuts) > 100_000:
                self.cuts.clear()
            known = self.cuts[x + y] = not x.isspace() and x.isprintable() and y != "'" and (x.encode()[-1], y.encode()[0]) not in self.joined
        return known

    def fragments(self, text: str) -> list[str]:
        """The text cut at every certain boundary outside added tokens."""
        out: list[str] = []
        cuts, is_cut = self.cuts, self.is_cut
        for k, piece in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                out.append(piece)
                continue
            start = 0
            for i in range(1, len(piece)):
                known = cuts.get(piece[i - 1 : i + 1])
                if known or known is None and is_cut(piece[i - 1], piece[i]):
                    out.append(piece[start:i])
                    start = i
            if start < len(piece):
                out.append(piece[start:])
        return out

    def _ids(self, fragment: str) -> list[int]:
        if self.pieces and max(fragment) < "\u0180" and not (self.added and self.added.match(fragment)):
            return self.pieces(fragment)
        return self.library.encode(fragment, add_special_tokens=False).ids

    def _cut_ids(self, text: str) -> bytes:
        return np.array(list(chain.from_iterable(map(self._ids, self.fragments(text)))), np.uint32).tobytes()

    def _new(self, word: str) -> bytes | None:
        """Ids of a word that the cache lacks; None if its end is no certain boundary before a blank."""
        found = self._cut_ids(word) if self.is_cut(word[-1], " ") and self.is_cut(word[-1], "\n") else None
        if len(word) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids as an array of unsigned 32-bit integers."""
        words, cache = self.words.findall(text), self.cache
        try:
            return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint32)
        except (KeyError, TypeError):
            pass
        parts = [cache[w] if w in cache else self._new(w) for w in words]
        if parts and parts[-1] is None:  # nothing follows, so its end needs no boundary
            parts[-1] = self._cut_ids(words[-1])
        if None in parts:  # rare: white space of another kind before a blank; cut the whole text by the general rule
            return np.frombuffer(self._cut_ids(text), np.uint32)
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes; what is no UTF-8 becomes U+FFFD."""
        raw = self.text_of.join(ids)
        return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.decimal_of.join(ids)[:-1]


@lru_cache(2)
def coder(path: str) -> ForcedBoundaryBpe:
    """One per worker process."""
    return ForcedBoundaryBpe(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs(doc_id, text)``; a null text is empty and gives no ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in sized_batches(batches, "text", 4 << 20):
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return bound_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of ``encoded(doc_id, ids)``; null ids are empty."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([bpe.decode(np.array(i or [], np.int64)).decode() for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return bound_batches(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded, and its ids decoded again.

    Both ways run in one pass, so ids don't travel. Null and empty texts give no tokens and the digests of empty
    strings; rows repeating a doc_id each give a row; a null doc_id stays null; other columns are not read.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in sized_batches(batches, "text", 4 << 20):
            n, coded, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bound_batches(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token-id shards compressed by a grammar (Re-Pair), with random access.

A shard holds the ids of consecutive documents. Frequent pairs of symbols are replaced by nonterminals, again and
again, until no pair is frequent. The shard stores the rules, each symbol's expansion length and the remaining
sequence with the token offset of every STRIDE-th symbol, so a range of tokens is decoded from its neighbourhood.

One round replaces a set of frequent pairs (a, b) chosen by falling frequency such that no symbol is the left of one
and the right of another: their occurrences cannot overlap, so the round equals replacing them one after another.

Shards are rows (part, shard, tokens before it in the part, payload) of a table in shared storage, parts being
ranges of doc_id; any file system that Spark reaches will do.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.bpe import byte_symbols
from veilspark.llm.common import bound_batches, freeze, partitions, sized_batches

#: Ids in a shard before it is closed (a document stays in one shard), symbols between two offsets of the index.
SHARD, STRIDE = 1_000_000, 1024
#: A pair is replaced if it occurs so often; pairs of a round.
FREQUENT, PER_ROUND = 24, 2048
MARKS = ".,;:?!"
MAGIC = b"RPR1"
_HEAD = struct.Struct("<4sIIQQI")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Ids of a text as the tokenizers library gives for a vocabulary with word ends, by cached blank-free words."""

    def __init__(self, path: str, cache: int = 500_000, longest: int = 40):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])], default=0) + 1
        self.words: dict[str, bytes] = {}
        self.cache, self.longest = cache, longest
        self.piece = self._by_ranks(spec)
        letters = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªºµ")
        self.plain = re.compile(f"[{letters}]+")

    @staticmethod
    def _by_ranks(spec: dict):
        """A faster encoder of the same merges where ids follow their order; a word's end is a byte that UTF-8 lacks."""
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        symbols, added = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
        if end != "</w>" or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(pairs)):
            return None
        try:
            import tiktoken

            ranks = {bytes(symbols[c] for c in t.removesuffix(end)) + b"\xff" * t.endswith(end): i for t, i in vocab.items() if t not in added}
            return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        except (ImportError, AttributeError, KeyError, ValueError):
            return None

    def _ids(self, word: str) -> bytes:
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if self.piece and (stem.isascii() and stem.isalpha() or self.plain.fullmatch(stem)):
            out = self.words.get(stem) or array("I", self.piece(stem.lower().encode() + b"\xff")).tobytes()
            if len(stem) < len(word):  # marks after letters are a run of their own
                marks = word[len(stem) :]
                out += self.words.get(marks) or self._word(marks)
        else:
            out = self._ids(word)
        if len(word) <= self.longest:
            if len(self.words) >= self.cache:
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        words, known = text.replace("\n", " ").split(" "), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            return b"".join([known[w] if w in known else self._word(w) for w in words])


@lru_cache(2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)


def repair(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): ids below ``base`` are terminals, base + i stands for the pair rules[i]."""
    seq, rules, total = ids.astype(np.uint32), [], base
    while len(seq) >= 2:
        wide = total > 1 << 16
        kind, half = (np.uint64, np.uint64(32)) if wide else (np.uint32, np.uint32(16))
        keys = seq.astype(kind, copy=False)
        keys = keys[:-1] << half | keys[1:]
        keys.sort()
        # a pair that occurs FREQUENT times is the same key so many places on
        often = keys[: -FREQUENT + 1][keys[: -FREQUENT + 1] == keys[FREQUENT - 1 :]] if len(keys) >= FREQUENT else keys[:0]
        if not len(often):
            break
        first = np.flatnonzero(np.concatenate(([True], often[1:] != often[:-1])))
        times = np.diff(np.append(first, len(often)))
        often = often[first]
        often = often[np.lexsort((often, -times))][: 4 * PER_ROUND]
        left, right, chosen = set(), set(), []
        for a, b in zip((often >> half).tolist(), (often & kind((1 << int(half)) - 1)).tolist(), strict=True):
            if a in right or b in left or a == b and (a in left or a in right):
                continue
            left.add(a)
            right.add(b)
            chosen.append((a, b))
            if len(chosen) == PER_ROUND:
                break
        pairs = np.array(chosen, np.uint32)
        lefts, rights = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        row, column = np.full(total, -1, np.int32), np.full(total, -1, np.int32)
        row[lefts], column[rights] = np.arange(len(lefts)), np.arange(len(rights))
        rule = np.full(len(lefts) * len(rights), -1, np.int32)  # by row and column
        rule[row[pairs[:, 0]] * len(rights) + column[pairs[:, 1]]] = np.arange(len(pairs))
        r, c = row[seq[:-1]], column[seq[1:]]
        at = np.flatnonzero((r >= 0) & (c >= 0))
        found = rule[r[at] * len(rights) + c[at]]
        at, found = at[found >= 0], found[found >= 0]
        same = seq[at] == seq[at + 1]
        if same.any():  # in a run of one symbol every second place counts
            new = np.concatenate(([True], np.diff(at) != 1))
            offset = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            at, found = at[offset % 2 == 0], found[offset % 2 == 0]
        seq[at] = (total + found).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(pairs)
        total += len(pairs)
    return seq, np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, base: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What all symbols stand for, one after another: a rule's two parts are copied once those of its parts are there."""
    flat = np.empty(int(start[-1] + length[-1]) if len(start) else 0, np.uint32)
    flat[:base] = np.arange(base, dtype=np.uint32)
    depth = [0] * base
    for a, b in rules.tolist():
        depth.append(max(depth[a], depth[b]) + 1)
    depth = np.array(depth[base:], np.int64)
    by_depth = np.argsort(depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if len(depth) else []:
        a, b = rules[level, 0], rules[level, 1]
        for part, to in ((a, start[base + level]), (b, start[base + level] + length[a])):
            n = length[part]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(to, n) + inside] = flat[np.repeat(start[part], n) + inside]
    return flat


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """header, rules, expansion lengths, offsets, sequence, then the documents: ids, whether null, token counts."""
    seq, rules = repair(ids, base)
    sums = [1] * base
    for a, b in rules.tolist():
        sums.append(sums[a] + sums[b])
    lengths = np.array(sums, np.uint32)
    ends = np.cumsum(lengths[seq], dtype=np.uint64)
    index = np.concatenate((np.zeros(1, np.uint64), ends))[:-1:STRIDE] if len(seq) else np.zeros(0, np.uint64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], np.int64)
    head = _HEAD.pack(MAGIC, base, len(rules), len(seq), len(ids), len(docs))
    wide = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
    return b"".join([head, bytes([np.dtype(wide).itemsize]), rules.tobytes(), lengths[base:].tobytes(), index.tobytes(), seq.astype(wide).tobytes(), docs.tobytes(), null.tobytes(), counts.astype(np.uint32).tobytes()])


class Shard:
    """Reads a shard; ``tokens(start, stop)`` expands only the symbols that cover the range."""

    def __init__(self, payload: bytes):
        magic, self.base, n_rules, n_seq, self.n_tokens, n_docs = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, wide = _HEAD.size + 1, {2: np.uint16, 4: np.uint32}[payload[_HEAD.size]]

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(np.uint32, 2 * n_rules).reshape(-1, 2)
        self.lengths = take(np.uint32, n_rules)
        self.index = take(np.uint64, -(-n_seq // STRIDE))
        self.seq = take(wide, n_seq)
        self.docs, self.null, self.counts = take(np.int64, n_docs), take(np.uint8, n_docs).astype(bool), take(np.uint32, n_docs).astype(np.int64)
        self.length = np.concatenate((np.ones(self.base, np.int64), self.lengths.astype(np.int64)))
        self.start = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.lengths, dtype=np.int64) - self.lengths))
        self.flat = expansions(self.rules, self.base, self.start, self.length)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        n = self.length[seq]
        ends = np.cumsum(n)
        where = np.repeat(self.start[seq] - (ends - n), n)
        where += np.arange(len(where))
        return self.flat[where]

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_tokens if stop is None else min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.index, start, side="right")) - 1
        b = int(np.searchsorted(self.index, stop, side="left"))
        return self._expand(self.seq[a * STRIDE : b * STRIDE])[start - int(self.index[a]) : stop - int(self.index[a])]


SHARDS = "part int, shard int, before long, n_tokens long, payload binary"


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        part, shard, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, pieces, counts, end = [], [], [], np.array([end_id], np.uint32).tobytes()

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), np.uint32)
            row = [part, shard, before, len(ids), write_shard(docs, np.array(counts), ids, bpe.size)]
            for x in (docs, pieces, counts):
                x.clear()
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "before", "n_tokens", "payload"])

        for batch in sized_batches(batches, "text", 4 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = bpe.encode(text or "") + end
                docs.append(doc)
                pieces.append(ids)
                counts.append(len(ids) // 4)
                held += counts[-1]
                if held >= SHARD:
                    yield close()
                    shard, before, held = shard + 1, before + held, 0
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Shards (part, shard, before, n_tokens, payload) of the ids of ``docs(doc_id, text)`` in ascending doc_id order.

    Nulls of doc_id come first, rows of one doc_id are ordered by text; a null or empty text has the end id only.
    An empty table gives no shard.
    """
    docs = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(max(4, partitions(docs.sparkSession)), *order).sortWithinPartitions(*order, "text")
    return dealt.mapInArrow(_write(path or default_vocabulary(), end_id), SHARDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "payload")), strict=True):
            s = Shard(payload)
            raw = memoryview(s.tokens().astype("<u4").tobytes())
            ends = np.cumsum(s.counts)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), s.counts.tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.full(len(ends), part, np.int32)), pa.array(s.docs, mask=s.null), pa.array(before + ends - s.counts), pa.array(s.counts), pa.array(crc, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, decoded from them."""
    # One row per part, i.e. per task that wrote; their number is a setting, not a property of the data
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) base")
    read = shards.select("part", "before", "payload").mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(base), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the shards to shared storage and read them back."""
    return read_tokens(freeze(write_tokens(docs, path, end_id), "token-shards"))

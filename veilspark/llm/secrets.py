"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

The patterns find assignments, access keys and hex strings. The models are first-order chains over the characters
that secrets are made of: one of random strings, one of ordinary identifiers and words. A token is a secret if the
logarithm of its likelihood ratio reaches THRESHOLD in total and MEAN per character. Spans of the models are added to
those of the patterns; they never overlap them and never remove one: what a pattern's span leaves of a token is judged
by itself. Longer tokens are judged piece by piece, the last piece reaching back to its full length, and neighbouring
pieces that are secret make one span.

Training samples are labelled: random strings over the usual alphabets from a seeded generator against the tokens of
all documents that no pattern matches, and identifiers built of all of these. Only counts of character pairs leave the executors.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bound_batches, sized_batches

# The patterns and least lengths of the base rules
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

KINDS = ("assign", "access", "hex", "markov")
#: Tokens that are counted at once.
CHUNK = 4000
#: Candidates of the models: shortest and longest piece judged at once, and the two limits in natural logarithms.
LEAST, PIECE, THRESHOLD, MEAN = 16, 256, 20.0, 0.7

ALPHABET = string.ascii_letters + string.digits + "+/_=-."
_CODE = np.full(128, 0, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_N = len(ALPHABET) + 1

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX[:-1] + "{%d,}" % HEX_LEAST)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
_ANY_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{3,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def pair_counts(tokens) -> np.ndarray:
    """How often each character follows each other one; 0 is the start."""
    codes = _CODE[np.frombuffer("".join(["\n" + t for t in tokens]).encode("ascii"), np.uint8)]  # a line's end has code 0
    inside = codes[1:] > 0
    return np.bincount(codes[:-1][inside] * _N + codes[1:][inside], minlength=_N * _N).reshape(_N, _N)


def random_strings(n: int = 4000, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    sets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, "0123456789abcdef"]
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(20, 48))) for i in range(n)]


def identifiers(words: list[str]) -> list[str]:
    """Camel case, snake case, dotted and path names of the words."""
    low = [w.lower() for w in words]
    out = []
    for i in range(0, len(low) - 3, 4):
        a, b, c, d = low[i : i + 4]
        out += [a + b.title() + c.title(), f"{a}_{b}_{c}", f"{a}.{b}.{c}", f"/{a}/{b}/{c}-{d}", f"{a.upper()}_{b.upper()}", f"{a}-{b}={i % 2000}"]
    return out


def model(secret: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each character pair, with add-one (random) and add-half (ordinary) smoothing."""
    p = (secret + 1.0) / (secret + 1.0).sum(1, keepdims=True)
    q = (ordinary + 0.5) / (ordinary + 0.5).sum(1, keepdims=True)
    return np.log(p) - np.log(q)


def _free(start: int, end: int, taken: list[tuple[int, int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What spans sorted by start leave of start..end; ``at`` is the first of them that may reach it, for the next call."""
    out = []
    while at < len(taken) and taken[at][2] <= start:
        at += 1
    i = at
    while i < len(taken) and taken[i][0] < end:
        a, _, b = taken[i]
        if b > start:
            out.append((start, a))
            start = b
        i += 1
    return [*out, (start, end)], at


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        parts, at = _free(m.start(), m.end(), taken, at)
        for start, end in parts:
            if end - start < LEAST:
                continue
            codes = _CODE[np.frombuffer(text[start:end].encode("ascii"), np.uint8)]
            upto = np.concatenate(([0.0], np.cumsum(ratio[np.concatenate(([0], codes[:-1])), codes])))
            s = 0
            while s < end - start:
                e = min(s + PIECE, end - start)
                s = max(0, e - PIECE) if e - s < LEAST else s
                total = float(upto[e] - upto[s])
                if total >= THRESHOLD and total >= MEAN * (e - s):
                    if out and out[-1][2] >= start + s:
                        out[-1] = out[-1][0], 3, start + e
                    else:
                        out.append((start + s, 3, start + e))
                s = e
    return out


def train(docs: DataFrame) -> np.ndarray:
    """The ratio table, from all rows of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_N, _N), np.int64)
        for batch in sized_batches(batches, "text", 4 << 20):
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                tokens = [m.group() for m in _ANY_TOKEN.finditer(text or "") if not any(a < m.end() and b > m.start() for a, _, b in spans)]
                for start in range(0, len(tokens), CHUNK):
                    some = tokens[start : start + CHUNK]
                    total += pair_counts([*some, *identifiers(some)])
        i = np.flatnonzero(total)
        yield pa.record_batch([pa.array(i), pa.array(total.ravel()[i])], ["pair", "n"])

    ordinary = np.zeros(_N * _N, np.int64)
    for r in docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # _N * _N rows at most
        ordinary[r["pair"]] = r["n"]
    return model(pair_counts(random_strings()), ordinary.reshape(_N, _N))


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs(doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind. A null or empty text has none;
    rows repeating a doc_id each give a row; a null doc_id stays null.
    """
    import hashlib

    docs = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratio = train(docs)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            counts, digest, every = ([], [], []), [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(_told(base).encode()).hexdigest())
                every.append(_told(sorted(base + markov_spans(text, ratio, base))))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())], names)

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by ``mark``; ``n_chars`` follows where there is one."""
    ratio = train(bound_batches(docs).select("doc_id", "text"))
    at, measured = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, end = [], 0
        for s, _, e in sorted(base + markov_spans(text, ratio, base)):
            if e > end:
                out.append(text[end:s] + mark if s >= end else "")
                end = e
        return "".join([*out, text[end:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            old = batch.column("text").to_pylist()
            new = [clean(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if measured is not None:
                was = columns[measured].to_pylist()
                columns[measured] = pa.array([w if a == b or b is None else len(b) for a, b, w in zip(old, new, was, strict=True)], batch.schema.field(measured).type)
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. The ordinary one is trained on windows of
ordinary text, the toxic one on the stretches of toxic text that ordinary text hardly has, each as often as toxic texts
have it: substrings at any place, inside a word or across several, where specific grams of GRAM bytes follow each other,
and whole words (specific: in several texts of the class, and by a likelihood score rarer in the other class). Prose
that both classes have must cost the same under either, so each class's own dictionary stands in front of the one of
ordinary windows: the difference of a window's compressed lengths then comes from the class alone. Ordinary text is
given such a front too where it has specific stretches. The README has the figures of dictionaries trained on all text
of a class, which separate the classes far worse.

A text is scored by the statistics of these differences over all of its windows, calibrated by a logistic model on
labelled texts that neither dictionary saw. Labels, language, source and ids are no inputs of a score.

Training reads a bounded sample: the ``SAMPLE`` labelled rows of each class with the smallest hashes (near copies
count once), with their whole texts, as scoring reads them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bound_batches, mix64, sized_batches

#: Bounds of the training sample: rows of a class; characters that the base is trained on.
SAMPLE, SAMPLES = 3000, 6_000_000
#: Bytes of a class's own dictionary (and of the different segments that it is trained on) and of that of ordinary
#: windows; the likelihood score and count that make a segment specific; words in a window; zstandard's level.
SPECIFIC, BASE, SCORE, RECURS, WINDOW, LEVEL = 2048, 65536, 7.5, 3, 32, 9
#: Bytes of the pieces that zstandard's trainer may pick for a class's own dictionary, and of the matches that it counts.
PIECES, MATCH = (12, 16, 20, 24, 32, 48), 8
#: Bytes of the grams that segments are found by; bits of the table that counts them.
GRAM, SLOTS = 5, 22
#: A text with this score or more counts as toxic.
THRESHOLD = 0.3

_NO_WORD = re.compile(r"[\W_]+")


def _words(text: str | None) -> list[str]:
    return _NO_WORD.sub(" ", text.lower()).split() if text else []


def _windows(words: list[str]) -> list[bytes]:
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)]


@lru_cache(2)
def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard as z

    out = []
    for content in (ordinary, toxic):
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return out


def features(text: str | None, toxic: bytes, ordinary: bytes) -> list[float]:
    """Mean and greatest saving of the toxic dictionary over a window, and the share of windows where it is smaller."""
    windows = _windows(_words(text))
    if not windows:
        return [0.0, 0.0, 0.0]
    under_ordinary, under_toxic = _compressors(toxic, ordinary)
    d = np.array([len(under_ordinary(w)) - len(under_toxic(w)) for w in windows], float)
    return [float(d.mean()), float(d.max()), float((d > 0).mean())]


def _grams(raw: bytes) -> np.ndarray:
    """A slot for the GRAM bytes from each place on."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + a[k : k + n] + np.uint64(1)
    return (mix64(h) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _stretches(raw: bytes, slots: np.ndarray, counts: np.ndarray) -> set[bytes]:
    """The substrings of whose places all have a specific gram (a count), each about as frequent as those beside it."""
    at = np.flatnonzero(counts[slots])
    out = set()
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
        often = counts[slots[run]]
        core = run[2 * often >= often.max()]  # what merely stands beside a specific substring is rarer
        out.update(raw[x[0] : x[-1] + GRAM] for x in np.split(core, np.flatnonzero(np.diff(core) > 1) + 1))
    return out


def _segments(rows: list[tuple[str, int]]) -> tuple[list[bytes], list[bytes]]:
    """Training samples of label 1 and of label 0: substrings at any place, inside a word or across several, and words."""
    texts = [((" " + " ".join(_words(t)) + " ").encode(), label) for t, label in rows]
    sizes, counts = [sum(y == label for _, y in rows) for label in (0, 1)], np.zeros((2, 1 << SLOTS), np.int32)
    for raw, label in texts:
        counts[label][np.unique(_grams(raw))] += 1
    marks = []
    for label in (0, 1):
        own, other, share = counts[label], counts[1 - label], sizes[label] / max(1, sum(sizes))
        some = np.flatnonzero(own >= RECURS)
        a, b = own[some].astype(float), other[some].astype(float)
        p = a / (a + b)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (a + b) * (p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0.0))
        mark = np.zeros(1 << SLOTS, np.int32)
        good = some[(p > share) & (score > SCORE)]
        mark[good] = own[good]
        marks.append(mark)
    found = [(Counter(), Counter()) for _ in (0, 1)]  # by the class that a segment would stand for, by that of the text
    for raw, label in texts:
        slots, words = _grams(raw), {b" %s " % w for w in raw.split()}
        for of in (0, 1):
            found[of][label].update(_stretches(raw, slots, marks[of]) | words)
    return tuple(_specific(found[of][of], sizes[of], found[of][1 - of], sizes[1 - of]) for of in (1, 0))


def _specific(own: Counter, n: int, other: Counter, m: int) -> list[bytes]:
    """The most specific segments of a class, SPECIFIC bytes of different ones, each as often as texts of it have it."""
    share = n / max(1, n + m)

    def score(w: bytes) -> float:
        """A bound of -ln P(so many of the texts with w are of this class by chance)."""
        a, b = own[w], other[w]
        p = a / (a + b)
        return (a + b) * (p * math.log(p / share) + (1 - p) * math.log(max(1 - p, 1e-300) / (1 - share))) if share < 1 and p > share else 0.0

    ranked = sorted(((s, w) for w, a in own.items() if a >= RECURS and (s := score(w)) > SCORE), reverse=True)
    out, size = [], 0
    for _, w in ranked:
        size += len(w) + 1
        if size > SPECIFIC:
            break
        out += [w.ljust(MATCH)] * own[w]
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A class's own dictionary of SPECIFIC bytes, trained with that size of pieces which holds most of the segments; too
    few samples to train on stand for themselves."""
    import zstandard as z

    segments, content, most = set(samples), b"".join(dict.fromkeys(samples)), -1
    for piece in PIECES:
        try:
            trained = z.train_dictionary(SPECIFIC, samples, k=piece, d=MATCH).as_bytes()
        except z.ZstdError:
            continue
        held = sum(x.strip() in trained for x in segments)
        if held > most:
            content, most = trained, held
    return content[-SPECIFIC:].rjust(SPECIFIC, b"\0")


def train(rows: list[tuple[str, int]], share: float | None = None) -> dict:
    """A model from (text, label) rows: dictionaries from two thirds of them, calibration on the others.

    share: that of label 1 among all labelled rows, if the sample's differs.
    """
    import zstandard as z

    seen, fit, rest = set(), [], []
    for text, label in rows:
        words = _words(text)
        marks = {m for i in range(len(words) - 4) if (m := zlib.crc32(" ".join(words[i : i + 5]).encode())) % 8 == 0} or {text}
        if len(marks & seen) * 3 < len(marks):  # no near copy of an earlier one
            (fit, rest)[(len(fit) + len(rest)) % 3 == 2].append((text, label))
        seen |= marks
    sizes = [sum(y == label for _, y in fit) for label in (0, 1)]
    samples, size = [], 0
    for text, label in fit:
        if not label and size < SAMPLES:
            samples += _windows(_words(text))
            size += len(text)
    try:
        base = z.train_dictionary(BASE, samples).as_bytes()
    except z.ZstdError:  # too little text to train on
        base = b"".join(samples)[:BASE]
    toxic, ordinary = (_dictionary(x) + base for x in _segments(fit))
    model = {"toxic": toxic, "ordinary": ordinary, "weights": [0.0, 0.0, 0.0], "bias": -9.0}
    calibrate = rest if any(label for _, label in rest) and not all(label for _, label in rest) else fit
    if not sizes[1] or not sizes[0]:
        return model | {"bias": 9.0 if sizes[1] else -9.0}
    x = np.array([[*features(text, toxic, ordinary), 1.0] for text, _ in calibrate])
    y = np.array([label for _, label in calibrate], float)
    of_all = share if share else y.mean()
    weight = np.where(y == 1, of_all / y.mean(), (1 - of_all) / (1 - y.mean()))
    w = np.zeros(4)
    ridge = np.diag([0.05, 0.05, 0.05, 1e-3])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return model | {"weights": w[:3].tolist(), "bias": float(w[3])}


def score(text: str | None, model: dict) -> float:
    z = model["bias"] + sum(a * b for a, b in zip(model["weights"], features(text, model["toxic"], model["ordinary"]), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], float]:
    """The bounded sample, SAMPLE rows of each class, none of them held out; the share of label 1 in all of these."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order, share = F.xxhash64("doc_id", F.lit(7)), labels.agg(F.avg("toxic")).first()[0] or 0.0
    few = labels.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE).union(labels.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE))
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of labels that contradict each other the toxic one counts
    chosen = docs.join(F.broadcast(few), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = chosen.orderBy(order, "doc_id", "text").limit(4 * SAMPLE).collect()
    return [(r["text"], r["toxic"]) for r in rows], share


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    A null, empty or wordless text gets the score of a text without any saving; without labels of both classes the
    score is a constant. Rows repeating a doc_id each give a row; held_out of a null doc_id is false.
    """
    docs = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(*training_rows(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            yield pa.record_batch([batch.column("doc_id"), pa.array([score(t, model) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below THRESHOLD, with all their columns; row by row, without a join."""
    model = train(*training_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text", 4 << 20):
            yield batch.filter(pa.array([score(t, model) < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return bound_batches(docs).mapInArrow(run, docs.schema)

"""WARC archives and their capture index, merged externally.

Archives are written record by record into segments, rows (segment, payload) of a table in shared storage, so any
file system that Spark reaches will do; a segment's payload is a WARC 1.1 file. Reading a segment gives its captures;
each task sorts its own into runs. The key space (URL key, timestamp, page) is cut at quantiles of a fixed number of
sampled keys per run, and each range merges the blocks of its runs with a loser tree: concatenated, the ranges are
the globally ordered capture history.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bound_batches, freeze, partitions, sized_batches

#: Payload bytes below which a record is never a revisit; bytes of a segment; captures in a block of a run.
LEAST_REVISIT, SEGMENT, BLOCK = 1000, 8 << 20, 2048
#: Keys that a run offers for the cuts; captures in a range on average; ranges at most.
OFFERED, RANGE, MAX_RANGES = 64, 50_000, 10_000
#: Repeated payloads up to which their digests are broadcast; beyond, shares that a repeated digest's rows are dealt into.
REPEATED, SHARES = 200_000, 32

_EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed and joined by commas, then ``)`` and the path with its query."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return ")" + url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _header(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload that names the record it refers to."""
    when = (_EPOCH + timedelta(seconds=abs(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", when),
        ("WARC-Target-URI", _header(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        payload = b""
    fields.append(("Content-Length", str(len(payload))))
    return b"".join([b"WARC/1.1", _CRLF, *(f"{k}: {v}".encode() + _CRLF for k, v in fields), _CRLF, payload, _CRLF, _CRLF])


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, content) of each record of a segment."""
    at = 0
    while at < len(archive):
        end = archive.index(_CRLF + _CRLF, at)
        lines = archive[at:end].split(_CRLF)
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.decode(): v.decode() for k, _, v in (line.partition(b": ") for line in lines[1:])}
        body = end + 4
        stop = body + int(fields["Content-Length"])
        yield at, stop + 4 - at, fields, archive[body:stop]
        at = stop + 4


def _referring(rows: DataFrame) -> DataFrame:
    """``rows`` with refers_to, the response of a revisit. The digests of repeated payloads alone are gathered, from
    partial sums with a row per task and digest. Where there are few, counted beforehand, they are broadcast and no
    payload moves; else each one's rows are dealt into SHARES parts, so that no digest makes a task of its own."""
    first = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    first = freeze(first, "repeated-payloads").withColumn("large", F.lit(True))
    if first.count() <= REPEATED:
        joined = rows.join(F.broadcast(first), ["digest", "large"], "left")
    else:
        share = F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES))
        every = first.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        joined = rows.withColumn("share", share).join(every.hint("merge"), ["digest", "large", "share"], "left")
    return joined.withColumn("refers_to", F.when(F.col("response") != F.col("page_id"), F.col("response")))


def write_archives(pages: DataFrame) -> DataFrame:
    """Segments (segment string, payload binary) with one record per row of ``pages(page_id, url, html)``.

    Of equal payloads of LEAST_REVISIT bytes or more, that of the largest page_id is the response, others revisit it;
    a row repeating that page_id is a response as well. A null html is empty; a null page_id is a response.
    """
    rows = bound_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("large", F.octet_length("html") >= LEAST_REVISIT)
    rows = _referring(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([f"{part:06d}-{n:06d}.warc"]), pa.array([b"".join(held)], pa.binary())], ["segment", "payload"])
            held.clear()
            return out

        for batch in sized_batches(batches, "html", 4 << 20):
            for page, url, html, digest, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                held.append(record(page, url, html.encode(), digest, to))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield close()
                    n, size = n + 1, 0
        if held:
            yield close()

    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "segment string, payload binary")


Capture = tuple  # (url key, timestamp, page_id or None, segment, offset, length, type, digest, payload bytes, refers_to)


def captures(segment: str, payload: bytes) -> list[Capture]:
    """One per record, what is known of it read from the record; a response's digest and length from its content."""
    number = lambda s: None if s == "<urn:page:null>" else int(s[len("<urn:page:") : -1])
    out = []
    for at, length, f, body in records(payload):
        page, kind = number(f["WARC-Record-ID"]), f["WARC-Type"]
        stamp = re.sub(r"\D", "", f["WARC-Date"])
        digest, size = (hashlib.sha1(body).hexdigest(), len(body)) if kind == "response" else (f["WARC-Payload-Digest"][5:], int(f["X-Payload-Length"]))
        if digest != f["WARC-Payload-Digest"][5:]:
            raise ValueError(f"the content of page {page} doesn't match its digest")
        out.append((url_key(f["WARC-Target-URI"]), stamp, page, segment, at, length, kind, digest, size, number(f["WARC-Refers-To"]) if kind == "revisit" else None))
    return out


def order_key(c: Capture) -> tuple:
    return (c[0], c[1], c[2] is not None, c[2] or 0, c[3], c[4])


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator], key=order_key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [0] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), item)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) <= (y[0], b))

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


_RUN = "run long, seq int, n long, block binary"
_INDEX = "position long, url_key string, timestamp string, page_id long, segment string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs, one per batch of segments, as blocks; block -1 offers keys for the cuts."""
    part, run = TaskContext.get().partitionId(), 0
    for batch in sized_batches(batches, "payload", SEGMENT):
        own = sorted((c for s, p in zip(batch.column("segment").to_pylist(), batch.column("payload").to_pylist(), strict=True) for c in captures(s, p)), key=order_key)
        if not own:
            continue
        number, run = part << 24 | run, run + 1
        keys = [order_key(own[i * len(own) // OFFERED]) for i in range(min(OFFERED, len(own)))] if len(own) >= OFFERED else [order_key(c) for c in own]
        blocks = [(-1, len(own), pickle.dumps(keys))] + [(i // BLOCK, len(own[i : i + BLOCK]), pickle.dumps(own[i : i + BLOCK])) for i in range(0, len(own), BLOCK)]
        yield pa.record_batch([pa.array([number] * len(blocks)), pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks]), pa.array([b[2] for b in blocks], pa.binary())], ["run", "seq", "n", "block"])


def _cut(cuts: list[tuple]):
    """Blocks split at the cuts: rows (range, run, seq, block)."""
    from bisect import bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, seq, block in zip(*(batch.column(c).to_pylist() for c in ("run", "seq", "block")), strict=True):
                rows, start = pickle.loads(block), 0  # noqa: S301 our own bytes
                while start < len(rows):
                    r = bisect_right(cuts, order_key(rows[start]))
                    stop = len(rows)
                    if r < len(cuts):
                        lo, hi = start + 1, len(rows)
                        while lo < hi:
                            mid = (lo + hi) // 2
                            lo, hi = (mid + 1, hi) if order_key(rows[mid]) < cuts[r] else (lo, mid)
                        stop = lo
                    out.append((r, number, seq, pickle.dumps(rows[start:stop])))
                    start = stop
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["range", "run", "seq", "block"])

    return run


def _blocks(f, places: list[tuple[int, int]]) -> Iterator[Capture]:
    for at, n in places:
        f.seek(at)
        yield from pickle.loads(f.read(n))  # noqa: S301 our own bytes


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, run and seq: blocks wait in a temporary file of this task, a loser tree merges the runs."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in _INDEX.split(", ")]

    def merged(number: int, f, runs: dict[int, list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        held, position = [], number << 40
        for c in LoserTree([_blocks(f, places) for places in runs.values()]):
            held.append((position, *c))
            position += 1
            if len(held) == 4096:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    with tempfile.TemporaryFile() as f:
        now, runs = None, {}
        for batch in batches:
            for r, number, block in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "block")), strict=True):
                if r != now:
                    if runs:
                        yield from merged(now, f, runs)
                    f.seek(0)
                    f.truncate()
                    now, runs = r, {}
                f.seek(0, 2)
                runs.setdefault(number, []).append((f.tell(), len(block)))
                f.write(block)
        if runs:
            yield from merged(now, f, runs)


def capture_index(archives: DataFrame) -> DataFrame:
    """The captures of all segments; ``position`` ascends with (url_key, timestamp, page_id) over the whole index."""
    spark = bound_batches(archives).sparkSession
    runs = freeze(archives.mapInArrow(_runs, _RUN), "capture-runs")  # segments are read where they lie
    total = runs.where("seq = -1").agg(F.sum("n")).first()[0] or 0
    ranges = min(MAX_RANGES, max(1, -(-total // RANGE)))
    cuts: list[tuple] = []
    if ranges > 1:
        # A bounded number of runs offers keys: those of the smallest hashes
        offered = runs.where("seq = -1").orderBy(F.xxhash64("run")).limit(4 * MAX_RANGES // OFFERED).select("block").collect()
        keys = sorted(k for r in offered for k in pickle.loads(r["block"]))  # noqa: S301 our own bytes
        cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)})
    dealt = runs.where("seq >= 0").select("run", "seq", "block").mapInArrow(_cut(cuts), "range int, run long, seq int, block binary")
    dealt = dealt.repartition(max(len(cuts) + 1, partitions(spark)), "range").sortWithinPartitions("range", "run", "seq")
    return dealt.mapInArrow(_merge, _INDEX)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back through the merged index: one row per page."""
    index = capture_index(freeze(write_archives(pages), "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")

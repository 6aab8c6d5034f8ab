"""N-gram Jaccard join: a grouped prefix join on sets of distinct word shingles.

Shingles are ordered by corpus frequency (rare first). Two sets with Jaccard similarity of at least t share a token
among the first n - ceil(t n) + 1 of each, so only these prefixes are indexed. Documents with identical prefixes and
set size are one group: it has one posting per prefix token, and the size and positional filters judge pairs of groups.
A pair that passes is expanded into its members; those whose signatures (parity bitmaps, a filter that loses no similar
pair) are close enough are verified by their whole texts. Members of one set stand
for each other. Pairs are worked off in four steps:

1. within a group, every member meets the smallest one;
2. every group meets, of the centres of its prefix lists (the group with the fewest rarer shingles, as an original
   among its near copies), the one that it shares most lists with, member against member; links give components;
3. where pairs of groups in *different* components are many in a bucket of lists, as among copies that have no such
   original, a few draws of partners, one member each, join most of them: first those with the fewest rarer shingles
   in a list, then random ones;
4. once they are few, all pairs of groups whose members are still in different components are expanded in full, as are
   groups that are themselves in several.

A pair left out is already connected, so components are those of the complete link graph while a group of m copies
costs m verifications, not m * m. Postings travel as packed arrays, one row per (mapper, bucket).

Corner cases: null or wordless texts have an empty set, ``n_shingles`` 0, and link with nothing; rows repeating a
doc_id give a row each, all of one component: each text of the id is verified by itself and its links count for the id
(a union of the texts' sets is not formed); a null doc_id links with nothing and its component_id is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import bound_batches, discard, freeze, give_back, mix64, partitions, sized_batches, string_bytes
from veilspark.llm.components import components
from veilspark.llm.shingles import shingle_sets

#: Frequent shingles: each task names at most LOCAL_HOT, of which the HOT most frequent are broadcast (16 bytes each).
LOCAL_HOT, HOT = 1 << 14, 1 << 18
#: Postings that a task packs at once; those in a bucket on average; rows of the hash filter in front of the text lookup (a fixed size).
FLUSH, BUCKET, FILTER = 500_000, 500_000, 1 << 20
#: Draws at most before all pairs that are left meet; pairs for each group of a bucket that are few; partners that a group
#: picks from each list, at random and by the fewest rarer shingles; those kept in a bucket.
DRAWS, FEW, PICKS, FIRST, DRAWN = 4, 2, 4, 8, 64
#: Repeated sets up to which their list is broadcast (32 bytes each).
REPEATED = 200_000


#: Tells a group's hash of shingles from that of a whole set.
_GROUPED = np.uint64(0x2545F4914F6CDD1D)
#: And a signature's places from both.
_SIGNED = np.uint64(0x6A09E667F3BCC909)


def _sign(s: np.ndarray) -> bytes:
    """Parities of a set's members by hash, two to four for each member: signatures differ in no more bits than sets in members."""
    m = 1 << min(max(2 * len(s) - 1, 511).bit_length(), 16)
    return np.packbits(np.bincount((mix64(s ^ _SIGNED) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1 == 1).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two signatures differ; the longer one is folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    a, b, bits = int.from_bytes(x), int.from_bytes(y), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = a >> bits ^ a & (1 << bits) - 1
    return (a ^ b).bit_count()


def _statistics(k: int):
    """Per document: set size, 128-bit fingerprint and signature. Per task: its most repeated shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names, known = ["kind", "doc_id", "n", "f1", "f2", "sign"], np.zeros(0, np.int64)
        for batch in sized_batches(batches, "text", 4 << 20):
            sets = list(shingle_sets(*string_bytes(batch.column("text")), k))
            n = np.array([len(s) for s in sets], np.int64)
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            f2 = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), pa.array([_sign(s) for s in sets], pa.binary())], names)
            # copies of one set count once in a task: they are collapsed before the join
            new = np.unique(f1, return_index=True)[1]
            new = new[~np.isin(f1[new], known)]
            known = np.concatenate((known, f1[new]))[-200_000:]
            if not len(new):
                continue
            every, times = np.unique(np.concatenate([sets[i] for i in new]), return_counts=True)
            more = times > 1
            hot, where = np.unique(np.concatenate((hot, every[more])), return_inverse=True)
            count = np.bincount(where, np.concatenate((count, times[more])), len(hot)).astype(np.int64)
            if len(hot) > 32 * LOCAL_HOT:
                top = np.sort(np.lexsort((hot, -count))[: 16 * LOCAL_HOT])
                hot, count = hot[top], count[top]
        top = np.lexsort((hot, -count))[:LOCAL_HOT]
        top = top[count[top] > 1]
        none = pa.nulls(len(top), pa.int64())
        yield pa.record_batch([pa.array(np.ones(len(top), np.int32)), none, pa.array(count[top]), pa.array(hot[top].view(np.int64)), none, pa.nulls(len(top), pa.binary())], names)

    return run


def _prefixes(k: int, num: int, den: int, hot: np.ndarray, rank: np.ndarray, buckets: int):
    """Packed postings (token, group, set size, place) of every group that is new to its task, and the group of each
    document, packed in rows of a bucket below zero. A group is a hash of the set's size and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, bool)
        maybe[(hot >> np.uint64(44)).astype(np.int64)] = True
        seen: set[int] = set()
        tokens, docs, sizes, places, held = [], [], [], [], 0
        member, group, task = [], [], TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            token = np.concatenate([np.zeros(0, np.uint64), *tokens])
            each = [len(x) for x in tokens]
            doc, size, place = np.repeat(np.array(docs, np.int64), each), np.repeat(np.array(sizes, np.uint32), each), np.concatenate([np.zeros(0, np.uint32), *places])
            bucket = (mix64(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, *(x[order[s:e]].tobytes() for x in (token, doc, size, place))) for b, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > s]
            rows.append((-1 - task, np.array(group, np.int64).tobytes(), np.array(member, np.int64).tobytes(), b"", b""))
            for x in (tokens, docs, sizes, places, member, group):
                x.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["bucket", "token", "doc", "size", "place"])

        for batch in sized_batches(batches, "text", 4 << 20):
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(*string_bytes(batch.column("text")), k), strict=True):
                n = len(s)
                if not n or doc is None:
                    continue
                keep = n - (n * num + den - 1) // den + 1
                if len(hot):
                    at = np.flatnonzero(maybe[(s >> np.uint64(44)).astype(np.int64)])
                    i = np.minimum(np.searchsorted(hot, s[at]), len(hot) - 1)
                    is_hot = hot[i] == s[at]
                    at, i = at[is_hot], i[is_hot]
                    if len(at):
                        cold = np.ones(n, bool)
                        cold[at] = False
                        s = np.concatenate((s[cold], s[at][np.argsort(rank[i], kind="stable")]))
                s = s[:keep]
                name = int((mix64(s ^ _GROUPED).sum(dtype=np.uint64) ^ mix64(np.array([n], np.uint64))[0]).view(np.int64))
                member.append(doc)
                group.append(name)
                held += 1
                if name in seen:
                    continue  # the group is in this task's postings already
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                tokens.append(s)
                docs.append(name)
                sizes.append(n)
                places.append(np.arange(keep, dtype=np.uint32))
                held += keep
            if held > FLUSH:
                yield flush()
                held = 0
        if held:
            yield flush()

    return run


def _enough(na, nb, pa_, pb, num: int, den: int):
    """Size and positional filter for a token at places pa_ and pb of sets of na and nb tokens."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-num * (na + nb) // (num + den))
    return (den * small >= num * large) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= need)


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate((np.uint64, np.int64, np.uint32, np.uint32)))


def _lists(token, doc, size, place, *by):
    """Entries of tokens that at least two documents have, sorted by token, then ``by``; with their list's bounds."""
    order = np.lexsort((*by[::-1], token))
    token, doc, size, place = token[order], doc[order], size[order].astype(np.int64), place[order].astype(np.int64)
    first = np.concatenate(([True], token[1:] != token[:-1]))
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(token)))
    live = np.repeat(length > 1, length)
    token, doc, size, place, length = token[live], doc[live], size[live], place[live], length[length > 1]
    begin = np.repeat(np.cumsum(length) - length, length)
    return token, doc, size, place, begin, begin + np.repeat(length, length)


_PACK = "bucket long, token binary, doc binary, size binary, place binary"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows that are sorted by bucket, a bucket at a time: its packed postings and its (node, label) arrays."""
    now, packs, labels = None, [], []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
        for s, e in zip(edges, [*edges[1:], len(bucket)], strict=True):
            if bucket[s] != now:
                if packs:
                    yield now, packs, labels
                now, packs, labels = bucket[s], [], []
            part = batch.slice(s, e - s)
            packed = np.flatnonzero(np.asarray(part.column("token").is_valid()))
            cols = [part.column(c) for c in ("token", "doc", "size", "place")]
            packs += [tuple(c[int(i)].as_buffer() for c in cols) for i in packed]
            if "node" in part.schema.names and len(packed) < e - s:
                plain = part.filter(part.column("token").is_null())
                labels.append((plain.column("node").to_numpy(zero_copy_only=False).astype(np.int64), plain.column("label").to_numpy(zero_copy_only=False).astype(np.int64)))
    if packs:
        yield now, packs, labels
    give_back()


def _partnered(token, size, num: int, den: int) -> np.ndarray:
    """Entries whose list has another one of a size that may be similar; its neighbour by size is the best case."""
    order = np.lexsort((size, token))
    t, n = token[order], size[order].astype(np.int64)
    near = (t[1:] == t[:-1]) & (den * n[:-1] >= num * n[1:])
    out = np.zeros(len(t), bool)
    out[order[1:]] |= near
    out[order[:-1]] |= near
    return out


def _centres(num: int, den: int, buckets: int):
    """Step 2 of a bucket: each group's best centres (kind 0), which groups the lists that live on name (1), these
    lists (2). Buckets below zero pass on the group of each document (3).

    A centre counts if a quarter of the group's prefix tokens that this bucket should have name it: others are no
    near copies as a rule, and step 4 meets them anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packs, _ in _grouped(batches):
            if bucket < 0:
                for group, member, _, _ in packs:
                    yield _rows(3, bucket, np.frombuffer(member, np.int64), np.frombuffer(group, np.int64), None)
                continue
            arrays = _arrays(packs)
            packs.clear()
            order = np.lexsort((arrays[1], arrays[0]))  # a group of several tasks counts once in a list
            order = order[np.concatenate(([True], (np.diff(arrays[0][order]) != 0) | (np.diff(arrays[1][order]) != 0)))]
            arrays = tuple(x[order] for x in arrays)
            live = _partnered(arrays[0], arrays[2], num, den)
            arrays = tuple(x[live] for x in arrays)
            # a group whose copies differ from it by rare shingles has none of these before its common ones
            token, doc, size, place, begin, _ = _lists(*arrays, arrays[3], arrays[1])
            if not len(doc):
                continue
            centre = doc[begin]
            ok = (doc != centre) & _enough(size, size[begin], place, place[begin], num, den)
            v, c = doc[ok], centre[ok]
            order = np.lexsort((c, v))
            v, c = v[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])))) if len(v) else np.zeros(0, np.int64)
            v, c, times = v[new], c[new], np.diff(np.append(new, len(v)))
            named, at = np.unique(doc, return_index=True)
            n = size[at[np.searchsorted(named, v)]]
            likely = times > (n - (n * num + den - 1) // den + 1) // (4 * buckets)
            v, c, times = v[likely], c[likely], times[likely]
            yield _rows(0, bucket, v, c, times)
            yield _rows(1, bucket, named, named, np.zeros(len(named), np.int64))
            yield _rows(2, bucket, *([None] * 3), [x.tobytes() for x in (token, doc, size.astype(np.uint32), place.astype(np.uint32))])

    return run


_STEP = "kind int, bucket long, a long, b long, times long, token binary, doc binary, size binary, place binary"


def _rows(kind: int, bucket: int, a, b, times, packed=None) -> pa.RecordBatch:
    n = 1 if packed else len(a)
    ints = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int64))]
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in (a, b, times)]
    blobs = [pa.array([x], pa.binary()) for x in packed] if packed else [pa.nulls(n, pa.binary())] * 4
    return pa.record_batch([*ints, *longs, *blobs], [x.split()[0] for x in _STEP.split(", ")])


def _mixed(doc, begin, mine) -> np.ndarray:
    """Entries of the lists that have several components."""
    starts = np.unique(begin)
    mixed = np.minimum.reduceat(mine, starts) != np.maximum.reduceat(mine, starts) if len(starts) else np.zeros(0, bool)
    return np.flatnonzero(np.repeat(mixed, np.diff(np.append(starts, len(doc)))))


def _drawn(lists, entries, mine, at, draw: int, num: int, den: int) -> np.ndarray:
    """A few pairs of each group: those with the FIRST groups of its lists (draw 0), or another random choice for each number."""
    _, doc, size, place, begin, end = lists
    i = np.repeat(entries, PICKS if draw else FIRST)
    if draw:
        j = begin[i] + (mix64(np.arange(len(i), dtype=np.uint64) + np.uint64(1 + draw << 40)) % (end[i] - begin[i]).astype(np.uint64)).astype(np.int64)
    else:
        j = np.minimum(begin[i] + np.tile(np.arange(FIRST), len(entries)), end[i] - 1)
    ok = (mine[i] != mine[j]) & _enough(size[i], size[j], place[i], place[j], num, den)
    x, y = at[i[ok]].astype(np.uint64), at[j[ok]].astype(np.uint64)
    some = np.unique(np.minimum(x, y) << np.uint64(32) | np.maximum(x, y))
    some = some[np.lexsort((mix64(some), some >> np.uint64(32)))]
    new = np.flatnonzero(np.diff(some >> np.uint64(32), prepend=np.uint64(0xFFFFFFFF)))
    rank = np.arange(len(some)) - np.repeat(new, np.diff(np.append(new, len(some))))
    return some[rank < DRAWN]


_FOUND = "bucket long, a long, b long, whole boolean"


def _rest(num: int, den: int, draw: int, few: int | None, chunk: int = 1 << 18):
    """Steps 3 and 4 of a bucket: all pairs of groups of different components that pass the filters, each once (whole).

    Where there are more than ``few`` for each group, a draw of them instead, and a row without a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packs, maps in _grouped(batches):
            arrays = _arrays(packs)
            packs.clear()
            token, doc, size, place, begin, end = _lists(*arrays, arrays[2])
            ids, at = np.unique(doc, return_inverse=True)
            label = ids.copy()
            if maps:
                node, to = (np.concatenate(x) for x in zip(*maps, strict=True))
                label[np.searchsorted(ids, node)] = to
            mine = label[at]
            entries = _mixed(doc, begin, mine)
            if not len(entries):
                continue
            # within a list entries ascend by size: partners of i follow it, up to size * den / num
            scale = np.int64(size.max() * den + 1)
            list_no = np.cumsum(np.concatenate(([0], begin[1:] != begin[:-1]))).astype(np.int64)
            key = list_no * scale + size
            stop = np.searchsorted(key, list_no[entries] * scale + size[entries] * den // num, side="right")
            partners = np.maximum(stop - entries - 1, 0)
            most = None if few is None else few * len(ids) + 1000
            found = np.zeros(0, np.uint64)
            edge = 0
            while edge < len(entries):
                upto = max(edge + 1, int(np.searchsorted(np.cumsum(partners[edge:]), chunk, side="right")) + edge)
                n = partners[edge:upto]
                i = np.repeat(entries[edge:upto], n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                ok = (mine[i] != mine[j]) & _enough(size[i], size[j], place[i], place[j], num, den)
                x, y = at[i[ok]].astype(np.uint64), at[j[ok]].astype(np.uint64)
                found = np.unique(np.concatenate((found, np.minimum(x, y) << np.uint64(32) | np.maximum(x, y))))
                if most is not None and len(found) > most:
                    break
                if most is None and len(found) > 4 * chunk:
                    yield _pairs(bucket, ids, found, True)
                    found = found[:0]
                edge = upto
            if most is not None and len(found) > most:
                lists = (token, doc, size, place, begin, end)
                if draw == 0:
                    lists = _lists(*arrays, arrays[3], arrays[1])
                    at = np.searchsorted(ids, lists[1])
                    mine = label[at]
                    entries = _mixed(lists[1], lists[4], mine)
                yield _pairs(bucket, ids, _drawn(lists, entries, mine, at, draw, num, den), False)
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([pa.array([bucket], pa.int64()), none, none, pa.array([False])], [x.split()[0] for x in _FOUND.split(", ")])
            elif len(found):
                yield _pairs(bucket, ids, found, True)

    return run


def _pairs(bucket: int, ids: np.ndarray, packed: np.ndarray, whole: bool) -> pa.RecordBatch:
    a, b = ids[(packed >> np.uint64(32)).astype(np.int64)], ids[(packed & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return pa.record_batch([pa.array(np.full(len(a), bucket, np.int64)), pa.array(a), pa.array(b), pa.array(np.full(len(a), whole))], [x.split()[0] for x in _FOUND.split(", ")])


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(sized_batches(batches, "ta", 4 << 20), "tb", 4 << 20):
            near = []
            for x, y in zip(shingle_sets(*string_bytes(batch.column("ta")), k), shingle_sets(*string_bytes(batch.column("tb")), k), strict=True):
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                near.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _possible(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
            near = [(num + den) * _apart(x, y) <= (den - num) * (m + n) for m, n, x, y in both]
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def possible(signs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs(a, b)`` without those whose signatures differ in more bits than similar sets do in members. A similar pair
    is never lost, and texts travel for few others. doc_id must be unique in ``signs(doc_id, n, sign)``."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    slots = F.broadcast(pairs.select(slot("a").alias("s")).union(pairs.select(slot("b").alias("s"))).distinct())
    some = signs.join(slots, slot(signs["doc_id"]) == slots["s"], "left_semi")
    joined = pairs.join(some.toDF("a", "na", "sa"), "a").join(some.toDF("b", "nb", "sb"), "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(num, den), "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole texts have a similarity of num / den or more. doc_id must be unique in docs."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    slots = F.broadcast(pairs.select(slot("a").alias("s")).union(pairs.select(slot("b").alias("s"))).distinct())
    texts = docs.join(slots, slot(docs["doc_id"]) == slots["s"], "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(k, num, den), "a long, b long")


def _group_labels(members: DataFrame, told: DataFrame) -> DataFrame:
    """(grp, label) of the groups whose members are all of one component that has a label; others count as their own."""
    known = told.union(told.select("label", "label").distinct())
    of = members.join(known, "node", "left").groupBy("grp").agg(F.count("*").alias("n"), F.count("label").alias("k"), F.min("label").alias("label"), F.max("label").alias("most"))
    return of.where("k = n and label = most").select("grp", "label")


def _links_of(step: DataFrame, labels: DataFrame, buckets: DataFrame | None) -> DataFrame:
    """The lists that live on, of all buckets or of those given, beside the labels of the groups that they name."""
    if buckets is not None:
        step = step.join(F.broadcast(buckets), "bucket", "left_semi")  # a number for BUCKET postings
    maps = step.where("kind = 1").select("bucket", F.col("a").alias("grp")).join(labels, "grp").withColumnRenamed("grp", "node")
    blob = [F.lit(None).cast("binary").alias(c) for c in ("token", "doc", "size", "place")]
    none = [F.lit(None).cast("long").alias(c) for c in ("node", "label")]
    return step.where("kind = 2").select("bucket", "token", "doc", "size", "place", *none).unionByName(maps.select("bucket", *blob, "node", "label"))


def _expanded(found: DataFrame, members: DataFrame, told: DataFrame, draw: int, last: bool) -> DataFrame:
    """(a, b): member pairs of different components, of the group pairs found and within groups of several components.

    A drawn pair is stood for by one member of each group, another one for each draw; groups of several components are
    expanded in full the last time.
    """
    every = members.join(told, "node", "left").select("grp", "node", F.coalesce("label", "node").alias("label"))
    each = every.groupBy("grp").agg(F.max_by(F.struct("node", "label"), F.xxhash64("node", F.lit(draw))).alias("m")).select("grp", "m.*")
    pairs = found.where("a is not null").groupBy("a", "b").agg(F.max("whole").alias("whole"))
    out = []
    for whole, of in ((True, every), (False, each)):
        if whole or not last:
            some = pairs.where("whole" if whole else "not whole")
            out.append(some.join(of.toDF("a", "x", "lx"), "a").join(of.toDF("b", "y", "ly"), "b"))
    several = every.groupBy("grp").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("grp")
    inside = every.join(several, "grp").toDF("g", "x", "lx").join((every if last else each).toDF("g", "y", "ly"), "g")
    out.append(inside.where("x < y") if last else inside)
    both = [p.where("lx <> ly").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")) for p in out]
    return reduce(DataFrame.union, both).distinct()


def _merged(told: DataFrame, links: DataFrame) -> DataFrame:
    """``told(node, label)`` after more links: only the labels that these name go through the rounds."""
    for c in ("a", "b"):
        links = links.join(told.select(F.col("node").alias(c), "label"), c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
    moved = freeze(components(links).where("node <> label"), "labels")
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return freeze(told.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")).union(moved), "labels")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``."""
    docs = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _repeats(docs):
        return _text_components(docs, docs, k, percent)
    # a repeated id may have several texts: a node is an id with one text, and nodes of one id are joined at the end
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    keyed = docs.select(node.alias("node"), "doc_id", "text")
    ids = keyed.where("node is not null").select("node", "doc_id").distinct()
    texts = keyed.select(F.col("node").alias("doc_id"), "text")
    parts = _text_components(texts, texts.where("doc_id is not null").dropDuplicates(["doc_id"]), k, percent).toDF("node", "n_shingles", "part")
    rows = freeze(parts.join(ids, "node", "left").select("doc_id", "n_shingles", "part"), "node-parts")
    of_id = rows.where("doc_id is not null").select("doc_id", "part").distinct()
    links = of_id.join(of_id.groupBy("doc_id").agg(F.min("part").alias("a")), "doc_id").where("part <> a").select("a", F.col("part").alias("b")).distinct()
    moved = freeze(components(freeze(links, "links")), "labels").select(F.col("node").alias("part"), F.col("label").alias("to"))
    joined = rows.join(moved, "part", "left").select("doc_id", "n_shingles", F.coalesce("to", "part").alias("part"))
    names = joined.where("doc_id is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return joined.join(names, "part", "left").select("doc_id", "n_shingles", "component_id")


def _text_components(docs: DataFrame, one_text: DataFrame, k: int, percent: int) -> DataFrame:
    """The same where rows that repeat a doc_id have one text; ``one_text`` has each doc_id once."""
    num, den = percent, 100
    seen = freeze(docs.mapInArrow(_statistics(k), "kind int, doc_id long, n long, f1 long, f2 long, sign binary"), "shingle-stats")
    # A bounded list, whatever the corpus: the HOT most frequent shingles
    hot = seen.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f1").limit(HOT).collect()
    token = np.array([r["f1"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(token)
    rank = (len(hot) - np.arange(len(hot)))[order]
    stats = seen.where("kind = 0").drop("kind", "sign")
    signs = seen.where("kind = 0 and doc_id is not null").select("doc_id", "n", "sign")
    if one_text is not docs:
        signs = signs.dropDuplicates(["doc_id"])
    sets = stats.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    sets = freeze(sets, "shingle-sets")
    total = sets.agg(F.sum(F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    spread = lambda df: df.repartition(max(partitions(df.sparkSession), buckets), "bucket").sortWithinPartitions("bucket")
    packs = docs.mapInArrow(_prefixes(k, num, den, token[order], rank, buckets), _PACK)
    step = freeze(spread(packs).mapInArrow(_centres(num, den, buckets), _STEP), "prefix-lists")
    several = sets.where("copies > 1")
    if several.count() <= REPEATED:
        several = F.broadcast(several)
    other = freeze(stats.where("n > 0").join(several, ["n", "f1", "f2"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "set-copies")
    members = step.where("kind = 3").select(F.col("a").alias("node"), F.col("b").alias("grp"))
    members = freeze(members.join(sets.select(F.col("rep").alias("node")), "node", "left_semi").dropDuplicates(["node"]), "group-members")
    heads = members.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    inside = members.join(heads.where("n > 1"), "grp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    best = step.where("kind = 0").groupBy("a", "b").agg(F.sum("times").alias("times")).groupBy("a").agg(F.max_by("b", F.struct(F.col("times"), -F.col("b"))).alias("b"))
    across = best.join(heads.select(F.col("grp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("grp").alias("b"), F.col("head").alias("y")), "b")
    met = freeze(inside.union(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), "pairs")
    close = freeze(possible(signs, met, num, den), "pairs")
    first = freeze(verified(one_text, close, k, num, den), "links")
    told = freeze(components(first.union(other.toDF("a", "b"))).where("node <> label"), "labels")
    done = [met, close, first]
    left = None
    for draw in range(DRAWS + 1):
        lists = spread(_links_of(step, _group_labels(members, told), left))
        found = freeze(lists.mapInArrow(_rest(num, den, draw, FEW if draw < DRAWS else None), _FOUND), "group-pairs")
        left = found.where("a is null").select("bucket").distinct()
        last = left.isEmpty()
        some = freeze(_expanded(found, members, told, draw, last), "pairs")
        close = freeze(possible(signs, some, num, den), "pairs")
        more = freeze(verified(one_text, close, k, num, den), "links")
        done += [found, some, close, more]
        if not more.isEmpty():
            told = _merged(told, more)
        if last:
            break
    discard(step, members, other, sets, *done)
    final = told.select(F.col("node").alias("doc_id"), "label")
    return stats.join(final, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def _repeats(docs: DataFrame) -> bool:
    """Does any doc_id occur twice? Counted by id with partial sums."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()

"""Exact metric range join of embeddings: pivots partition the vectors, the triangle inequality sets replication.

The metric is the angle between vectors. Every vector goes to the cell of its nearest pivot. A vector x within angle
r of some vector of cell j satisfies both angle(x, p_j) <= R_j + r (R_j: the cell's radius) and angle(x, p_j) -
angle(x, p_home) <= 2 r; it is replicated to the cells that host their pairs with x's cell and where both hold, so each
pair meets in one cell. Of two cells the lower one hosts if the sum of their numbers is odd, else the higher one: all
cells host as many. Cells join independently. A cell of more than a block of vectors (BLOCK_BYTES of components) is dealt
over several units by hash: unit u holds block u and is met by the cell's replicas and by those of its blocks that it
hosts, by the same rule, so no task holds more than a block (and a batch).

Equal vectors collapse first and count with their multiplicity. Cosines of candidates are taken in double precision.
A unit reports link counts and a spanning forest, never its pairs.

On data without clusters in many dimensions the triangle inequality excludes little (any exact method degrades to
comparing blocks of all vectors); results stay exact. A vector is then sent to about half of all units.

Corner cases: null, empty, all-zero, null- or non-finite-holding vectors link with nothing and are their own
component; vectors of different lengths never link; rows repeating a vec_id are joined through it as one node; a null
vec_id never links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import discard, freeze, partitions
from veilspark.llm.components import components

#: Bytes of doubles in a block; distinct vectors for each of the first pivots. Pivots are chosen by hash: one for a block,
#: LEAST_PIVOTS at least, MAX_PIVOTS at most for all lengths together (what tasks are sent is bounded by it).
BLOCK_BYTES, PER_FIRST, LEAST_PIVOTS, MAX_PIVOTS = 16 << 20, 16, 8, 1024
#: Guards the replication test and the single-precision candidate test against rounding.
SLACK = 1e-4

_DEALT = "unit long, role int, block int, node long, copies long, v binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles packed as bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("v")
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(n)
        unit = []
        for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True):
            row = flat[s:e] / np.abs(flat[s:e]).max()  # so that squares neither overflow nor vanish
            unit.append((row / np.sqrt((row * row).sum())).tobytes())
        yield pa.record_batch([batch.column("node"), batch.column("copies"), pa.array(n.astype(np.int32)), pa.array(unit, pa.binary())], ["node", "copies", "d", "v"])


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def block_rows(d: int) -> int:
    """Vectors of length d in a block."""
    return max(256, BLOCK_BYTES // (8 * d))


def _hosts(j, other):
    """Does cell (or block) j host its pairs with the others?"""
    return np.where(other > j, (other + j) % 2 == 1, (other < j) & ((other + j) % 2 == 0))


def _homes(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy()
            home, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) not in pivots:  # a rare length: one cell
                    continue
                a = _angles(_matrix(batch.column("v").take(pa.array(at))), pivots[int(d)])
                home[at], away[at] = a.argmin(1), a.min(1)
            yield pa.record_batch([*batch.columns, pa.array(home), pa.array(away)], [*batch.schema.names, "home", "away"])

    return run


def _deal(pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[float, int]], first_unit: dict[tuple[int, int], int], reach: float):
    """Rows for each unit: role 0 is of the unit's own block, role 1 of another block or cell."""
    by_length: dict[int, list[int]] = {}
    for d, j in cells:
        by_length.setdefault(d, []).append(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims, home, away = (batch.column(c).to_numpy() for c in ("d", "home", "away"))
                node = batch.column("node").to_numpy()
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    here = by_length[int(d)]
                    near = _angles(_matrix(batch.column("v").take(pa.array(rows))), pivots[int(d)]) if int(d) in pivots else np.zeros((len(rows), 1))
                    pick, unit, role, block = [], [], [], []
                    for j in here:
                        radius, blocks = cells[int(d), j]
                        base = first_unit[int(d), j]
                        own = np.flatnonzero(home[rows] == j)
                        mine = (node[rows[own]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                        meets = np.flatnonzero(_hosts(j, home[rows]) & (near[:, j] <= radius + reach + SLACK) & (near[:, j] - away[rows] <= 2 * reach + SLACK))
                        for u in range(blocks):
                            here_too = (mine == u) | _hosts(u, mine)
                            met = own[here_too]
                            pick += [rows[met], rows[meets]]
                            role.append(np.concatenate((mine[here_too] != u, np.ones(len(meets), bool))))
                            block.append(np.concatenate((mine[here_too], np.full(len(meets), -1))))
                            unit.append(np.full(len(met) + len(meets), base + u))
                    if pick:
                        part = batch.take(pa.array(np.concatenate(pick)))
                        yield pa.record_batch([pa.array(np.concatenate(unit)), pa.array(np.concatenate(role).astype(np.int32)), pa.array(np.concatenate(block).astype(np.int32)), *(part.column(c) for c in ("node", "copies", "v"))], [x.split()[0] for x in _DEALT.split(", ")])

    return run


class _Unit:
    """The own block of a unit, met by batches of rows: link counts and a spanning forest."""

    def __init__(self, cosine: float):
        self.cosine, self.own = cosine, []

    def build(self) -> None:
        self.node, self.copies = (np.concatenate([x[i] for x in self.own]) for i in (0, 1))
        self.v = np.concatenate([x[2] for x in self.own])
        self.v4 = self.v.astype(np.float32)
        self.links, self.label, self.own = np.zeros(len(self.node), np.int64), self.node.copy(), []

    def meet(self, node, copies, v, own_from: int | None = None):
        """(node, links, label) of the rows met that have a link. own_from: they are rows of the own block from there on."""
        out = []
        for s in range(0, len(node), 256):
            n, c, x = node[s : s + 256], copies[s : s + 256], v[s : s + 256]
            i, j = np.nonzero(x.astype(np.float32) @ self.v4.T >= self.cosine - SLACK)
            if own_from is not None:
                later = j > own_from + s + i
                i, j = i[later], j[later]
            hit = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], self.v[j[a : a + 65536]]) >= self.cosine for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            got = np.zeros(len(n), np.int64)
            np.add.at(got, i, self.copies[j])
            np.add.at(self.links, j, c[i])
            before = self.label.copy()
            label = n.copy() if own_from is None else self.label[own_from + s : own_from + s + len(n)]  # a view
            while True:
                least = np.minimum(label[i], self.label[j])
                if (least == label[i]).all() and (least == self.label[j]).all():
                    break
                np.minimum.at(label, i, least)
                np.minimum.at(self.label, j, least)
            fell = np.flatnonzero(before != self.label)  # what a label was stays tied to what it is now
            out.append((before[fell], np.zeros(len(fell), np.int64), self.label[fell]))
            rows = np.unique(i)
            if own_from is None:
                out.append((n[rows], got[rows], label[rows]))
            else:
                self.links[own_from + s + rows] += got[rows]
        return out


def _join(cosine: float):
    names = ["node", "links", "label"]

    def table(found: list[tuple]) -> pa.RecordBatch:
        node, links, label = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.lexsort((label, node))
        node, links, label = node[order], links[order], label[order]
        if not len(node):
            return pa.record_batch([pa.array([], pa.int64())] * 3, names)
        new = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (label[1:] != label[:-1]))))
        return pa.record_batch([pa.array(node[new]), pa.array(np.add.reduceat(links, new)), pa.array(label[new])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit, ready, found = None, None, False, []

        def close():
            if unit is not None and (ready or unit.own):
                if not ready:
                    start()
                hit = unit.links > 0
                found.append((unit.node[hit], unit.links[hit], unit.label[hit]))
            if found:
                yield table(found)
                found.clear()

        def start():
            unit.build()
            order = np.argsort(unit.node)
            for k in ("node", "copies", "v", "v4", "label", "links"):
                setattr(unit, k, getattr(unit, k)[order])
            found.extend(unit.meet(unit.node, unit.copies, unit.v, 0))

        for batch in batches:
            if not batch.num_rows:
                continue
            u, role = batch.column("unit").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (role[1:] != role[:-1]))))
            for s, e in zip(cuts, [*cuts[1:], len(u)], strict=True):
                if u[s] != now:
                    yield from close()
                    now, unit, ready = u[s], _Unit(cosine), False
                part = batch.slice(s, e - s)
                rows = part.column("node").to_numpy(), part.column("copies").to_numpy(), _matrix(part.column("v"))
                if role[s] == 0:
                    unit.own.append(rows)
                elif unit.own or ready:
                    if not ready:
                        start()
                        ready = True
                    found.extend(unit.meet(*rows))
                if len(found) > 256:
                    yield table(found)
                    found.clear()
        yield from close()

    return run


def embedding_links(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding)``."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.withColumn("ok", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    keyed = vectors.withColumn("k1", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(7), "embedding")))
    classes = keyed.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("embedding").alias("v"))
    ids = freeze(keyed.select("vec_id", "k1", "k2"), "vector-keys")
    distinct = freeze(classes, "vectors")
    points = freeze(distinct.select("node", "copies", "v").mapInArrow(_pack, "node long, copies long, d int, v binary"), "unit-vectors")
    # a row per length of vectors; the MAX_PIVOTS commonest lengths have pivots, others one cell each
    sizes = {r["d"]: r["n"] for r in points.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()}
    reach = math.acos(cosine)
    pivots, share = {}, max(1, sum(sizes.values()))
    for d, n in list(sizes.items())[:MAX_PIVOTS]:
        k = max(1, min(max(-(-n // block_rows(d)), min(LEAST_PIVOTS, n // PER_FIRST)), MAX_PIVOTS * n // share))
        if k == 1:
            continue
        rows = points.where(F.col("d") == d).orderBy(F.xxhash64("node"), "node").limit(k).select("v").collect()
        pivots[d] = np.stack([np.frombuffer(r["v"], np.float64) for r in rows])
    placed = freeze(points.mapInArrow(_homes(pivots), "node long, copies long, d int, v binary, home int, away double"), "cells")
    # One row per cell, MAX_PIVOTS and the number of lengths at most
    cells = {(r["d"], r["home"]): (r["radius"], -(-r["n"] // block_rows(r["d"]))) for r in placed.groupBy("d", "home").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    first_unit, units = {}, 0
    for key, (_, blocks) in sorted(cells.items()):
        first_unit[key] = units
        units += blocks
    dealt = placed.mapInArrow(_deal(pivots, cells, first_unit, reach), _DEALT)
    dealt = dealt.repartition(max(units, partitions(vectors.sparkSession)), "unit").sortWithinPartitions("unit", "role")
    found = freeze(dealt.drop("block").mapInArrow(_join(cosine), "node long, links long, label long"), "vector-links")
    discard(points, placed)
    links = found.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    labels = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    per_class = distinct.select("k1", "k2", "node", "copies").join(links, "node", "left").join(labels, "node", "left")
    per_class = per_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    out = ids.join(per_class, ["k1", "k2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

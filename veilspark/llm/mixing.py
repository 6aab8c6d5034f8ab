"""Mixing sources to target weights by pivotal dependent rounding.

A source's target (in words) over its size is the number of copies each of its documents should get. The whole part
is given to all; the fraction is rounded by pairs: of two documents, mass moves from one to the other, in either
direction with the probability that keeps each one's expectation, until one of them is integral. Mass is measured in
words, so a pair's expected words stay exactly what they were, and a source misses its target by one document at most.

Documents are dealt to groups by a hash, each group settles its pairs and hands up one fractional document for each
source; the next level pairs these, with FAN times fewer groups, until one is left, which goes to the nearer count. Coins are
hashes of the document and the level, so reruns agree, whatever the partitions.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import WORD, freeze

#: Weights of the sources by code point, repeating; the share of all sizes to take; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents in a group of the first level on average, and groups that one group of the next level takes in.
GROUP, FAN = 4096, 64

_ROW = "doc_id long, row long, source string, size long, source_size long, target double, copies double"


def word_count(text):
    """Runs of bytes other than space and U+0009..U+000D; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``: one row per source.

    The total share is dealt by weight; no target exceeds ``most`` times its source's size, and the excess is dealt
    again by weight among the others until none is above. That is the level l with sum(min(most * size, l * weight))
    equal to the total: sources fill in ascending order of most * size / weight, which one running sum finds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = len(weights)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % k + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full, rest = F.coalesce(F.sum("most").over(upto), F.lit(0.0)), F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    # the level if this source and those after it aren't full
    per = per.withColumn("level", (F.sum("source_size").over(every) * float(share) - full) / rest)
    # from the first source that isn't full on the level stays; those before are full
    per = per.withColumn("n", F.row_number().over(order))
    per = per.withColumn("first", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("n"))).over(every))
    at = F.max(F.when(F.col("n") == F.col("first"), F.col("level"))).over(every)
    per = per.withColumn("target", F.when(F.col("first").isNull() | (F.col("n") < F.col("first")), F.col("most")).otherwise(F.least("most", at * F.col("w"))))
    return per.select("source", "source_size", "target")


def _coin(doc_id, row: int, level: int) -> float:
    digest = hashlib.blake2b(f"{doc_id}:{row}:{level}".encode(), digest_size=8).digest()
    return (int.from_bytes(digest, "big") + 0.5) / 2**64


def _settle(level: int, last: bool):
    """Pairs within a group, source by source; what stays fractional is handed up unless this is the last level."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "size", "doc_id", "row"], ascending=[True, False, True, True], na_position="last", ignore_index=True)  # small documents last, so that little is left
        copies = group["copies"].tolist()
        size, ids, rows = group["size"].tolist(), group["doc_id"].tolist(), group["row"].tolist()
        source = group["source"].where(group["source"].notna(), None).tolist()
        held = None
        for i, c in enumerate(copies):
            if held is not None and source[held] != source[i]:
                if last:
                    copies[held] = _flip(copies[held], ids[held], rows[held])
                held = None
            if c == int(c):
                continue
            if held is None:
                held = i
                continue
            a, b = held, i
            fa, fb = copies[a] % 1, copies[b] % 1
            up = min((1 - fa) * size[a], fb * size[b])  # words that may move from b to a, and from a to b
            down = min(fa * size[a], (1 - fb) * size[b])
            to_a = _coin(ids[b], rows[b], level) * (up + down) < down
            moved = up if to_a else -down
            fa, fb = fa + moved / size[a], fb - moved / size[b]
            a_done = (to_a and (1 - copies[a] % 1) * size[a] <= up) or (not to_a and (copies[a] % 1) * size[a] <= down)
            b_done = (to_a and (copies[b] % 1) * size[b] <= up) or (not to_a and (1 - copies[b] % 1) * size[b] <= down)
            copies[a] = int(copies[a]) + (round(fa) if a_done else fa)
            copies[b] = int(copies[b]) + (round(fb) if b_done else fb)
            held = None if a_done and b_done else b if a_done else a
        if held is not None and last:
            copies[held] = _flip(copies[held], ids[held], rows[held])
        return group.assign(copies=[float(c) for c in copies])

    return run


def _flip(copies: float, doc_id, row: int) -> int:
    """The one document that a source is left with goes to the nearer count; a coin decides a tie."""
    part = copies % 1
    return int(copies) + (part > 0.5 or part == 0.5 and _coin(doc_id, row, -1) < 0.5)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, source, h)`` with ``row``, which tells rows of one doc_id apart: a hash of the text's hash, the source and
    a number among rows that are equal in all of these, which stand for each other. Only such rows meet in a window."""
    same = ["doc_id", "h", "source"]
    once = rows.groupBy(*same).count().where("count > 1").isEmpty()
    number = F.lit(1) if once else F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    return rows.withColumn("row", F.xxhash64("h", "source", number))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, row, size, source_size, target, copies) for each row of ``docs(doc_id, source, text)``.

    Rows repeating a doc_id are told apart by ``row`` and rounded apart.
    A null or wordless text has size 0, gets no fraction and as many whole copies as its source's documents; a null
    source is a source of its own, ordered last. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"), F.xxhash64("text").alias("h"))
    base = freeze(base, "mix-sizes")
    base = _numbered(base).drop("h")
    targets = source_targets(base.select("source", "size"), weights, share, most)
    # One small row per source. The large side keeps its partitions if Spark finds this side small enough to broadcast
    joined = base.join(targets, base["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    joined = joined.withColumn("copies", F.when(F.col("size") > 0, each).otherwise(F.floor(each).cast("double"))).select(*[x.split()[0] for x in _ROW.split(", ")])
    now, done, level = freeze(joined, "mix-copies"), [], 0
    groups = max(1, -(-now.count() // GROUP))
    while True:
        last = groups == 1 and level > 0
        key = F.pmod(F.xxhash64("doc_id", "row", F.lit(99)), F.lit(groups))
        # above the first level a group is of some sources only, so that many sources don't meet in one task
        keys = [key.alias("g")] if level == 0 else [key.alias("g"), F.pmod(F.xxhash64("source"), F.lit(256)).alias("s")]
        settled = freeze(now.groupBy(*keys).applyInPandas(_settle(level, last), _ROW), f"mix-level{level}")
        whole = F.col("copies") == F.floor("copies")
        done.append(settled if last else settled.where(whole))
        if last:
            break
        now, level, groups = settled.where(~whole), level + 1, -(-groups // FAN)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.withColumn("copies", F.col("copies").cast("long"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows repeating a doc_id are counted one by one.

    Columns may have any names: the row travels as one struct.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("h"))
    keyed = _numbered(keyed)
    counts = mix(docs).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("row").alias("r"), "copies")
    on = keyed["doc_id"].eqNullSafe(counts["id"]) & (keyed["row"] == counts["r"])
    return keyed.join(counts, on).select("kept", F.explode(F.expr("sequence(1, copies)")).alias("time")).select("kept.*")

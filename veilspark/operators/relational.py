"""Predicates, projections, joins, aggregation, sorting: declared on DataFrames, planned by Spark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.encoding import prefix
from veilspark.sources.store import freeze

DUMMY = "is_dummy"
_OPS = {"<": Column.__lt__, "=": Column.__eq__, ">": Column.__gt__, ">=": Column.__ge__, "<=": Column.__le__, "<>": Column.__ne__}


@dataclass(frozen=True)
class Clause:
    """``field op value``. Texts are compared for equality only."""

    field: str
    op: str
    value: int | str


def predicate(df: DataFrame, *groups: Clause | Sequence[Clause]) -> Column:
    """All groups hold; a group given as a sequence holds if any of its clauses does. No group: true."""

    def one(c: Clause) -> Column:
        if c.op not in _OPS:
            raise ValueError(f"unknown operator {c.op}")
        kind = df.schema[c.field].dataType
        if isinstance(kind, T.StringType) and (c.op != "=" or not isinstance(c.value, str)):
            raise TypeError(f"{c.field} is text: only = with a text applies")
        if isinstance(kind, T.NumericType) and isinstance(c.value, str):
            raise TypeError(f"{c.field} is a number")
        return _OPS[c.op](F.col(f"`{c.field}`"), F.lit(c.value))

    terms = [one(g) if isinstance(g, Clause) else reduce(or_, map(one, g), F.lit(False)) for g in groups]
    if DUMMY in df.columns:
        terms.append(~F.col(DUMMY))  # a dummy row never satisfies a filter
    return reduce(and_, terms) if terms else F.lit(True)


def filter_rows(df: DataFrame, *groups: Clause | Sequence[Clause]) -> DataFrame:
    return df.where(predicate(df, *groups))


def project(df: DataFrame, columns: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The columns, in order; with a schema, types must be as it says."""
    out = df.select(*[f"`{c}`" for c in columns])
    if schema is not None:
        for have, want in zip(out.schema, schema, strict=True):
            if have.dataType != want.dataType:
                raise TypeError(f"{have.name} is {have.dataType.simpleString()}, not {want.dataType.simpleString()}")
    return out


def filter_project(df: DataFrame, groups: Sequence, columns: Sequence[str]) -> DataFrame:
    return project(filter_rows(df, *groups), columns)


def equi_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keep_right_key: bool = True, hint: str | None = None) -> DataFrame:
    """Left columns, then right ones, with or without the right key. Without a hint Spark picks the strategy."""
    clash = (set(left.columns) & set(right.columns)) - ({right_on} if not keep_right_key else set())
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    a, b = left.alias("l"), right.alias("r")
    joined = a.join(b.hint(hint) if hint else b, F.col(f"l.`{left_on}`") == F.col(f"r.`{right_on}`"))
    return joined.select(*[F.col(f"l.`{c}`") for c in left.columns], *[F.col(f"r.`{c}`") for c in right.columns if keep_right_key or c != right_on])


def pk_fk_join(primary: DataFrame, foreign: DataFrame, primary_key: str, foreign_key: str, duplicates: str = "raise", **how) -> DataFrame:
    """Each foreign row with its primary row. Repeated primary keys raise when the join runs (its own shuffle by the key
    counts them), or ``duplicates='join'`` joins all of them; 'unique' takes the caller's word for the key."""
    if duplicates == "raise":
        many = Window.partitionBy(f"`{primary_key}`")
        alone = F.when(F.count(F.lit(1)).over(many) == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{primary_key} is not unique")).cast("boolean"))
        primary = primary.where(F.col(f"`{primary_key}`").isNotNull()).withColumn("__alone", alone).where("__alone").drop("__alone")
    return equi_join(primary, foreign, primary_key, foreign_key, **how)


def aggregate(kind: str, column: str) -> Column:
    """SUM (64 bits), COUNT of rows, MIN, MAX, AVG (double) or INT_AVG (truncated towards zero)."""
    c = F.col(f"`{column}`")
    made = {"SUM": lambda: F.sum(c).cast("long"), "COUNT": lambda: F.count("*"), "MIN": lambda: F.min(c), "MAX": lambda: F.max(c), "AVG": lambda: F.avg(c), "INT_AVG": lambda: F.expr(f"sum(`{column}`) div count(*)").cast("long")}
    if kind not in made:
        raise ValueError(f"unknown aggregate {kind}")
    return made[kind]()


def group_by(df: DataFrame, key: str, aggregates: Sequence[tuple[str, str, str]], prefix_length: int | None = None, key_name: str | None = None) -> DataFrame:
    """Aggregates (kind, column, name), then the group's value; the key may be the first characters of a text."""
    name = key_name or key
    k = prefix(f"`{key}`", prefix_length) if prefix_length else F.col(f"`{key}`")
    return df.groupBy(k.alias(name)).agg(*[aggregate(kind, c).alias(n) for kind, c, n in aggregates]).select(*[n for _, _, n in aggregates], name)


def order_by(df: DataFrame, *columns: tuple[str, bool], limit: int | None = None) -> DataFrame:
    """By (column, ascending) pairs, all of them counting; with a limit, the first rows (add a tie-break)."""
    out = df.orderBy(*[F.asc(f"`{c}`") if up else F.desc(f"`{c}`") for c, up in columns])
    return out if limit is None else out.limit(limit)


def running_sum(df: DataFrame, by: str, value: str, name: str, kind: str = "sum") -> DataFrame:
    """``df`` with the running sum (or max) of ``value`` in order of ``by``, which is unique, and the one before each row
    as ``{name}_before`` (null for the first). Ranges are summed apart, then their totals, one row per range."""
    over = {"sum": F.sum, "max": F.max}[kind]
    part = freeze(df.repartitionByRange(F.asc(by)).withColumn("__p", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("__p").agg(over(value).alias("__t")).select("__p", over("__t").over(upto).alias("__b"))
    inside = Window.partitionBy("__p").orderBy(by)
    here = [over(value).over(inside.rowsBetween(Window.unboundedPreceding, e)) for e in (0, -1)]
    both = (lambda a, b: F.coalesce(a + b, a, b)) if kind == "sum" else F.greatest
    joined = part.withColumn("__i", here[0]).withColumn("__j", here[1]).join(F.broadcast(totals), "__p")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], both(F.col("__i"), F.col("__b")).alias(name), both(F.col("__j"), F.col("__b")).alias(f"{name}_before"))


def ranked(df: DataFrame, *columns: tuple[str, bool], name: str = "rank") -> DataFrame:
    """The position of each row in that order, without moving all rows to one task: rows of each range are numbered
    within it, as they are written, and offset by the number of rows in the ranges before (one count per range)."""
    keys = [F.asc(f"`{c}`") if up else F.desc(f"`{c}`") for c, up in columns]
    row = F.monotonically_increasing_id()
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.shiftright(row, 33)).withColumn("__i", row.bitwiseAND(F.lit((1 << 33) - 1)))
    part = freeze(part, "ranges")
    counts = part.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return part.join(F.broadcast(before), "__p").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__b") + F.col("__i") + 1).alias(name))  # one row per range


def is_sorted(df: DataFrame, *columns: tuple[str, bool], position: str) -> DataFrame:
    """One row, ``is_sorted``: no neighbours by ``position`` are out of order. For numbers; nulls count as equal."""
    block = df.withColumn("__b", F.floor(F.col(position) / 10000))

    def wrong(now: Column, last: Column) -> Column:
        out = F.lit(False)
        for c, up in reversed(columns):
            a, b = now[c], last[c]
            out = (a < b if up else a > b) | ((a == b) & out)
        return F.coalesce(out, F.lit(False))

    row = F.struct(*[F.col(f"`{c}`") for c, _ in columns])
    inside = block.select(wrong(row, F.lag(row).over(Window.partitionBy("__b").orderBy(position))).alias("w")).agg(F.max("w").alias("w"))
    # the last row of a block against the first one of the next: one row per block
    ends = block.where(F.col(position).isNotNull()).groupBy("__b").agg(F.min_by(row, position).alias("first"), F.max_by(row, position).alias("last"))
    between = ends.select(wrong(F.col("first"), F.lag("last").over(Window.orderBy("__b"))).alias("w")).agg(F.max("w").alias("w"))
    return inside.union(between).agg((~F.coalesce(F.max("w"), F.lit(False))).alias("is_sorted"))


def table_text(df: DataFrame, rows: int = 20) -> str:
    """The schema and the first real rows, as text for people."""
    real = df.where(~F.col(DUMMY)).drop(DUMMY) if DUMMY in df.columns else df
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in real.schema)
    return "\n".join([types, *("\t".join(map(str, r)) for r in real.limit(rows).collect())])

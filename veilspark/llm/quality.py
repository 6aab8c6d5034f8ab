"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Base statistics come from array functions over a text's words and lines. For each language and source the minimum
covariance determinant of the transformed statistics is estimated over all documents that pass the base rules: from
two starts (quartiles; a winsorised covariance) concentration steps keep the nearest ALPHA of the documents until no
determinant moves any more, the start of the smaller determinant wins, and one reweighting step follows. A document is rejected if its squared
Mahalanobis distance exceeds CUT. A group of fewer than LEAST such documents is judged by the estimate of all documents
of its language, and a language of fewer by that of the whole table, however small: every document is judged.

Every step is one scan of a small table of statistics with partial sums: distances are binned on a logarithmic scale,
and each bin has its count and moments, so finding the nearest ALPHA and their moments is one aggregation, whatever
the size of a group. Statistics are fixed-point numbers, so sums are exact and reruns agree.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import NOT_WORD, SEPARATORS, freeze

#: Fixed-point units; share of a group that an estimate rests on; documents that an estimate of a group or language needs.
UNIT, ALPHA, LEAST = 256, 0.75, 50
#: Concentration steps at most, and the change of a determinant's logarithm that counts (a tenth is one per cent of each
#: deviation; whole bins come and go, so smaller changes need not end).
STEPS, SETTLED = 8, 0.1
#: Consistency factor of ALPHA for five normal statistics (ALPHA over P(chi2 with 7 degrees <= 75 % quantile with 5)).
CONSISTENT = 1.41
#: Squared distances: of the reweighting step (97.5 % quantile of chi2 with 5 degrees), and beyond which a document goes
#: (the 1 - 5e-20 quantile: of any number of normal documents none; tails of texts' statistics are longer than normal).
REWEIGHT, CUT = 12.83, 100.0
#: Least standard deviation of each statistic, so that a constant one rejects nothing by itself.
FLOORS = (0.25, 0.05, 0.35, 0.35, 0.35)
#: Bins of a distance: so many to a factor e.
BINS = 16

#: The key of the whole table among those of groups and languages, which are hashes.
WHOLE = 0

P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
X = [f"x{i}" for i in range(P)]
M = [f"m{i}" for i in range(P)]
W = {(i, j): f"w{i}{j}" for i, j in PAIRS}


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as empty. Three-word windows are compared by a 64-bit hash of their words.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("__t", F.btrim(text, F.lit(SEPARATORS)))
    df = df.withColumn("__w", F.when(F.col("__t") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("__t", NOT_WORD)))
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != ""))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    df = df.withColumn("__h", F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2]))")).otherwise(F.expr("cast(array() as array<long>)")))
    df = df.withColumn("__same", F.size("__h") > F.size(F.array_distinct("__h")))
    # only texts with a repeated window are sorted: neighbours of equal hash give the places that repeat
    ordered = "sort_array(transform(__h, (h, i) -> struct(h, i)))"
    df = df.withColumn("__s", F.when(F.col("__same"), F.expr(ordered)))
    places = "sort_array(array_distinct(flatten(zip_with(slice(__s, 1, size(__s) - 1), slice(__s, 2, size(__s) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))))"
    df = df.withColumn("__p", F.when(F.col("__same"), F.expr(places)))
    covered = "aggregate(zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p) - 1), (a, b) -> least(3, b - a)), 3, (s, d) -> s + d)"
    df = df.withColumn("n_repeat_words", F.when(F.col("__same"), F.expr(covered)).otherwise(0).cast("long"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # a generator of one row: filters on the statistics stay above it, else they would repeat the nested expressions
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*names))))


def _vector(df: DataFrame) -> DataFrame:
    """Fixed-point statistics x0..x4 and the keys of the group and of its language."""
    n = F.greatest("n_words", F.lit(1))
    parts = [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_repeat_words") / n), F.log1p("n_dup_lines")]
    g = F.xxhash64("lang", F.isnull("lang"), "source", F.isnull("source"))
    pool = F.xxhash64("lang", F.isnull("lang"))
    return df.select("*", g.alias("g"), pool.alias("l"), *[F.round(x * UNIT).cast("long").alias(c) for c, x in zip(X, parts, strict=True)])


def _square():
    d = [F.col(x) / UNIT - F.col(m) for x, m in zip(X, M, strict=True)]
    return reduce(add, [F.pow(reduce(add, [F.col(W[i, j]) * d[j] for j in range(i + 1)]), 2) for i in range(P)])


def _moments() -> list:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}{j}") for i, j in PAIRS]]


_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"p{i}{j}" for i, j in PAIRS]]


def _estimate(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and inverse Cholesky factor of the covariance from moments, with the logarithm of the determinant."""
    df = moments.select(*keys, "n", *[(F.col(f"s{i}") / F.col("n") / UNIT).alias(M[i]) for i in range(P)], *[(F.col(f"p{i}{j}") / F.col("n") / UNIT**2).alias(f"p{i}{j}") for i, j in PAIRS])
    cov = {(i, j): F.greatest(F.lit(factor) * (F.col(f"p{i}{j}") - F.col(M[i]) * F.col(M[j])), F.lit(FLOORS[i] ** 2)) if i == j else F.lit(factor) * (F.col(f"p{i}{j}") - F.col(M[i]) * F.col(M[j])) for i, j in PAIRS}
    df = df.select(*keys, "n", *M, *[c.alias(f"c{i}{j}") for (i, j), c in cov.items()])
    for j in range(P):  # columns of the Cholesky factor
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - reduce(add, [F.pow(f"l{j}{k}", F.lit(2)) for k in range(j)], F.lit(0.0)), F.lit(FLOORS[j] ** 2))))
        for i in range(j + 1, P):
            df = df.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - reduce(add, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))) / F.col(f"l{j}{j}"))
    for i in range(P):  # and of its inverse
        df = df.withColumn(W[i, i], 1 / F.col(f"l{i}{i}"))
        for j in range(i):
            df = df.withColumn(W[i, j], -reduce(add, [F.col(f"l{i}{k}") * F.col(W[k, j]) for k in range(j, i)]) / F.col(f"l{i}{i}"))
    logdet = 2 * reduce(add, [F.log(f"l{i}{i}") for i in range(P)])
    return df.select(*keys, *M, *W.values(), logdet.alias("logdet"))


def _quartiles(rows: DataFrame) -> DataFrame:
    """Per group the quartiles of each statistic, from counts of its fixed-point values."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("v")) for i, x in enumerate(X)])).alias("e")).select("g", "e.i", "e.v")
    counts = long.groupBy("g", "i", "v").agg(F.count("*").alias("c"))
    part = Window.partitionBy("g", "i")
    run = counts.withColumn("upto", F.sum("c").over(part.orderBy("v"))).withColumn("all", F.sum("c").over(part))
    cuts = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    each = run.groupBy("g", "i").agg(*cuts, F.first("all").alias("n"))
    return each.groupBy("g").agg(F.first("n").alias("n"), *[F.first(F.when(F.col("i") == i, F.col(f"q{k}")), ignorenulls=True).alias(f"q{k}_{i}") for i in range(P) for k in range(3)])


def _starts(rows: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Two estimates (g, s, ...): the quartiles' diagonal one, and that of statistics clipped at two deviations."""
    sd = [F.greatest((F.col(f"q2_{i}") - F.col(f"q0_{i}")) / UNIT / 1.349, F.lit(f)) for i, f in enumerate(FLOORS)]
    flat = quartiles.select("g", F.lit(0).alias("s"), *[(F.col(f"q1_{i}") / UNIT).alias(M[i]) for i in range(P)], *[(1 / sd[i] if i == j else F.lit(0.0)).alias(W[i, j]) for i, j in PAIRS], (2 * reduce(add, [F.log(x) for x in sd])).alias("logdet"))
    clip = lambda i: F.greatest(F.least(F.col(X[i]), F.col(f"q1_{i}") + F.round(2 * UNIT * sd[i]).cast("long")), F.col(f"q1_{i}") - F.round(2 * UNIT * sd[i]).cast("long"))
    clipped = rows.join(quartiles, "g").select("g", *[clip(i).alias(X[i]) for i in range(P)])
    wins = _estimate(clipped.groupBy("g").agg(*_moments()).withColumn("s", F.lit(1)), ["g", "s"], 1.0)
    return flat.unionByName(wins)


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate from the ALPHA of each group's documents that are nearest by the estimate given."""
    near = rows.join(estimate, "g").withColumn("bin", F.floor(F.log(_square() + 1e-6) * BINS))
    bins = near.groupBy("g", "s", "bin").agg(*_moments())
    part = Window.partitionBy("g", "s")
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(part))
    kept = bins.where(F.col("before") < ALPHA * F.col("all")).groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return _estimate(kept, ["g", "s"], CONSISTENT)


def group_estimates(rows: DataFrame) -> DataFrame:
    """(g, m*, w*, logdet) for each group of ``rows(g, x0..x4)``."""
    quartiles = freeze(_quartiles(rows), "quality-quartiles")
    estimate = freeze(_starts(rows, quartiles), "quality-start")
    for _ in range(STEPS):
        last, estimate = estimate, freeze(_concentrate(rows, estimate), "quality-step")
        moved = estimate.join(last.select("g", "s", F.col("logdet").alias("was")), ["g", "s"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        if moved is None or moved < SETTLED:
            break
    best = estimate.groupBy("g").agg(F.min_by(F.struct("s", *M, *W.values()), F.struct("logdet", "s")).alias("e")).select("g", "e.*")
    weighed = rows.join(best, "g").where(_square() <= REWEIGHT).groupBy("g").agg(*_moments())
    return freeze(_estimate(weighed, ["g"], 1.0), "quality-final")


def _judges(rows: DataFrame) -> DataFrame:
    """(g, by) for each group of ``rows(g, l)``: the key of the estimate that judges it."""
    sizes = rows.groupBy("g", "l").agg(F.count("*").alias("n"))
    pools = sizes.groupBy("l").agg(F.sum("n").alias("of_l"))
    by = F.when(F.col("n") >= LEAST, F.col("g")).when(F.col("of_l") >= LEAST, F.col("l")).otherwise(F.lit(WHOLE).cast("long"))
    return sizes.join(pools, "l").select("g", by.alias("by"))


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang, source)``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and distance2 (null where the base rules reject the document).

    A null language or source is a value of its own. A group of fewer than LEAST passing documents is judged by its
    language's estimate, or by the whole table's. Rows repeating a doc_id each give a row.
    """
    base = base_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")).drop("text")
    table = freeze(_vector(base).drop("lang", "source"), "quality")
    passing = table.where(~F.col("base_failed"))
    judges = freeze(_judges(passing), "quality-judges")
    # a document counts in the estimates of its group, its language and the whole table, of which those are made that judge
    levels = passing.select(F.explode(F.array("g", "l", F.lit(WHOLE).cast("long"))).alias("by"), *X).join(judges.select("by").distinct(), "by", "left_semi")
    estimates = group_estimates(freeze(levels.withColumnRenamed("by", "g"), "quality-levels")).drop("logdet").withColumnRenamed("g", "by")
    judged = table.join(judges.join(estimates, "by"), "g", "left").withColumn("distance2", F.when(~F.col("base_failed"), _square()))
    kept = ~F.col("base_failed") & (F.col("distance2") <= CUT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")

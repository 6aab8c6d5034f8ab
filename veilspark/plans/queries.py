"""The registered queries of the relational and padding operators, each with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.encoding import cents, date_int, decrypt_rows, encrypt_rows, keep_key, prefix, session_key
from veilspark.operators import private as P
from veilspark.operators import relational as R
from veilspark.operators.relational import Clause
from veilspark.sources.store import new_path
from veilspark.sources.tables import RANKINGS_VIEW, USERVISITS_VIEW, rankings, read_rankings, read_uservisits, uservisits, visit_ip, visit_url

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_WITH = f"WITH rankings AS ({RANKINGS_VIEW}), uservisits AS ({USERVISITS_VIEW}) "
_VISIT = ["destURL", "sourceIP", "visitDate", "adRevenue"]


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, _WITH + sql
        return f

    return add


for _name, _op in {"lt": "<", "eq": "=", "gt": ">", "ge": ">=", "le": "<=", "ne": "<>"}.items():
    QUERIES[f"filter_{_name}"] = lambda s, d, op=_op: R.filter_rows(rankings(s, d), Clause("pageRank", op, 1000))
    ORACLE_SQL[f"filter_{_name}"] = _WITH + f"SELECT * FROM rankings WHERE pageRank {_op} 1000"


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_text_eq(s, d):
    return R.filter_rows(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment"), Clause("c_mktsegment", "=", "BUILDING"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_char_eq(s, d):
    return R.filter_rows(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus"), Clause("o_orderstatus", "=", "F"))


@query("SELECT * FROM uservisits WHERE visitDate > 19960101 AND visitDate < 19990101")
def filter_and_range(s, d):
    return R.filter_rows(uservisits(s, d), Clause("visitDate", ">", 19960101), Clause("visitDate", "<", 19990101))


@query("SELECT * FROM rankings WHERE (pageRank > 2000 OR avgDuration = 7) AND pageRank <> 2500")
def filter_cnf(s, d):
    return R.filter_rows(rankings(s, d), [Clause("pageRank", ">", 2000), Clause("avgDuration", "=", 7)], Clause("pageRank", "<>", 2500))


@query("SELECT pageURL, avgDuration FROM rankings")
def project_columns(s, d):
    return R.project(rankings(s, d), ["pageURL", "avgDuration"])


@query("SELECT pageURL, pageRank FROM rankings WHERE pageRank > 1000")
def bdb_q1(s, d):
    return R.filter_project(rankings(s, d), [Clause("pageRank", ">", 1000)], ["pageURL", "pageRank"])


#: Draws of a seeded run as SQL: a uniform number by SHA-256 of seed, key and salt; the noise of the prefix of k batches.
_DRAW = "((cast('0x' || substr(sha256(concat_ws(':', {seed}, {key}, {salt})), 1, 13) as bigint) + 0.5) / 4503599627370496)"
_NOISE = (
    "(SELECT coalesce(sum(CASE WHEN " + _DRAW.format(seed="{seed}", key="i, {k} >> i", salt=1) + " < 0.5 THEN 1 ELSE -1 END * ln(" + _DRAW.format(seed="{seed}", key="i, {k} >> i", salt=2) + ")), 0)"
    " * {levels} / {epsilon} FROM range(0, 40) t(i) WHERE i < {levels} AND ({k} >> i) & 1 = 1)"
)


def _levels(batches: str) -> str:
    return f"length(bin({batches}))"


def _padded_sql(count: str, inputs: str, batch: int, epsilon: float, seed: int) -> str:
    """Rows that a privately padded result has when written."""
    batches = f"(SELECT greatest(1, cast(ceil({inputs} / {batch}.0) as bigint)) FROM i)"
    noise = _NOISE.format(seed=seed, k=batches, levels=_levels(batches), epsilon=epsilon)
    return f"greatest({count}, cast(floor({count} + {noise}) as bigint) + {batch})"


@query("SELECT pageURL, pageRank FROM rankings WHERE pageRank > 1000")
def padded_filter_project_reveal(s, d):
    return P.padded_filter_project(rankings(s, d), F.col("pageRank") > 1000, ["pageURL", "pageRank"], seed=1).store().reveal()


@query("SELECT * FROM rankings WHERE pageRank > 1000")
def padded_filter_reveal(s, d):
    return P.padded_filter(rankings(s, d), F.col("pageRank") > 1000, seed=1).store().reveal()


@query("SELECT pageURL, pageRank FROM rankings")
def padded_project_reveal(s, d):
    return P.padded_project(rankings(s, d), ["pageURL", "pageRank"], seed=1).store().reveal()


@query("SELECT pageURL, pageRank FROM rankings WHERE pageRank > 1000")
def full_padded_filter_project_reveal(s, d):
    return P.full_padded_filter_project(rankings(s, d), F.col("pageRank") > 1000, ["pageURL", "pageRank"]).store().reveal()


@query("SELECT pageURL, pageRank FROM rankings WHERE pageRank > 1000")
def padded_encrypted_reveal(s, d):
    """Rows and dummies as blobs of one length, read back."""
    name = keep_key(s, session_key())
    return P.padded_filter_project(rankings(s, d), F.col("pageRank") > 1000, ["pageURL", "pageRank"], seed=1).store(key=name).reveal()


@query("SELECT 1 AS lengths, (SELECT count(*) FROM rankings) AS size, (SELECT count(*) FROM rankings) AS different")
def padded_encrypted_lengths(s, d):
    """Blobs tell nothing by their length, their number or by being equal."""
    name = keep_key(s, session_key())
    stored = P.full_padded_filter_project(rankings(s, d), F.col("pageRank") > 1000, ["pageURL", "pageRank"]).store(key=name)
    return stored.table.agg(F.count_distinct(F.octet_length("blob")).alias("lengths"), F.count("*").alias("size"), F.count_distinct("blob").alias("different"))


@query("SELECT count(*) AS size FROM rankings")
def full_padded_size(s, d):
    return P.full_padded_filter_project(rankings(s, d), F.col("pageRank") > 1000, ["pageURL"]).store().table.agg(F.count("*").alias("size"))


_SIZES = f"""SELECT * FROM (WITH i AS (SELECT count(*) AS n FROM rankings), f AS (SELECT count(*) AS n FROM rankings WHERE pageRank > 1000),
  g AS (SELECT count(DISTINCT substr(sourceIP, 1, 8)) AS n FROM uservisits), v AS (SELECT count(*) AS n FROM uservisits)
SELECT 'filter_project' AS operator, f.n AS real_rows, {_padded_sql("f.n", "n", 1024, 1.02, 3)} AS written FROM f
UNION ALL SELECT 'filter', f.n, {_padded_sql("f.n", "n", 65536, 1.0, 4)} FROM f
UNION ALL SELECT 'project', i.n, {_padded_sql("i.n", "n", 65536, 1.0, 5)} FROM i
UNION ALL SELECT 'sort_group_by', g.n, {_padded_sql("g.n", "n", 1024, 1.0, 6).replace("FROM i)", "FROM v)")} FROM g
UNION ALL SELECT 'join', v.n, {_padded_sql("v.n", "(n + (SELECT n FROM v))", 8192, 1.02, 7)} FROM v)"""


@query(_SIZES)
def padded_sizes(s, d):
    """For each private operator the rows that are real and those that are written, read from what is written."""
    r, v = rankings(s, d), uservisits(s, d)
    joined = R.pk_fk_join(r, v, "pageURL", "destURL")
    frames = {
        "filter_project": P.padded_filter_project(r, F.col("pageRank") > 1000, ["pageURL"], seed=3),
        "filter": P.padded_filter(r, F.col("pageRank") > 1000, seed=4),
        "project": P.padded_project(r, ["pageURL"], seed=5),
        "sort_group_by": P.padded_sort_group_by(v, prefix("sourceIP", 8), "prefix", "adRevenue", seed=6),
        "join": P.padded_join(joined, r.count() + v.count(), seed=7),
    }
    sizes = [f.store().table.agg(F.lit(k).alias("operator"), F.count_if(~F.col("is_dummy")).alias("real_rows"), F.count("*").alias("written")) for k, f in frames.items()]
    return reduce(DataFrame.union, sizes)


_LEDGER = f"""SELECT * FROM (WITH i AS (SELECT count(*) AS n FROM rankings), f AS (SELECT count(*) AS n FROM rankings WHERE pageRank > 1000), v AS (SELECT count(*) AS n FROM uservisits),
  j AS (SELECT count(*) AS n FROM rankings JOIN uservisits ON pageURL = destURL WHERE pageRank > 1000)
SELECT cast(2.04 AS double) AS epsilon, cast((SELECT {_padded_sql("f.n", "n", 1024, 1.02, 8)} - f.n FROM f)
  + (SELECT {_padded_sql("j.n", "((SELECT n FROM f) + (SELECT n FROM v))", 8192, 1.02, 9)} - j.n FROM j) AS bigint) AS dummies)"""


@query(_LEDGER)
def padded_query_ledger(s, d):
    """What a filter and a join on its result spend together: epsilon, and dummy rows written."""
    ledger, v = P.Ledger(), uservisits(s, d)
    some = P.padded_filter_project(rankings(s, d), F.col("pageRank") > 1000, ["pageURL", "pageRank"], seed=8, ledger=ledger).store().reveal()
    P.padded_join(R.pk_fk_join(some, v, "pageURL", "destURL"), some.count() + v.count(), seed=9, ledger=ledger).store()
    return s.range(1).select(F.lit(ledger.epsilon).alias("epsilon"), F.lit(ledger.dummies).cast("long").alias("dummies"))


def _by_duration(kind: str, sql: str) -> None:
    name = f"agg_{kind.lower()}" if kind != "INT_AVG" else "agg_avg_int"
    QUERIES[name] = lambda s, d: R.group_by(uservisits(s, d), "duration", [(kind, "adRevenue", "value")])
    ORACLE_SQL[name] = _WITH + f"SELECT {sql} AS value, duration FROM uservisits GROUP BY duration"


_by_duration("SUM", "cast(sum(adRevenue) as bigint)")
_by_duration("MIN", "min(adRevenue)")
_by_duration("MAX", "max(adRevenue)")
_by_duration("COUNT", "count(*)")
_by_duration("AVG", "avg(adRevenue)")
_by_duration("INT_AVG", "cast(sum(adRevenue) // count(*) as bigint)")

_Q2 = "SELECT cast(sum(adRevenue) as bigint) AS sum_revenue, cast(sum(duration) // count(*) as bigint) AS avg_duration, substr(sourceIP, 1, {k}) AS prefix FROM uservisits GROUP BY substr(sourceIP, 1, {k})"


def _q2(s, d, k):
    return R.group_by(uservisits(s, d), "sourceIP", [("SUM", "adRevenue", "sum_revenue"), ("INT_AVG", "duration", "avg_duration")], k, "prefix")


@query(_Q2.format(k=8))
def bdb_q2_sort(s, d):
    return _q2(s, d, 8)


@query(_Q2.format(k=16))
def bdb_q2_hash(s, d):
    return _q2(s, d, 16)


@query(_Q2.format(k=8))
def padded_groupby_reveal(s, d):
    return P.padded_hash_group_by(_q2(s, d, 8), "prefix", seed=1).store().reveal()


@query("SELECT (count(DISTINCT substr(sourceIP, 1, 8)) // 20000 + 1) AS passes, count(DISTINCT substr(sourceIP, 1, 8)) AS real_rows, (count(DISTINCT substr(sourceIP, 1, 8)) // 20000 + 1) * 20000 AS written FROM uservisits")
def padded_groupby_passes(s, d):
    """Passes by the number of groups, each of one size; the sketch holds all hashes, so the number is exact."""
    f = P.padded_hash_group_by(_q2(s, d, 8), "prefix", capacity=20_000, t=1_000_000, noise=False)
    written = f.store().table.agg(F.count_if(~F.col("is_dummy")).alias("real_rows"), F.count("*").alias("written"))
    return written.crossJoin(f.passes.agg(F.count("*").alias("passes"))).select("passes", "real_rows", "written")  # one row each


@query("SELECT cast(sum(adRevenue) as bigint) AS sum_adRevenue, substr(sourceIP, 1, 8) AS prefix FROM uservisits GROUP BY substr(sourceIP, 1, 8)")
def padded_sort_groupby_reveal(s, d):
    return P.padded_sort_group_by(uservisits(s, d), prefix("sourceIP", 8), "prefix", "adRevenue", seed=1).store().reveal()


@query("""SELECT * FROM (WITH g AS (SELECT substr(sourceIP, 1, 8) AS k, count(*) AS n FROM uservisits GROUP BY k),
  e AS (SELECT (sum(n) OVER (ORDER BY k) - 1) // 1024 AS b FROM g), c AS (SELECT b, count(*) AS n FROM e GROUP BY b),
  a AS (SELECT range AS batch_id, coalesce(n, 0) AS n FROM range(0, (SELECT cast(ceil(count(*) / 1024.0) as bigint) FROM uservisits)) LEFT JOIN c ON b = range),
  w AS (SELECT batch_id, greatest(0, max(sum_n - 1024) OVER (ORDER BY batch_id)) AS out FROM (SELECT batch_id, sum(n) OVER (ORDER BY batch_id) AS sum_n FROM a))
SELECT batch_id, cast(out - coalesce(lag(out) OVER (ORDER BY batch_id), 0) as bigint) AS release FROM w)""")
def sort_groupby_schedule(s, d):
    """Groups given out after each batch of a scan in key order, without noise."""
    return P.padded_sort_group_by(uservisits(s, d), prefix("sourceIP", 8), "prefix", "adRevenue", epsilon=float("inf"), seed=1).schedule


@query("SELECT *  FROM rankings JOIN uservisits ON pageURL = destURL")
def join_pkfk_keep_key(s, d):
    return R.pk_fk_join(rankings(s, d), uservisits(s, d), "pageURL", "destURL")


@query("SELECT rankings.*, sourceIP, visitDate, adRevenue, duration FROM rankings JOIN uservisits ON pageURL = destURL")
def join_hash_drop_key(s, d):
    return R.equi_join(rankings(s, d), uservisits(s, d), "pageURL", "destURL", keep_right_key=False, hint="shuffle_hash")


@query("SELECT * FROM rankings JOIN uservisits ON pageURL = destURL")
def join_sort_merge(s, d):
    return R.equi_join(rankings(s, d), uservisits(s, d), "pageURL", "destURL", hint="merge")


@query("SELECT * FROM rankings JOIN uservisits ON pageURL = destURL")
def padded_join_reveal(s, d):
    r, visits = rankings(s, d), uservisits(s, d)
    return P.padded_join(R.pk_fk_join(r, visits, "pageURL", "destURL"), r.count() + visits.count(), seed=1).store().reveal()


@query("SELECT count(*) AS real_rows, greatest((SELECT count(*) FROM rankings) * (SELECT count(*) FROM uservisits) // 50000, 100 * (SELECT count(*) FROM rankings)) AS written FROM rankings JOIN uservisits ON pageURL = destURL")
def join_worst_case_size(s, d):
    """A join's result padded to a bound that both inputs' sizes give."""
    r, v = rankings(s, d), uservisits(s, d)
    joined = R.equi_join(r, v, "pageURL", "destURL", keep_right_key=False)
    stored = P.pad_full(joined, P.join_bound(r.count(), v.count())).store()
    return stored.table.agg(F.count_if(~F.col("is_dummy")).alias("real_rows"), F.count("*").alias("written"))


@query("SELECT rankings.*, destURL, sourceIP, visitDate, adRevenue FROM rankings JOIN uservisits ON pageURL = destURL WHERE visitDate > 19960101 AND visitDate < 19990101")
def join_filtered_pkfk(s, d):
    visits = R.filter_project(uservisits(s, d), [Clause("visitDate", ">", 19960101), Clause("visitDate", "<", 19990101)], _VISIT)
    return R.pk_fk_join(rankings(s, d), visits, "pageURL", "destURL")


@query("SELECT cast(sum(pageRank) // count(*) as bigint) AS avg_rank, cast(sum(adRevenue) as bigint) AS sum_revenue, substr(sourceIP, 1, 8) AS prefix FROM rankings JOIN uservisits ON pageURL = destURL WHERE visitDate > 19960101 AND visitDate < 19990101 GROUP BY substr(sourceIP, 1, 8) ORDER BY sum_revenue DESC, prefix LIMIT 1")
def bdb_q3(s, d):
    visits = R.filter_project(uservisits(s, d), [Clause("visitDate", ">", 19960101), Clause("visitDate", "<", 19990101)], _VISIT)
    joined = R.equi_join(rankings(s, d), visits, "pageURL", "destURL", keep_right_key=False)
    grouped = R.group_by(joined, "sourceIP", [("INT_AVG", "pageRank", "avg_rank"), ("SUM", "adRevenue", "sum_revenue")], 8, "prefix")
    return R.order_by(grouped, ("sum_revenue", False), ("prefix", True), limit=1)


@query("SELECT pageURL, pageRank, row_number() OVER (ORDER BY pageRank, pageURL) AS rank FROM rankings")
def orderby_asc_ranked(s, d):
    return R.ranked(rankings(s, d).select("pageURL", "pageRank"), ("pageRank", True), ("pageURL", True))


@query("SELECT pageURL, pageRank, row_number() OVER (ORDER BY pageRank DESC, pageURL) AS rank FROM rankings")
def orderby_desc_ranked(s, d):
    return R.ranked(rankings(s, d).select("pageURL", "pageRank"), ("pageRank", False), ("pageURL", True))


@query("SELECT pageURL, pageRank FROM rankings ORDER BY pageRank DESC, pageURL LIMIT 25")
def topk(s, d):
    return R.order_by(rankings(s, d).select("pageURL", "pageRank"), ("pageRank", False), ("pageURL", True), limit=25)


_SORTED = "SELECT '{name}' AS by, coalesce(max(CASE WHEN {wrong} THEN 1 ELSE 0 END), 0) = 0 AS is_sorted FROM (SELECT *, lag(v) OVER (ORDER BY p) AS last FROM ({rows}))"


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        _SORTED.format(name=n, wrong=w, rows=r)
        for n, w, r in (
            ("rank", "v > last", "SELECT pageRank AS v, row_number() OVER (ORDER BY pageRank DESC, pageURL) AS p FROM rankings"),
            ("rank ascending", "v < last", "SELECT pageRank AS v, row_number() OVER (ORDER BY pageRank DESC, pageURL) AS p FROM rankings"),
            ("order key", "v > last", "SELECT cast(floor(o_totalprice) as bigint) AS v, o_orderkey AS p FROM orders"),
            ("one edge", "v > last", "SELECT CASE WHEN o_orderkey < 10000 THEN -o_orderkey ELSE 60000 - o_orderkey END AS v, o_orderkey AS p FROM orders"),
        )
    )
    + ")"
)
def sort_check(s, d):
    """Sorted rows, and rows that are out of order everywhere or at one place, the edge of two blocks."""
    r = R.ranked(rankings(s, d).select("pageURL", "pageRank"), ("pageRank", False), ("pageURL", True))
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").alias("v"))
    edge = o.withColumn("v", F.when(F.col("o_orderkey") < 10_000, -F.col("o_orderkey")).otherwise(60_000 - F.col("o_orderkey")))
    found = {
        "rank": R.is_sorted(r, ("pageRank", False), ("pageURL", True), position="rank"),
        "rank ascending": R.is_sorted(r, ("pageRank", True), position="rank"),
        "order key": R.is_sorted(o, ("v", False), position="o_orderkey"),
        "one edge": R.is_sorted(edge, ("v", False), position="o_orderkey"),
    }
    return reduce(DataFrame.union, [f.select(F.lit(n).alias("by"), "is_sorted") for n, f in found.items()])


_KMV = "SELECT CASE WHEN count(*) < {t} THEN cast(count(*) as double) ELSE 1.075 * {t} / ((max(h) + 1) / 281474976710656.0) END AS estimate FROM (SELECT DISTINCT cast('0x' || substr(sha256(pageURL), 1, 12) as bigint) AS h FROM rankings ORDER BY h LIMIT {t})"


@query(_KMV.format(t=1000))
def ndv_kmv(s, d):
    return s.range(1).select(F.lit(P.distinct_count_kmv(rankings(s, d), "pageURL", t=1000, epsilon_noise=False)).alias("estimate"))


@query("SELECT count(DISTINCT pageURL) AS exact, cast(1 AS double) AS ratio FROM rankings")
def ndv_hll(s, d):
    """The sketch's estimate over the exact number, to a tenth."""
    r = rankings(s, d)
    exact = r.agg(F.count_distinct("pageURL").alias("exact"))
    return exact.select("exact", F.round(F.lit(float(P.distinct_count_hll(r, "pageURL"))) / F.col("exact"), 1).alias("ratio"))


_BATCHES = "SELECT o_orderkey // 1024 AS batch_id, sum(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)) OVER (ORDER BY o_orderkey // 1024) AS prefix FROM orders GROUP BY o_orderkey // 1024"


def _counts(s, d):
    return P.batch_counts(s.read.parquet(f"{d}/orders.parquet"), F.col("o_totalprice") > 100000, 1024, "o_orderkey")


@query(f"SELECT cast(batch_id as bigint) AS batch_id, cast(prefix as bigint) AS prefix FROM ({_BATCHES})")
def dp_prefix_true_counts(s, d):
    return P.prefix_sums(_counts(s, d), 1.02, seed=1).select("batch_id", "prefix")


_NOISY = f"SELECT batch_id, prefix, prefix + {_NOISE.format(seed=1, k='(batch_id + 1)', levels=_levels('(SELECT max(batch_id) + 1 FROM b)'), epsilon=1.02)} AS noisy FROM b"


@query(f"SELECT cast(batch_id as bigint) AS batch_id, round(noisy, 6) AS noisy FROM (WITH b AS ({_BATCHES}) {_NOISY})")
def dp_prefix_noisy(s, d):
    return P.prefix_sums(_counts(s, d), 1.02, seed=1).select("batch_id", F.round("noisy", 6).alias("noisy"))


@query(
    f"SELECT * FROM (WITH b AS ({_BATCHES}), n AS ({_NOISY}), w AS (SELECT batch_id, max(greatest(least(floor(noisy) - 1024, prefix), 0)) OVER (ORDER BY batch_id) AS out FROM n) "
    "SELECT cast(batch_id as bigint) AS batch_id, cast(out - coalesce(lag(out) OVER (ORDER BY batch_id), 0) as bigint) AS release FROM w)"
)
def dp_release_schedule(s, d):
    """What a private filter gives out after each batch."""
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    return P.padded_filter(orders, F.col("o_totalprice") > 100000, batch=1024, epsilon=1.02, seed=1, order="o_orderkey").schedule


@query("SELECT * FROM rankings")
def csv_rankings(s, d):
    path = new_path(s, "rankings-csv")
    rankings(s, d).write.csv(path)
    return read_rankings(s, path)


@query(
    "SELECT destURL, sourceIP, cast(year(l_shipdate)*10000+month(l_shipdate)*100+day(l_shipdate) as int) AS visitDate, cast(trunc(l_extendedprice*100) as int) AS adRevenue, 'agent' AS userAgent, 'DEU' AS countryCode, 'de' AS languageCode, 'word' AS searchWord, duration"
    f" FROM (SELECT *, {USERVISITS_VIEW.removeprefix('select ')})"
)
def csv_uservisits(s, d):
    path, line = new_path(s, "uservisits-csv"), s.read.parquet(f"{d}/lineitem.parquet")
    words = [F.lit(x) for x in ("agent", "DEU", "de", "word")]
    line.select(visit_ip(), visit_url(), F.date_format("l_shipdate", "yyyy-MM-dd"), "l_extendedprice", *words, F.floor("l_quantity").cast("int")).write.csv(path)
    return read_uservisits(s, path)


@query("SELECT pageURL, pageRank, avgDuration FROM rankings")
def encrypt_roundtrip(s, d):
    r, key = rankings(s, d), keep_key(s, session_key())
    return decrypt_rows(encrypt_rows(r, key), key, r.schema)


@query("SELECT event_id, ts, user_id, value, props FROM events")
def encrypt_roundtrip_events(s, d):
    """Timestamps to the microsecond, doubles and nested text."""
    e, key = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "user_id", "value", "props"), keep_key(s, session_key())
    return decrypt_rows(encrypt_rows(e, key, equal_length=True), key, e.schema)


@query("SELECT l_orderkey, l_linenumber, cast(year(l_shipdate)*10000+month(l_shipdate)*100+day(l_shipdate) as int) AS visitDate FROM lineitem")
def date_int_encode(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", date_int("l_shipdate").alias("visitDate"))


@query("SELECT l_orderkey, l_linenumber, cast(floor(l_extendedprice*100) as int) AS cents FROM lineitem")
def cents_encode(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("cents"))

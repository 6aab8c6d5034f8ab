import datetime
import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.functions.encoding import decrypt_rows, encrypt_rows, interval, interval_bounds, keep_key, next_power_of_two, previous_power_of_two
from veilspark.operators import private as P
from veilspark.operators import relational as R
from veilspark.operators.relational import Clause
from veilspark.plans.queries import ORACLE_SQL, QUERIES
from veilspark.sources.tables import Catalog, read_rankings, read_uservisits

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    order = [[c[0] for c in sql.description].index(c) for c in df.columns]
    near = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(near, map(tuple, df.collect())), key=repr) == sorted((near([r[i] for i in order]) for r in sql.fetchall()), key=repr)


@pytest.fixture(scope="module")
def mini(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mini")
    (d / "r.csv").write_text("u1,1500,10\nu2,1000,20\nu3,1001,30\nu4,5,40\nu5,2000,50\n")
    visits = ["10.0.0.1,u1,1981-05-01,1.50,7", "10.0.0.1,u2,1980-01-01,9.99,3", "10.0.0.12,u3,1982-12-31,0.25,4", "10.0.0.2,u1,1983-01-01,4.00,1", "10.0.0.2,u5,1981-01-02,2.25,8", "9.9.9.9,u3,1981-07-07,3.00,5", "9.9.9.9,u9,1981-07-07,8.00,6", "1.1,u4,1982-02-02,0.10,2"]
    (d / "v.csv").write_text("".join(f"{a},{b},{c},{e},x,y,z,w,{f}\n" for a, b, c, e, f in (v.split(",") for v in visits)))
    return read_rankings(spark, str(d / "r.csv")), read_uservisits(spark, str(d / "v.csv"))


def test_mini_answers(mini):
    r, v = mini
    assert rows(R.filter_project(r, [Clause("pageRank", ">", 1000)], ["pageURL", "pageRank"])) == [("u1", 1500), ("u3", 1001), ("u5", 2000)]
    aggs = [("SUM", "adRevenue", "s"), ("INT_AVG", "duration", "a"), ("COUNT", "duration", "n")]
    assert rows(R.group_by(v, "sourceIP", aggs, 8, "k")) == sorted([(10, 2, 1, "1.1"), (1174, 4, 3, "10.0.0.1"), (625, 4, 2, "10.0.0.2"), (1100, 5, 2, "9.9.9.9")], key=repr)
    assert R.pk_fk_join(r, v, "pageURL", "destURL").count() == 7
    inside = R.filter_rows(v, Clause("visitDate", ">", 19800101), Clause("visitDate", "<", 19830101))
    q3 = R.group_by(R.equi_join(r, inside, "pageURL", "destURL", keep_right_key=False), "sourceIP", [("INT_AVG", "pageRank", "a"), ("SUM", "adRevenue", "s")], 8, "k")
    assert [tuple(x) for x in R.order_by(q3, ("s", False), ("k", True)).collect()] == [(1001, 300, "9.9.9.9"), (2000, 225, "10.0.0.2"), (1250, 175, "10.0.0.1"), (5, 10, "1.1")]


def test_rules(spark, mini):
    r, _ = mini
    with pytest.raises(TypeError):
        R.filter_rows(r, Clause("pageURL", "<", "u2"))
    with pytest.raises(Exception, match="pageURL is not unique"):
        R.pk_fk_join(r.union(r), r.toDF("a", "b", "c"), "pageURL", "a").collect()
    nulls = r.union(spark.createDataFrame([(None, 1, 1)] * 2, r.schema))
    assert R.pk_fk_join(nulls, r.toDF("a", "b", "c"), "pageURL", "a").count() == 5
    with pytest.raises(ValueError):
        R.equi_join(r, r, "pageURL", "pageURL")
    neg = spark.createDataFrame([(1, -7), (1, 0)], "k int, x int")
    assert R.group_by(neg, "k", [("INT_AVG", "x", "a")]).first()["a"] == -3
    big = spark.createDataFrame([(1, 2**31 - 1)] * 3, "k int, x int")
    assert R.group_by(big, "k", [("SUM", "x", "s")]).first()["s"] == 3 * (2**31 - 1)
    assert R.filter_rows(spark.createDataFrame([(5, True), (5, False)], "x int, is_dummy boolean"), Clause("x", "=", 5)).count() == 1
    assert R.group_by(neg.limit(0), "k", [("SUM", "x", "s")]).count() == 0


def test_plans(spark):
    q1 = QUERIES["bdb_q1"](spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" not in q1.split("Physical Plan")[-1] and "o_totalprice" in q1 and "o_comment" not in q1
    assert "TakeOrderedAndProject" in QUERIES["bdb_q3"](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16])
def test_padding(spark, n):
    df = spark.range(n).withColumn("v", F.col("id") % 3)
    full = P.full_padded_filter_project(df, F.col("v") == 1, ["id"]).store()
    assert full.size() == n and rows(full.reveal()) == rows(df.where("v = 1").select("id"))
    none = P.full_padded_filter_project(df, F.lit(False), ["id"]).store()
    assert none.size() == n and none.reveal().count() == 0
    a, b = (P.padded_filter(df, F.col("v") == 1, batch=8, seed=5, order="id") for _ in range(2))
    assert a.padded_size() == b.padded_size() >= a.store().reveal().count()
    assert P.pad_multiple(df, 8).padded_size() == max(8, -(-n // 8) * 8)
    out = a.schedule.agg(F.sum("release"), F.min("release")).first()
    assert (out[0] or 0) <= df.where("v = 1").count() and (out[1] or 0) >= 0
    stored = P.padded_filter(df, F.col("v") == 1, batch=8, seed=5).store(key=b"k" * 16)
    assert rows(stored.reveal()) == rows(df.where("v = 1")) and stored.table.select(F.octet_length("blob")).distinct().count() <= 1


def test_padding_of_group_bys(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("k"), F.col("id").alias("x"))
    ledger = P.Ledger()
    a = P.padded_sort_group_by(df, F.col("k"), "k", "x", batch=64, seed=3, ledger=ledger)
    assert rows(a.store().reveal()) == rows(df.groupBy("k").agg(F.sum("x")).select("sum(x)", "k")) and a.store().size() == 700 + a.dummies
    assert a.schedule.count() == -(-5000 // 64) and a.schedule.agg(F.sum("release")).first()[0] <= 700
    b = P.padded_hash_group_by(df.groupBy("k").count(), "k", capacity=100, noise=False, ledger=ledger)
    passes = b.passes.collect()
    assert len(passes) == 8 and sum(p.n for p in passes) == 700 and all(p.size % 100 == 0 and p.size >= max(100, p.n) for p in passes)
    assert b.store().size() == sum(p.size for p in passes) and (ledger.epsilon, ledger.dummies) == (1.0, a.dummies + b.dummies)
    with pytest.raises(ValueError):
        P.pad_full(df, 4999)


def test_dummies_do_not_travel(spark, monkeypatch):
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def travelled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    df = spark.range(1000).withColumn("v", F.col("id").cast("string"))
    before = travelled()
    full = P.pad_full(df, 300_000).store()
    assert travelled() - before < 5000  # of 300,000 rows
    assert full.size() == 300_000 and rows(full.reveal()) == rows(df)
    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P, "GROUPS", 16)
    some = P.pad_full(df, 3000).store()
    assert some.size() == 3000 and rows(some.reveal()) == rows(df)
    flags = [r.is_dummy for r in some.table.select("is_dummy").collect()]
    assert 1000 < sum(a != b for a, b in zip(flags, flags[1:])) < 1700  # 1333 expected in random order


def test_passes_are_dealt_evenly(spark):
    df = spark.range(799).select(F.col("id").cast("string").alias("k"))
    f = P.padded_hash_group_by(df, "k", capacity=100, noise=False)
    assert sorted(p.n for p in f.passes.collect()) == [99] + [100] * 7 and f.store().size() == 800
    low = P.padded_hash_group_by(df, "k", capacity=100, t=4, noise=False).passes.collect()  # an estimate from four hashes
    assert sum(p.n for p in low) == 799 and all(p.size % 100 == 0 and p.size >= max(100, p.n) for p in low)


@pytest.mark.parametrize("kind", ["sum", "max"])
def test_running_sum(spark, kind):
    values = [(i, (i * 7919) % 101 - 50) for i in range(500)]
    df = spark.createDataFrame(values, "i long, x long").repartition(7)
    got = sorted(tuple(r) for r in R.running_sum(df, "i", "x", "s", kind).collect())
    so_far, want = None, []
    for i, x in values:
        now = x if so_far is None else so_far + x if kind == "sum" else max(so_far, x)
        want.append((i, x, now, so_far))
        so_far = now
    assert got == want and R.running_sum(df.limit(0), "i", "x", "s", kind).count() == 0


def test_counts_in_storage_order(spark):
    df = spark.range(0, 1000, 1, 3).withColumn("v", F.col("id") % 2)
    c = sorted(tuple(r) for r in P.batch_counts(df, F.col("v") == 1, 50).collect())
    assert [b for b, _ in c] == list(range(len(c))) and sum(n for _, n in c) == 500 and len(c) == 21


def test_noise_is_the_same_on_the_driver(spark):
    seen = spark.range(50).select(P.laplace(3.0, F.lit(2), "id", seed=4).alias("x")).collect()
    assert all(abs(r.x - P.laplace_draw(3.0, 2, i, seed=4)) < 1e-9 for i, r in enumerate(seen))
    sums = P.prefix_sums(spark.createDataFrame([(i, 10) for i in range(37)], "batch_id long, n long"), 0.5, seed=6)
    last = sums.orderBy(F.desc("batch_id")).first()
    assert last.prefix == 370 and abs(last.noisy - 370 - P.final_noise(37, 0.5, 6)) < 1e-9


def test_noise(spark):
    s = spark.range(100_000).select(P.laplace(2.0, "id", seed=9).alias("x")).agg(F.avg("x"), F.avg(F.abs("x")), F.stddev("x")).first()
    assert abs(s[0]) < 0.05 and abs(s[1] - 2) < 0.05 and abs(s[2] - 2 * math.sqrt(2)) < 0.08
    tail = P.noise_tail(spark, 4, 1.0, 2**-6, 20_000)
    assert 2 < tail < P.noise_tail_bound(4, 1.0, 2**-6)


def test_sketches(spark):
    df = spark.range(30_000).withColumn("k", F.col("id") % 6000)
    assert 1.0 <= P.distinct_count_kmv(df, "k", t=1000, epsilon_noise=False) / 6000 <= 1.15
    assert P.distinct_count_kmv(df, "k", t=10_000) == 6000
    assert abs(P.distinct_count_hll(df, "k") - 6000) < 300


def test_crypto(spark):
    df, key = spark.createDataFrame([(1, "a"), (None, None)], "i int, s string"), b"k" * 16
    blobs = encrypt_rows(df, key).cache()
    assert rows(decrypt_rows(blobs, key, df.schema)) == rows(df)
    assert encrypt_rows(df.union(df), key).distinct().count() == 4
    with pytest.raises(Exception, match="AES|CRYPTO|crypto"):
        decrypt_rows(blobs, b"x" * 16, df.schema).collect()
    when = datetime.datetime(2020, 2, 3, 4, 5, 6, 123456)
    hard = spark.createDataFrame([(when, when, 0.1 + 0.2, float("nan"), float("-inf"), Decimal("1.20"), b"\x00\xff", [1, None], {"a": 1.5}, (None, "x"))], "t timestamp, n timestamp_ntz, d double, q double, f double, c decimal(5,2), b binary, a array<int>, m map<string,double>, s struct<u:int,w:string>")
    name = keep_key(spark, key)
    for equal in (False, True):
        blob = encrypt_rows(hard, name, equal)
        assert str(decrypt_rows(blob, name, hard.schema).collect()) == str(hard.collect())
        assert key.hex() not in blob._jdf.queryExecution().toString().lower().replace(" ", "")
    with pytest.raises(Exception, match="no key"):
        encrypt_rows(hard, "no.such.key").collect()
    with pytest.raises(TypeError):
        encrypt_rows(spark.sql("select interval 1 day i"), key)
    with pytest.raises(Exception):
        decrypt_rows(blobs, key, "i int, s int").collect()


def test_executors_need_no_key_of_their_own(spark):
    df, key = spark.createDataFrame([(1, "a"), (None, None)], "i int, s string"), b"q" * 16
    blobs = encrypt_rows(df, keep_key(spark, key, "veilspark.test"), equal_length=True)
    back = decrypt_rows(blobs, "veilspark.test", df.schema)
    spark._jvm.java.lang.System.clearProperty("veilspark.test")  # an executor's JVM never had it
    assert rows(back) == rows(df) and back.where("i = 1").count() == 1
    for frame in (blobs, back, encrypt_rows(df, key)):
        plan = frame._jdf.queryExecution().toString()
        assert key.hex() not in plan.lower().replace(" ", "") and key.decode() not in plan


def test_small_helpers(spark):
    assert [next_power_of_two(n) for n in (1, 2, 3, 5, 8)] == [1, 2, 4, 8, 8] and [previous_power_of_two(n) for n in (2, 3, 8, 9)] == [1, 2, 4, 8]
    r = spark.createDataFrame([(3, -5), (0, 7)], "a int, b int").withColumn("i", interval("a", "b"))
    assert rows(r.select(*interval_bounds("i"))) == [(0, 7), (3, -5)]
    c = Catalog(spark)
    c.create("tab", r.schema)
    assert c.count("tab") == 0 and c.capacity["tab"] == 1
    with pytest.raises(ValueError):
        c.create("tab", r.schema)
    assert c.drop("tab") and not c.exists("tab")
    flagged = spark.createDataFrame([(5, False), (6, True)], "x int, is_dummy boolean")
    assert R.table_text(flagged) == "x int\n5"


def test_sorted_across_blocks(spark):
    one = spark.range(30_000).withColumn("v", F.col("id"))
    swapped = one.withColumn("v", F.when(F.col("id") < 10_000, F.col("id") + 10_000).when(F.col("id") < 20_000, F.col("id") - 10_000).otherwise(F.col("id")))
    tie = one.select("id", F.lit(1).alias("u"), F.when(F.col("id") < 20_000, 2).otherwise(1).alias("v"))
    gap = one.where("id < 5000 or id >= 25000").withColumn("v", F.when(F.col("id") < 5000, 1).otherwise(0))
    check = lambda df, *by: R.is_sorted(df, *by, position="id").first().is_sorted
    assert check(one, ("v", True)) and not check(one, ("v", False))
    assert not check(swapped, ("v", True)) and not check(gap, ("v", True)) and check(gap, ("v", False))
    assert not check(tie, ("u", True), ("v", True)) and check(tie, ("u", True), ("v", False))
    assert check(one.limit(0), ("v", True))

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from civitext.operators import sampling, splitting
from civitext.operators.ordered import top_by_count, with_row_number, with_running_sum


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(5_000, numPartitions=7).select((F.col("id") * 7919 % 5_000).alias("x"))
    rows = with_row_number(df, [F.col("x").desc()], "r").collect()
    assert sorted((r.r, r.x) for r in rows) == [(i + 1, 4_999 - i) for i in range(5_000)]


def test_row_numbers_restart_in_groups(spark):
    df = spark.range(900).select((F.col("id") % 3 * (F.col("id") % 2)).alias("g"), F.col("id").alias("x"))
    rows = with_row_number(df, [F.col("x").asc()], "r", ["g"]).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r.x):
        groups.setdefault(r.g, []).append(r.r)
    assert all(v == list(range(1, len(v) + 1)) for v in groups.values())


def test_running_sums(spark):
    df = spark.range(2_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"), F.lit(2).alias("v"))
    rows = with_running_sum(df, [F.col("x").asc()], "v", "s", ["g"]).collect()
    assert all(r.s == 2 * (r.x // 2) for r in rows) and len(rows) == 2_000


def test_split_is_exact_and_in_hash_order(spark):
    df = spark.range(1_003).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    rows = splitting.stratified_split(df).collect()
    assert len(rows) == 1_003 and len({r.row_id for r in rows}) == 1_003
    for label in (0, 1):
        mine = [r for r in rows if r.label == label]
        mine.sort(key=lambda r: hashlib.md5(f"42:{r.row_id}".encode()).hexdigest())
        n = len(mine)
        want = ["train"] * (n * 8 // 10) + ["val"] * (n * 9 // 10 - n * 8 // 10)
        assert [r.split for r in mine] == want + ["test"] * (n - len(want))


def test_split_of_tiny_strata(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "row_id int, label int")
    sizes = Counter((r.label, r.split) for r in splitting.stratified_split(df).collect())
    assert sizes == {(0, "test"): 1, (1, "train"): 1, (1, "test"): 1}


def test_split_does_not_shuffle_the_rows(spark):
    df = spark.range(1_000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"))
    plan = splitting.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_samples_and_caps(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit("train").alias("split"))
    first = [r.row_id for r in sampling.sample_k(df, 10).collect()]
    assert len(set(first)) == 10 and first == [r.row_id for r in sampling.sample_k(df.repartition(5), 10).collect()]
    assert sampling.sample_k(df, 1_000).count() == 100
    assert sorted(r.row_id for r in sampling.quick_cap(df, {"train": 3}).collect()) == [0, 1, 2]


def test_large_sample_is_the_plain_one(spark, monkeypatch):
    df = spark.range(3_000).select(F.col("id").alias("row_id"))
    plain = [r.row_id for r in sampling.sample_k(df, 500).collect()]
    monkeypatch.setattr(sampling, "PLAIN_TOP_K", 10)
    assert [r.row_id for r in sampling.sample_k(df, 500).collect()] == plain
    assert sampling.sample_k(df, 5_000).count() == 3_000


def test_top_by_count(spark):
    df = spark.range(1_000).select(F.col("id"), (F.col("id") % 10).alias("n"))
    top = [(r.n, r.id) for r in top_by_count(df, 150, "n", F.col("id").asc()).collect()]
    assert top == [(9, i) for i in range(9, 1_000, 10)] + [(8, i) for i in range(8, 500, 10)]
    assert top_by_count(df, 5_000, "n", F.col("id").asc()).count() == 1_000

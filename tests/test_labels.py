import pytest
from pyspark.sql import functions as F

from civitext.operators import adapters, augmentation, labels
from civitext.schemas import FLAGS


def test_flags_that_are_missing_do_not_count(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, None), (2, "b", 0, 1), (3, "  ", 1, 1), (4, None, 1, 0), (5, "e", 1, 0)],
        "row_id int, comment_text string, toxic int, insult int",
    )
    rows = labels.binary_labels(df).orderBy("row_id").collect()
    assert [(r.row_id, r.label) for r in rows] == [(1, 0), (2, 1), (5, 1)]
    tagged = labels.per_class(df, FLAGS, carry=("row_id",)).collect()
    assert sorted((r.tag, r.row_id) for r in tagged) == [("insult", 2), ("insult", 3), ("toxic", 3), ("toxic", 5)]
    assert [r.row_id for r in labels.neutral_rows(df).collect()] == [1]


def test_distribution_and_weights(spark):
    df = spark.createDataFrame([(0,)] * 7 + [(1,)] * 2, "label int")
    rows = {r.label: r for r in labels.label_distribution(df).collect()}
    assert (rows[0].n, rows[1].n, rows[0].ratio, rows[0].imbalanced) == (7, 2, 3.5, True)
    weights = {r.label: r.weight for r in labels.class_weights(df).collect()}
    assert weights == pytest.approx({0: 9 / 14, 1: 9 / 4})
    gap = spark.createDataFrame([(0,), (2,)], "label int")
    assert {r.label: r.weight for r in labels.class_weights(gap).collect()} == pytest.approx({0: 2 / 3, 1: 0, 2: 2 / 3})
    none = labels.label_distribution(df.limit(0)).collect()
    assert [(r.n, r.share, r.ratio) for r in none] == [(0, 0.0, 0.0)] * 2


def test_three_way(spark):
    df = spark.createDataFrame(
        [("a", 0), ("b", 1), ("c", 2), ("d", -1), (" ", 0), ("f", None), (None, 1)], "tweet string, class int"
    )
    rows = adapters.adapt("three_way", df).collect()
    assert sorted((r.text, r.label) for r in rows) == [("a", 1), ("b", 1), ("c", 0)]
    with pytest.raises(ValueError):
        adapters.adapt("nothing", df)


def test_annotated(spark):
    schema = "post_tokens array<string>, annotators array<struct<label int>>, label int"
    df = spark.createDataFrame(
        [
            (["a", "b"], [(0,), (1,), (0,)], None),
            (["c"], [(2,), (1,), (0,)], 0),
            (["d"], None, 0),
            (["e"], None, None),
            ([" "], [(1,)], None),
        ],
        schema,
    )
    rows = sorted((r.text, r.label) for r in adapters.adapt("annotated", df).collect())
    assert rows == [("a b", 0), ("c", 1), ("d", 0)]
    other = sorted((r.text, r.label) for r in adapters.adapt("annotated", df, non_toxic_value=2).collect())
    assert other == [("a b", 1), ("c", 0), ("d", 1)]


def test_majority_of_a_hot_key(spark):
    hot = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 3).alias("v"))
    cold = spark.createDataFrame([(2, 0, 9), (2, 1, 8), (2, 2, 8)], "k int, o bigint, v bigint")
    rows = adapters.majority_vote(hot.unionByName(cold), "k", "v", F.col("o")).collect()
    assert {r.k: r.v for r in rows} == {1: 0, 2: 8}


def test_augmentation_moves_only_class_one(spark):
    train = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "text string, label int")
    added = spark.createDataFrame([("x",), ("y",)], "text string")
    impact = {r.setting: (r.n0, r.n1, round(r.pct1, 3)) for r in augmentation.augmentation_impact(train, added).collect()}
    assert impact == {"baseline": (2, 1, 33.333), "augmented": (2, 3, 60.0), "delta": (0, 2, 26.667)}
    assert augmentation.augment(train, added).count() == 5


def test_class_training_table(spark):
    real = spark.createDataFrame(
        [("1", "b", "x"), ("2", "nor", "y"), ("3", "a", " "), ("4", "other", "z"), ("5", "a", "w"), ("6", None, "v")], "row_id string, tag string, text string"
    )
    synthetic = spark.createDataFrame([("s1", "made"), ("s2", None)], "row_id string, text string")
    got = {r.row_id: r.class_idx for r in labels.class_training_table(real, synthetic, ["b", "nor", "a"]).collect()}
    assert got == {"2": 0, "1": 1, "5": 2, "s1": 3}
    assert labels.class_training_table(real, None, ["b", "a"]).filter("class_idx = 0").count() == 1


def test_other_labels_count_in_the_total(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (2,), (None,)], "label int")
    got = {r.label: (r.n, r.share) for r in labels.label_distribution(df).collect()}
    assert got == {0: (2, 0.5), 1: (1, 0.25)}

from pyspark.sql import functions as F

from civitext.functions import scores as S
from civitext.functions import sequences as Q


def value(spark, literal, expr):
    return spark.range(1).select(expr(literal)).first()[0]


def ids(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def test_fixed_length(spark):
    assert value(spark, ids(4, 5, 2), lambda a: Q.fixed_length(a, 5)) == [4, 5, 2, 0, 0]
    assert value(spark, ids(4, 5, 6, 2), lambda a: Q.fixed_length(a, 3)) == [4, 5, 6]
    assert value(spark, ids(4, 5, 6, 2), lambda a: Q.fixed_length(a, 3, force_eos=True)) == [4, 5, 2]
    assert value(spark, ids(4, 5, 2), lambda a: Q.fixed_length(a, 3, force_eos=True)) == [4, 5, 2]
    assert value(spark, ids(4, 0, 2, 0), Q.nonpad_length) == 2


def test_frames_shifts_and_ends(spark):
    assert value(spark, ids(7, 8), Q.frame) == [1, 7, 8, 2]
    assert value(spark, ids(7, 8), Q.append_eos) == [7, 8, 2]
    assert value(spark, ids(7, 8, 2), Q.shift_inputs) == [7, 8]
    assert value(spark, ids(7, 8, 2), Q.shift_targets) == [8, 2]
    assert value(spark, ids(), Q.shift_targets) == []
    assert value(spark, ids(7, 2, 8, 2), Q.until_eos) == [7]
    assert value(spark, ids(7, 8), Q.until_eos) == [7, 8]
    assert value(spark, ids(2, 7), Q.until_eos) == []
    assert value(spark, F.lit(" 3 14  2 "), Q.text_to_ids) == [3, 14, 2]


def test_majority_ties_go_to_first_seen(spark):
    cases = {(2, 1, 0): 2, (1, 2, 2): 2, (0, 1, 1, 0): 0, (5,): 5}
    for votes, best in cases.items():
        assert value(spark, ids(*votes), S.majority) == best


def test_softmax_argmax_one_hot(spark):
    p = value(spark, F.array(F.lit(1000.0), F.lit(1000.0)), S.softmax)
    assert p == [0.5, 0.5]
    assert value(spark, ids(3, 9, 9), S.argmax) == 1
    assert value(spark, F.lit(2), lambda c: S.one_hot(c, 4)) == [0.0, 0.0, 1.0, 0.0]
    assert abs(value(spark, F.array(F.lit(0.25), F.lit(0.75)), lambda c: S.miss_score(c, F.lit(1))) - 0.25) < 1e-12

import random

from pyspark.sql import functions as F

from civitext.operators.cleaning import REASONS, clean_generated, clean_report, with_cleaning


def reasons(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [(r.reason, r.cleaned) for r in with_cleaning(df).orderBy("i").collect()]


def test_boundaries(spark):
    cases = [
        ("", "empty", None),
        ("   \x1c ", "empty", None),
        (None, "empty", None),
        ("two words", "too_short", None),
        ("now three words", None, "now three words"),
        ("now three words\x1cmore", None, "now three words more"),
        ("<UNK> Unk unk a b c d e f g", None, "a b c d e f g"),
        ("<UNK> Unk unk <unk> a b c d e f", "high_unk", None),
        ("Yes yes no maybe", None, "Yes yes no maybe"),
        ("Yes yes YES maybe", "repetitive", None),
        ("a1 -- b2 99", None, "a1 -- b2 99"),
        ("a1 -- !! 99", "non_alpha", None),
        ("chunk trunk unkempt words", None, "chunk trunk unkempt words"),
    ]
    got = reasons(spark, [c[0] for c in cases])
    assert got == [(c[1], c[2]) for c in cases]


def expected(text):
    """The rules, word for word, on one text."""
    words = text.split()
    low = [w.lower() for w in words]
    unk = sum(w in ("<unk>", "unk") for w in low)
    if not words:
        return "empty"
    if len(words) <= 2:
        return "too_short"
    if unk / len(words) > 0.3:
        return "high_unk"
    if max(map(low.count, low)) / len(words) > 0.5:
        return "repetitive"
    if sum(any("a" <= c <= "z" or "A" <= c <= "Z" for c in w) for w in words) / len(words) < 0.5:
        return "non_alpha"
    return None


def test_random_texts_against_the_rules(spark):
    rng = random.Random(7)
    pool = ["a", "B", "b", "unk", "<UNK>", "1", "--", "é", "x9", "　", "ab-c", "ß", "."]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(800)]
    got = [r for r, _ in reasons(spark, texts)]
    assert got == [expected(t) for t in texts]
    assert set(got) == {None, *REASONS[:5]}


def test_report_adds_up_and_kept_texts(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",), ("d e f",)], "text string")
    report = {r.reason: (r.n, r.share) for r in clean_report(with_cleaning(df)).collect()}
    assert report == {"kept": (2, 0.5), "too_short": (1, 0.25), "empty": (1, 0.25), "input": (4, 1.0)}
    assert sorted(r.text for r in clean_generated(df).collect()) == ["a b c", "d e f"]


def test_tokenizing_is_not_repeated_in_the_filter(spark):
    df = spark.range(1).select(F.lit("a b c").alias("text")).union(spark.range(1).select(F.lit("a").alias("text")))
    plan = clean_generated(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce") <= plan.count("Generate explode(array(array_remove(split")

import random

import pytest
from pyspark.sql import functions as F

from civitext import session
from civitext.operators import classifier, ordered, pool_cycle
from civitext.operators import neutral_pool as P


def test_dedup_keeps_the_first_of_a_hot_text(spark):
    df = spark.range(9_000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    rows = P.dedup_first_seen(df.repartition(6), ["k"])
    assert rows.count() == 6_001 and rows.filter("text = 'same'").first().k == 0


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_dedup_is_the_first_by_any_order(spark, monkeypatch, kind, broadcast):
    if not broadcast:
        monkeypatch.setattr(P, "broadcast_if_small", lambda df: df)
    rng = random.Random(5)
    rows = [(i % 7 - 3, i, rng.choice(("a", "b", "", None, f"t{i}"))) for i in range(200)]
    df = spark.createDataFrame(rows, "d long, n int, text string").withColumn("n", F.col("n").cast(kind)).repartition(5)
    first = {}
    for d, n, text in sorted(rows, key=lambda r: (r[0], str(r[1]) if kind == "string" else r[1])):
        first.setdefault(text, (d, str(n) if kind == "string" else n))
    got = {r.text: (r.d, r.n) for r in P.dedup_first_seen(df, ["d", "n"]).collect()}
    assert got == first


def test_dedup_tells_texts_of_one_name_apart(spark, monkeypatch):
    real = F.xxhash64

    def blunt(*cols):
        """The two naming hashes only see the text's length; the third one sees the text."""
        salt = {1: 0, 2: None}.get(len(cols), 0)
        whole = len(cols) == 2 and "2" in str(cols[0])
        return real(*cols) if whole else real(F.length(cols[-1]), F.lit(salt))

    monkeypatch.setattr(P.F, "xxhash64", blunt)
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "c"), (6, "ddd")]
    df = spark.createDataFrame(rows, "k long, text string")
    assert sorted((r.k, r.text) for r in P.dedup_first_seen(df, ["k"]).collect()) == [(1, "aa"), (2, "bb"), (4, "c"), (6, "ddd")]


def test_dedup_hashes_and_does_not_sort(spark):
    df = spark.range(100).select(F.col("id").alias("d"), F.lit(1).alias("n"), (F.col("id") % 9).cast("string").alias("text"))
    narrow = df.withColumn("_a", F.xxhash64("text")).groupBy("_a").agg(F.min(P.packed(df, ["d", "n"])))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("values", [[0.0] * 50, [1.0], [], [3.0, 1.0, 2.0] * 9, [1.0 + i * 2.0**-52 for i in range(30)], [1e300, -1e300, 0.5, None] * 5])
def test_kth_largest_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted((v for v in values if v is not None), reverse=True)
    for k in (0, 1, 2, len(ranked) // 2, len(ranked), len(ranked) + 1):
        got = ordered.kth_largest(df, "v", k, bins=4)
        assert got == ((ranked[k - 1], sum(v > ranked[k - 1] for v in ranked)) if 1 <= k <= len(ranked) else None)


def test_best_rows_cut_ties_by_key(spark):
    rng = random.Random(2)
    rows = [(i, f"k{i % 5}", rng.choice((0.0, 0.25, None, 1.0)), "text") for i in range(120)]
    df = spark.createDataFrame(rows, "n long, tag string, score double, text string").repartition(4)
    ranked = sorted(rows, key=lambda r: (-(r[2] or 0.0), r[1], r[0]))
    for k in (0, 1, 17, 60, 119, 120, 500):
        got = {r.n for r in ordered.best_rows(df, k, "score", ["tag", "n"]).collect()}
        assert got == {r[0] for r in ranked[:k]}


def words_scorer(spark, good, key="row_id"):
    """Two-class scorer: class 0 for texts with the word `good`."""
    terms = spark.createDataFrame([(0, good, 1.0)], "idx int, term string, idf double")
    return classifier.ClassScorer(terms, spark.createDataFrame([(0, 0, 4.0)], "idx int, class int, coef double"), [0.0, 1.0], key)


def test_pool_cycle_goes_on_after_the_last_complete_generation(spark, tmp_path):
    texts = [f"{'fine' if i % 2 else 'plain'} {'day' if i % 3 else 'night'} number {i}" for i in range(60)] + ["short", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").withColumn("row_id", F.col("n").cast("string"))
    words, asked = ["fine", "day", "night"], []

    def model(generation):
        asked.append(generation)
        return pool_cycle.class_model(words_scorer(spark, words[generation]))

    cycle = pool_cycle.PoolCycle(spark, str(tmp_path / "pool"), ["n"])
    assert cycle.last() is None
    with pytest.raises(ValueError):
        cycle.advance(model(0))
    cycle.run(rows, model, 1)
    # A broken run: files of the next generation without the mark of a complete one.
    (tmp_path / "pool" / "generation=000002").mkdir()
    (tmp_path / "pool" / "generation=000002" / "part-0.parquet").write_bytes(b"half")
    again = pool_cycle.PoolCycle(spark, str(tmp_path / "pool"), ["n"])
    assert again.last() == 1
    with pytest.raises(ValueError):
        again.read(2)
    last = {r.n: r.score for r in again.run(rows, model, 2).collect()}
    assert asked == [0, 0, 1, 2] and again.last() == 2
    # By hand: all rows by "fine", the best 31 of 62; these by "day", the best 20; these by "night".
    high, low = 1 / (1 + 2.718281828459045 ** (1 - 4.0)), 1 / (1 + 2.718281828459045)

    def score(n, word):
        return 0.0 if n >= 60 else (high if word in texts[n].split() else low)

    first = sorted(range(62), key=lambda n: (-score(n, "fine"), n))[:31]
    second = sorted(first, key=lambda n: (-score(n, "day"), n))[:20]
    assert last == pytest.approx({n: score(n, "night") for n in second})
    assert {r.n for r in again.read(1).collect()} == set(first)
    assert again.start(rows, model(0)).count() == 62


def test_unstage_takes_staged_tables_only(spark, tmp_path):
    staged = session.stage(spark.range(3), "t")
    session.unstage(staged)
    spark.range(2).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        session.unstage(spark.read.parquet(str(tmp_path / "mine")))


def test_refresh_sizes_and_ties(spark):
    def survivors(n):
        df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("double").alias("score"))
        rows = P.refresh_pool(df, ["row_id"]).orderBy("rank").collect()
        return [r.row_id for r in rows]

    assert len(survivors(15)) == 15 and len(survivors(30)) == 20
    assert survivors(60) == list(range(1, 60, 2)) and survivors(0) == []


def test_untokenizable_text_scores_zero(spark):
    df = spark.createDataFrame([("one two",), ("one two three",), ("w " * 19,), ("w " * 20,)], "text string")
    assert [r.score for r in P.score_pool(df, F.lit(0.7)).collect()] == [0.0, 0.7, 0.7, 0.0]


def test_fewshot_tops_up_from_neutrals(spark):
    pool = spark.createDataFrame([(1, "a", 0.5), (2, "", 0.9), (3, "b", 0.1)], "row_id int, text string, score double")
    neutrals = spark.createDataFrame([(i, t) for i, t in enumerate("abcdef")], "row_id int, text string")
    rows = P.fewshot_examples(pool, neutrals).orderBy("rank").collect()
    texts = [r.text for r in rows]
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and set(texts[:2]) == {"a", "b"}
    assert set(texts[2:]) <= set("cdef") and len(set(texts)) == 5
    assert len(P.fewshot_examples(pool).collect()) == 2


def test_prompt(spark):
    examples = spark.createDataFrame([(2, "two  “x”"), (1, "one")], "rank int, text string")
    prompt = P.prompt_text(examples).first().prompt.split("\n")
    assert prompt[:9] == P.PROMPT_HEADER and prompt[9:11] == ["1. one", '2. two "x"'] and prompt[11:] == P.PROMPT_FOOTER


def test_fallback(spark):
    neutrals = spark.createDataFrame(
        [(1, "this is an example"), (2, "Output: a fine day today"), (3, "a fine day today"), (4, "http://x y z"), (5, "no")],
        "row_id int, text string",
    )
    examples = neutrals.filter("row_id = 1")
    assert [r.text for r in P.fallback_pool(neutrals, examples, 10).collect()] == ["a fine day today"]
    # All neutrals are examples: they are drawn anyway, and the filter drops them.
    assert P.fallback_pool(neutrals, neutrals, 10).collect() == []


def test_texts_that_are_not_scored_are_not_moved(spark, tmp_path):
    """Only texts of a fitting length meet the scores; the others stay in the task that reads them."""
    texts = [(str(i), "one two three four" if i % 4 else "word " * 200) for i in range(40)] + [("null", None), ("short", "one")]
    spark.createDataFrame(texts, "row_id string, text string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        scored = pool_cycle.scored_rows(rows, lambda r: r.select("row_id", F.lit(0.5).alias("score")))
        found = scored.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.row_id: r.score for r in found} == {k: 0.5 if t and t.startswith("one two") else 0.0 for k, t in texts}
    assert len({r.task for r in found if r.score == 0.0}) == 1 and len(found) == len(texts)

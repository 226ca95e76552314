import json
import math
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from civitext.operators import classifier, similarity, tfidf
from civitext.plans import analysis, experiment

DOCS = [
    (1, "bad awful words", 1), (2, "nice kind words", 0), (3, "awful bad bad", 1), (4, "kind nice day", 0),
    (5, "nice day", 0), (6, "bad day awful", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "row_id bigint, text string, label int")


def test_weights_by_hand(docs):
    counts = tfidf.term_counts(docs)
    terms = tfidf.numbered_terms(tfidf.top_terms(counts), len(DOCS))
    got = {r.term: r.weight for r in tfidf.weigh(counts, terms).filter("row_id = 3").collect()}
    idf = {"awful": 3, "bad": 3, "awful bad": 1, "bad bad": 1}
    raw = {t: (1 + math.log(2 if t == "bad" else 1)) * (math.log(7 / (1 + df)) + 1) for t, df in idf.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got == pytest.approx({t: v / norm for t, v in raw.items()})


def test_top_terms_ties_by_term(docs):
    top = [r.term for r in tfidf.top_terms(tfidf.term_counts(docs), 4).collect()]
    assert top == ["bad", "awful", "day", "nice"]


def test_terms_are_cut_in_tasks_of_bounded_text_and_counted_by_number(spark, monkeypatch):
    """A task's share of the texts is bounded by bytes; repeated and null keys are one text."""
    monkeypatch.setattr(tfidf, "BYTES_PER_TASK", 400)
    rows = spark.createDataFrame([(i % 50 or None, "one two two three") for i in range(100)], "row_id bigint, text string")
    assert tfidf.term_counts(rows).rdd.getNumPartitions() == math.ceil(100 * (17 + tfidf.ROW_BYTES) / 400)
    terms, counts = tfidf.counted_terms(rows, max_terms=3)
    assert [tuple(r) for r in terms.orderBy("idx").collect()] == [(0, "one", 100, 50), (1, "one two", 100, 50), (2, "two", 200, 50)]
    assert {(r.row_id, r.idx): r.c for r in counts.collect()} == {(k or None, i): (2, 2, 4)[i] for k in range(50) for i in range(3)}


def matrix(docs, terms, rows=len(DOCS)):
    """Dense unit vectors of the texts by row number, from the long form."""
    x = np.zeros((rows, terms.count()))
    for r in tfidf.weigh(tfidf.term_counts(docs), terms).collect():
        x[r.row_id - 1, r.idx] = r.weight
    return x


def test_fit_score_save_load(spark, docs, tmp_path):
    fitted = classifier.fit_text_classifier(docs)
    unseen = spark.createDataFrame([(7, "bad words", 1), (8, "nice words", 0), (9, "???", 0), (10, None, 0)], docs.schema)
    rows = {r.row_id: r for r in fitted.score(unseen).collect()}
    assert rows[7].prediction == 1 and rows[8].prediction == 0 and set(rows) == {7, 8, 9, 10}
    assert rows[9].prob == rows[10].prob == pytest.approx(1 / (1 + math.exp(-fitted.intercept)))
    # The sum over terms is the model's own probability.
    coefs = np.array([r.coef for r in fitted.terms.orderBy("idx").collect()])
    own = 1 / (1 + np.exp(-(matrix(docs, fitted.terms) @ coefs + fitted.intercept)))
    assert {r.row_id: r.prob for r in fitted.score(docs).collect()} == pytest.approx(dict(enumerate(own, 1)))
    fitted.save(str(tmp_path / "m"))
    again = classifier.TextClassifier.load(spark, str(tmp_path / "m"))
    assert [r.prob for r in again.score(unseen).orderBy("row_id").collect()] == pytest.approx(
        [rows[k].prob for k in (7, 8, 9, 10)]
    )


def test_vectors_are_typed_and_whole(docs):
    terms = tfidf.numbered_terms(tfidf.top_terms(tfidf.term_counts(docs)), len(DOCS))
    rows = docs.select("row_id", "label").unionByName(docs.limit(1).select(F.lit(99).cast("long").alias("row_id"), F.lit(0).alias("label")))
    vectors = classifier.training_vectors(tfidf.weigh(tfidf.term_counts(docs), terms), rows.withColumn("no", F.col("row_id")), terms.count())
    got = {r.no: r.features for r in vectors.collect()}
    want = matrix(docs, terms)
    assert all(got[i + 1].toArray() == pytest.approx(want[i]) for i in range(len(DOCS)))
    assert got[99].numNonzeros() == 0 and got[99].size == terms.count()


def test_objective_is_at_its_optimum(docs):
    """The gradient of the summed, weighted loss plus half the squared norm is zero (C = 1)."""
    fitted = classifier.fit_text_classifier(docs)
    x = matrix(docs, fitted.terms)
    y = np.array([d[2] for d in DOCS])
    w, b = np.array([r.coef for r in fitted.terms.orderBy("idx").collect()]), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # Both classes have three rows, so every balanced weight is 1.
    by_hand = x.T @ (p - y) + w
    assert np.abs(by_hand).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    slopes = {r.idx: r.gradient for r in classifier.binary_gradient(fitted, docs).collect()}
    assert slopes == pytest.approx({-1: (p - y).sum(), **dict(enumerate(by_hand))}, abs=1e-9)
    # Away from the optimum it is not.
    shifted = classifier.TextClassifier(fitted.terms.withColumn("coef", F.col("coef") + 1.0), b)
    assert classifier.optimality(classifier.binary_gradient(shifted, docs)).first().largest > 0.5


CLASSES = [(1, "bad awful words", 1), (2, "nice kind words", 0), (3, "dull grey day", 2), (4, "kind nice sun", 0), (5, "grey rain", 2), (6, "bad awful", 1), (7, "bad", 1)]


def test_class_scorer_fits_scores_and_comes_back(spark, tmp_path):
    train = spark.createDataFrame(CLASSES, "row_id bigint, text string, class_idx int")
    fitted = classifier.fit_class_scorer(train)
    unseen = spark.createDataFrame([(11, "awful", "x"), (12, "nice sun", "y"), (13, "rain", "z"), (14, "?", None)], "row_id bigint, text string, prob string")
    scored = fitted.score(unseen, keep_text=True).orderBy("row_id").collect()
    assert [r.prediction for r in scored[:3]] == [1, 0, 2] and scored[0].text == "awful" and scored[0].prob == "x"
    assert all(sum(r.probs) == pytest.approx(1) for r in scored)
    alone = np.exp(fitted.intercepts) / np.exp(fitted.intercepts).sum()
    assert scored[3].probs == pytest.approx(list(alone))
    best = classifier.optimality(classifier.class_gradient(fitted, train)).first()
    assert best.largest < 1e-3 and best.intercepts < 1e-3
    # The slopes by hand: balanced weights 7 / (3 n_k).
    x, k = matrix(train, fitted.terms, 7), np.array([c[2] for c in CLASSES])
    coefs = np.zeros((x.shape[1], 3))
    for r in fitted.coefs.collect():
        coefs[r.idx, r["class"]] = r.coef
    z = x @ coefs + fitted.intercepts
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    residual = (p - np.eye(3)[k]) * (7 / 3 / np.bincount(k)[k])[:, None]
    got = {(r["class"], r.idx): r.gradient for r in classifier.class_gradient(fitted, train).collect()}
    for c in range(3):
        assert got[c, -1] == pytest.approx(residual[:, c].sum(), abs=1e-9)
        assert [got[c, i] for i in range(x.shape[1])] == pytest.approx(list(x.T @ residual[:, c] + coefs[:, c]), abs=1e-9)
    fitted.save(str(tmp_path / "k"))
    again = classifier.ClassScorer.load(spark, str(tmp_path / "k"))
    assert [r.probs for r in again.score(unseen).orderBy("row_id").collect()] == [pytest.approx(r.probs) for r in scored]


def test_models_score_together_as_alone(spark, docs):
    one = classifier.fit_text_classifier(docs)
    other = classifier.fit_text_classifier(docs.withColumn("label", 1 - F.col("label")).filter("row_id < 6"))
    unseen = spark.createDataFrame([(7, "bad words", "m"), (8, "nice", "n"), (9, "???", None)], "row_id bigint, text string, model2 string")
    both = classifier.score_together({"one": one, "other": other}, unseen)
    assert sorted(both.columns) == ["model", "model2", "prediction", "prob", "row_id"] and both.count() == 6
    for name, clf in (("one", one), ("other", other)):
        want = {r.row_id: r.prob for r in clf.score(unseen).collect()}
        assert {r.row_id: r.prob for r in both.filter(F.col("model") == name).collect()} == pytest.approx(want)
    # All models share one scan of the texts.
    assert both._jdf.queryExecution().executedPlan().toString().count("RepartitionByExpression") <= 1


def test_terms_of_a_text_are_counted_once_for_all_models(spark, docs):
    """What a task keeps for a term of a text is its key and two numbers, however many models there are."""
    one = classifier.fit_text_classifier(docs)
    other = classifier.fit_text_classifier(docs.filter("row_id < 6"))
    plan = classifier.score_together({"one": one, "other": other}, docs)._jdf.queryExecution().executedPlan().toString()
    keys = {tuple(re.sub(r"#\d+L?", "", k).split(", ")) for k in re.findall(r"HashAggregate\(keys=\[([^]]*)\]", plan)}
    assert keys == {("row_id", "idx"), ("row_id",)}


def test_outside_sets_are_read_once(spark, docs):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    fitted = {("m", "augmented"): classifier.fit_text_classifier(docs)}
    rows = docs.withColumn("text", read("text"))
    experiment.cross_dataset(fitted, {"a": lambda: rows}).collect()
    assert seen.value == len(DOCS)


def test_iterations_of_a_fit_visit_few_partitions(spark):
    vectors = spark.range(0, 100, numPartitions=20)
    assert classifier._few_partitions(vectors, 20_000_000).rdd.getNumPartitions() == 1
    assert classifier._few_partitions(vectors, 300_000_000).rdd.getNumPartitions() == 10


def test_counts_are_sorted_in_tasks_of_bounded_size(spark, docs, monkeypatch):
    before = classifier.fit_text_classifier(docs).score(docs).orderBy("row_id").collect()
    counts = tfidf.counted_terms(docs)[1]
    assert classifier._bounded_by_key(counts, 4_000_000, "row_id") is counts
    assert classifier._bounded_by_key(counts, 40_000_000, "row_id").rdd.getNumPartitions() == 40
    monkeypatch.setattr(classifier, "ENTRIES_PER_SORT", 2)
    after = classifier.fit_text_classifier(docs).score(docs).orderBy("row_id").collect()
    assert [r.prob for r in after] == pytest.approx([r.prob for r in before], abs=1e-4)


def test_experiment_report_and_skipped_sets(spark, docs):
    added = spark.createDataFrame([(101, "awful bad thing"), (102, "bad thing")], "row_id bigint, text string")
    fitted = experiment.fit_settings(docs, added, shared_weights=True)
    report = experiment.report(docs, added, docs, experiment.evaluate(fitted, docs)).first()
    assert (report.train_original, report.train_augmented, report.augmented_toxic, report.test_size) == (6, 8, 5, 6)
    assert [r.setting for r in report.in_domain] == ["augmented", "baseline"] and len(report.improvement) == 5

    def missing():
        return spark.read.parquet("/no/such/table")

    with pytest.raises(AnalysisException):
        missing()
    other = docs.filter("row_id <> 3").withColumn("row_id", F.col("row_id").cast("string"))
    skipped = []
    rows = experiment.cross_dataset(fitted, {"gone": missing, "same": lambda: docs, "other": lambda: other}, skipped=skipped).collect()
    assert sorted((r.dataset, r.setting, r.recall, r.tn) for r in rows) == [("other", "augmented", 1.0, 3), ("same", "augmented", 1.0, 3)]
    assert skipped == ["gone"]
    with pytest.raises(ValueError):
        experiment.cross_dataset(fitted, {"gone": missing})


def test_full_analysis_and_saved_models(spark, docs, tmp_path):
    rows = docs
    for shift in range(1, 5):
        rows = rows.unionByName(docs.withColumn("row_id", F.col("row_id") + 10 * shift))
    gen = {"tweet": ["awful bad thing here", "bad", "bad awful unk day"], "class": ["0", "0", "1"]}
    (tmp_path / "gen.json").write_text(json.dumps(gen))
    posts = spark.createDataFrame(
        [("1", "bad awful", 0), ("2", "nice day", 2), ("3", "", 1)], "row_id string, tweet string, class int"
    )
    outside = {"three_way": lambda: analysis.adapt("three_way", posts, carry=("row_id",))}
    out = str(tmp_path / "out")
    report = analysis.full_analysis(
        spark, lambda: rows, str(tmp_path / "gen.json"), str(tmp_path / "splits"), out, outside, quick_test=True
    ).first()
    assert (report.train_original, report.generated_cleaned, report.test_size) == (24, 2, 4)
    assert len(report.in_domain) == 2 and [r.dataset for r in report.cross_dataset] == ["three_way"]
    assert spark.read.parquet(f"{out}/predictions/tfidf_lr").count() == 4
    result = analysis.evaluate_saved(spark, f"{out}/models/tfidf_lr", posts, "three_way", out)
    assert {r.metric: r.augmented for r in result.collect()}["accuracy"] == 1.0


def test_anchors_of_several_widths_raise_and_odd_candidates_are_null(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [0.0, -2.0])]
    anchors = spark.createDataFrame([(0, [0.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [])], schema)
    anchors = anchors.unionByName(spark.createDataFrame([(7, [-1.0, 0.0])], schema))
    for block in (None, 1):
        got = similarity.max_anchor_cosine(spark.createDataFrame(rows, schema), anchors, "vec_id", "embedding", block=block)
        assert {r.vec_id: r.max_cos for r in got.collect()} == {1: 0.0, 2: None, 3: None, 4: None, 5: None, 6: 0.0}
    stray = anchors.unionByName(spark.createDataFrame([(9, [1.0, 1.0, 1.0])], schema))
    with pytest.raises(ValueError, match="widths"):
        similarity.max_anchor_cosine(spark.createDataFrame(rows, schema), stray, "vec_id", "embedding")


def test_anchor_cosine_small_and_blocked_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(90, 6)).astype("float32")
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<float>"
    )
    cands, anchors = df.filter("vec_id < 60"), df.filter("vec_id >= 60")
    # A hot anchor, a third of all of them.
    anchors = anchors.unionByName(anchors.filter("vec_id = 60").select(F.explode(F.expr("sequence(1, 15)")), "*").drop("col"))
    unit = vecs.astype("float64") / np.linalg.norm(vecs.astype("float64"), axis=1, keepdims=True)
    want = {i: v for i, v in enumerate((unit[:60] @ unit[60:].T).max(axis=1))}
    small = {r.vec_id: r.max_cos for r in similarity.max_anchor_cosine(cands, anchors, "vec_id", "embedding").collect()}
    for block, pivots in ((8, 5), (1, 40), (29, 1)):
        ringed = similarity.max_anchor_cosine(cands, anchors, "vec_id", "embedding", block=block, pivots=pivots)
        assert {r.vec_id: r.max_cos for r in ringed.collect()} == pytest.approx(want)
    assert small == pytest.approx(want)
    # Candidates are read where they are: the plan has one scan and no exchange.
    assert "Exchange" not in ringed._jdf.queryExecution().executedPlan().toString()


def test_rings_skip_blocks_and_keep_the_maximum(spark, monkeypatch):
    """Anchors in tight groups: few of the blocks are read; vectors without a direction are found too."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    anchors = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=5) * 0.01]) for i in range(120)]
    cands = [(i, [float(x) for x in centres[i % 6] * 3 + rng.normal(size=5) * 0.01]) for i in range(60)]
    cands += [(100, [0.0] * 5), (101, [float(-x) for x in centres[0]])]
    schema = "vec_id bigint, embedding array<double>"
    seen, real = [], similarity.parquet.read_table
    a, c = np.array([v for _, v in anchors]), np.array([v for _, v in cands])
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
    for zero in (False, True):
        more = [*anchors, (999, [0.0] * 5)] if zero else anchors
        want = (norm(c) @ norm(np.array([v for _, v in more])).T).max(axis=1)
        frame, captured = spark.createDataFrame(cands, schema).coalesce(1), []
        monkeypatch.setattr(type(frame), "mapInArrow", lambda df, f, s, keep=type(frame).mapInArrow: (captured.append(f), keep(df, f, s))[1])
        got = similarity.max_anchor_cosine(frame, spark.createDataFrame(more, schema), "vec_id", "embedding", block=10, pivots=12)
        monkeypatch.undo()
        assert {r.vec_id: r.max_cos for r in got.collect()} == pytest.approx({k: w for (k, _), w in zip(cands, want)})
        # The task's function, run here on one group's candidates, to see which blocks it reads.
        seen.clear()
        monkeypatch.setattr(similarity.parquet, "read_table", lambda path, **kw: (seen.append(path), real(path, **kw))[1])
        group = [r for r in cands[:60] if r[0] % 6 == 2]
        batch = similarity.pa.RecordBatch.from_pydict({"vec_id": [k for k, _ in group], "embedding": [v for _, v in group]})
        list(captured[-1](iter([batch])))
        monkeypatch.undo()
        assert 1 <= len(seen) <= 5
    assert a.shape == (120, 5)

import random
import zlib

import numpy as np
import pytest

from civitext.llm.compression import (
    BLOCK,
    CompressionModel,
    difference_of,
    fit_compression,
    fit_curve,
    score_quality,
    train_dictionary,
)
from civitext.llm.queries import op13_quality_classifier

SF = "/root/testdata/sf0.01"


def prose(rng, words, n=150):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark):
    """Documents of two vocabularies, a third of them labelled, and the fitted model."""
    rng = random.Random(1)
    fine, junk = ([a + b for a in "bdfgklmn" for b in ends] for ends in (("aro", "eti", "olu"), ("x#", "%%", "q$!")))
    rows = [(i, prose(rng, fine if i % 3 else junk)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    return rows, docs, labels, fit_compression(docs, labels)


def test_classes_come_apart(made):
    rows, docs, _, model = made
    scored = {r["row"]["doc_id"]: r for r in score_quality(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.values())
    assert np.mean([scored[i]["predicted"] == (i % 3 > 0) for i, _ in rows]) > 0.99


def test_scores_do_not_depend_on_partitions_or_labels_of_the_held_out(made, spark):
    rows, docs, labels, model = made
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = [(r["doc_id"], 1 - r["quality"] if r["doc_id"] in held else r["quality"]) for r in labels.collect()]
    again = fit_compression(docs.repartition(7), spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert again == model


def test_sizes_are_those_of_whole_texts(made):
    import zstandard

    *_, model = made
    text = "naïve " * 3000 + "\ud800"
    data = text.encode("utf-8", "surrogatepass")
    sizes = []
    for d in (model.good, model.bad):
        made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(made.compress(data[at : at + BLOCK])) for at in range(0, len(data), BLOCK)))
    assert difference_of(text, model.good, model.bad) == (sizes[1] - sizes[0]) / sum(sizes)


def test_odd_rows(made, spark):
    *_, model = made
    schema = "doc_id long, text string, score string, row string"
    rows = [(None, None, "s", "r"), (1, "", None, None), (1, "", None, None), (2, " \n", "", ""), (3, "é" * 1_000_000, "", "")]
    got = score_quality(spark.createDataFrame(rows, schema), model).collect()
    assert sorted(r["row"]["doc_id"] or 0 for r in got) == [0, 1, 1, 2, 3]
    empty = {r["score"] for r in got if not r["row"]["text"]}
    assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(spark.createDataFrame([], schema), model).count() == 0


@pytest.mark.parametrize("known", [[], [(1, 1), (2, 1)], [(1, 0)], [(1, None), (None, 1)], [(1, 0), (1, 1)]])
def test_labels_that_teach_little(spark, known):
    docs = spark.createDataFrame([(1, "one text"), (2, "another text"), (None, None)], "doc_id long, text string")
    model = fit_compression(docs, spark.createDataFrame(known, "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in score_quality(docs, model).collect())


def test_a_key_that_holds_most_rows(spark):
    docs = spark.createDataFrame([(1, "junk ### junk")] * 500 + [(i, f"a plain text {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 60)], "doc_id long, quality int")
    assert score_quality(docs, fit_compression(docs, labels)).count() == 558


def test_curve():
    rng = np.random.default_rng(0)
    xs = rng.normal(size=4000)
    ys = (rng.random(4000) < 1 / (1 + np.exp(-(3 * xs + 0.5)))).astype(int)
    slope, shift = fit_curve(xs, ys)
    assert abs(slope - 3) < 0.3 and abs(shift - 0.5) < 0.15
    slope, _ = fit_curve(np.array([-1.0, 1.0]), np.array([0, 1]))  # classes that do not overlap
    assert 0 < slope < 100
    assert fit_curve(np.array([]), np.array([])) == (10.0, 0.0)


def test_few_samples_make_a_dictionary_as_they_are():
    assert train_dictionary([b"abc", b"def"], 4) == b"cdef"


def test_overflow_has_no_way_in():
    model = CompressionModel(b"", b"", 1e6, -800.0)
    assert model.score_of("") == 0.0 or 0 <= model.score_of("") < 1e-300


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op13_quality_classifier(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.9

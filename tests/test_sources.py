import gzip
import json

import pytest
from pyspark.sql import functions as F

from civitext import session
from civitext.plans import queries
from civitext.session import shared_dir, stage
from civitext.sources import comments, generated, splits, textlines
from civitext.streaming.cleaning import candidate_stream, start_cleaning


def lines(spark, path, **kw):
    rows = textlines.read_text_lines(spark, str(path), **kw).orderBy("line_no", "piece").collect()
    return [r.value for r in rows]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("é one\ntwo\n".encode(), ["é one", "two"]),
        (b"\xef\xbb\xbfone\r\ntwo", ["one", "two"]),
        (b"a \x93q\x94 \x85", ["a “q” …"]),
        (b"a \x81\x93", ["a \x81\x93"]),
        ("a\x0bb\x1cc d\re".encode(), ["a", "b", "c", "d", "e"]),
        (b"\n\nx\n", ["", "", "x"]),
    ],
)
def test_encodings_and_line_breaks(spark, tmp_path, raw, want):
    path = tmp_path / "f.txt"
    path.write_bytes(raw)
    assert lines(spark, path) == want


def test_blank_lines_can_be_left_out_and_large_files_split(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text(" a \n\n \nb", encoding="utf-8")
    assert lines(spark, path, keep_blank=False) == ["a", "b"]
    big = tmp_path / "big.txt"
    big.write_bytes(b"".join(b"line %d \xe9\n" % i for i in range(3_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = textlines.read_text_lines(spark, str(big)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.line_no, r.value) for r in rows) == [(i, f"line {i} é") for i in range(3_000)]


def test_text_is_neither_shuffled_nor_sorted(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"{n}.txt").write_text("".join(f"{n} line {i}\n" for i in range(50)))
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress("".join(f"z line {i} é\n" for i in range(2_000)).encode("cp1252")))
    read = textlines.read_text_lines(spark, str(tmp_path))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Sort" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan
    both = read.unionByName(read)  # a row's number does not depend on where the read stands in a plan
    names = {r.path.split("/")[-1] for r in both.collect()}
    assert names == {*(f"{n}.txt" for n in range(5)), "z.txt.gz"}
    assert all(r.value.endswith((f"line {r.line_no}", f"line {r.line_no} é")) for r in both.collect())


def test_files_cut_otherwise_fail(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("a\nb\nc\n" * 200)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = textlines.read_text_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        with pytest.raises(Exception, match="cut in another way"):
            read.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tag_order(spark, tmp_path):
    assert textlines.order_tags(["b", "nor", "a"]) == ["nor", "b", "a"]
    assert textlines.order_tags(["b", "a"]) == ["b", "a"]
    for tag in ("x", "nor"):
        (tmp_path / f"{tag}.txt").write_text(f"{tag} line\n")
    read = textlines.read_tagged(spark, {t: str(tmp_path / f"{t}.txt") for t in ("x", "nor")})
    assert sorted((r.tag_no, r.tag, r.value) for r in read.collect()) == [(0, "nor", "nor line"), (1, "x", "x line")]


def test_class_text_keeps_quotes_newlines_and_spaces(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", " padded ", "back\\slash", "comma, here"]
    df = spark.createDataFrame([("t", t) for t in texts], "tag string, text string")
    textlines.write_class_text(df, str(tmp_path / "out"))
    read = textlines.read_class_text(spark, str(tmp_path / "out")).collect()
    assert sorted(r.text for r in read) == sorted(texts) and {r.tag for r in read} == {"t"}


def test_class_text_files_are_bounded(spark, tmp_path):
    texts = [f'{i} "quoted" é' + "x" * (i % 40) for i in range(500)] + ["y" * 3_000, None, ""]
    df = spark.createDataFrame([("a" if i % 3 else "b", t) for i, t in enumerate(texts)], "tag string, text string").repartition(2)
    textlines.write_class_text(df, str(tmp_path / "out"), file_bytes=1_000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "out").rglob("part-*.csv"))
    assert len(sizes) > 20 and sizes[-2] <= 1_000 and 3_000 <= sizes[-1] <= 3_010
    read = textlines.read_class_text(spark, str(tmp_path / "out"))
    assert read.columns == ["text", "tag"] and {r.text for r in read.collect()} >= {t for t in texts if t}


def test_generated_object_and_missing_file(spark, tmp_path):
    path = tmp_path / "gen.json"
    path.write_text(json.dumps({"tweet": ["a b", "c\nd"], "class": ["0", "1"]}, indent=2))
    rows = generated.read_generated(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(0, "a b", "0"), (1, "c\nd", "1")]
    assert generated.read_generated(spark, str(tmp_path / "no.json")).count() == 0
    assert generated.read_generated_rows(spark, str(tmp_path / "no.json")).columns == ["tweet", "class"]


def test_comment_csv_and_fallback(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('comment_text,toxic,severe_toxic,obscene,threat,insult,identity_hate\n"a ""q""\nb",0,0,0,0,1,0\n')
    df = comments.read_comments(spark, str(path), "csv").withColumn("row_id", F.lit(1))
    used, rows = comments.labelled_or_flags(lambda: spark.read.parquet(str(tmp_path / "no")), lambda: df)
    assert used == "fallback" and [tuple(r) for r in rows.collect()] == [(1, 'a "q"\nb', 1)]


def test_splits_missing_then_cached(spark, tmp_path):
    path = str(tmp_path / "s")
    assert splits.load_splits(spark, path) is None
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "row_id int, split string")
    assert splits.load_or_compute(spark, path, lambda: df).count() == 3
    assert splits.load_or_compute(spark, path, lambda: df.limit(0)).count() == 3
    for s in splits.SPLITS:
        df.filter(F.col("split") == s).drop("split").write.parquet(str(tmp_path / "old" / f"{s}.parquet"))
    old = splits.load_splits(spark, str(tmp_path / "old"))
    assert sorted((r.row_id, r.split) for r in old.collect()) == [(1, "train"), (2, "val"), (3, "test")]


def test_staged_tables_live_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
    staged = stage(spark.range(3), "t")
    assert shared_dir(spark).split(":")[-1] in staged.inputFiles()[0]


def test_staged_tables_can_be_dropped(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    stage(spark.range(3), "t")
    assert list(tmp_path.iterdir())
    session.drop_staged(spark)
    assert not list((tmp_path / "civitext").iterdir())


def test_a_scope_deletes_what_was_staged_in_it(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    kept = stage(spark.range(3), "kept")
    with pytest.raises(RuntimeError), session.staging(spark):
        outer = stage(spark.range(4), "outer")
        with session.staging(spark):
            assert stage(spark.range(5), "inner").count() == 5
        assert outer.count() == 4 and len(list(tmp_path.rglob("inner-*"))) == 0
        raise RuntimeError
    assert kept.count() == 3 and len(list(tmp_path.rglob("outer-*"))) == 0


def test_stream_cleans_like_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a b c", "0"), ("a", "0"), ("unk unk a b", "1"), ("x y <UNK> z w", "1")]
    spark.createDataFrame(rows, "tweet string, class string").write.json(str(src))
    query = start_cleaning(
        candidate_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.reason, r.cleaned) for r in got if r.cleaned) == [("kept", "a b c"), ("kept", "x y z w")]
    assert sorted(r.reason for r in got) == ["high_unk", "kept", "kept", "too_short"]


def test_every_query_is_registered_once():
    assert len(queries.QUERIES) > 60

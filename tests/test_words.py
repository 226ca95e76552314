import random

import pytest
from pyspark.sql import functions as F

from civitext.operators import common, encoding, vocabulary
from civitext.plans.corpus import build_corpus, corpus_job
from civitext.schemas import SPECIALS_A
from civitext.sources import tokens as token_files

LINES = [
    (0, 0, "The cat, the dog."),
    (0, 1, "a cat a dog a bird"),
    (1, 0, "word " * 19),
    (1, 1, "word " * 18),
    (2, 0, "THE cat"),
    (2, 1, "single"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(LINES, "doc_id bigint, line_no int, text string")
    return build_corpus(df, ["doc_id", "line_no"])


def test_vocabulary_a(corpus):
    ids = {r.word: r.id for r in corpus.vocab.collect()}
    # "dog" and "bird" are too rare; the order is that of first sight.
    assert ids == {**{s: i for i, s in enumerate(SPECIALS_A)}, "the": 4, "cat": 5, "a": 6, "word": 7}


def test_encoding_lengths_and_unknown_words(corpus):
    rows = {(r.doc_id, r.line_no): r.ids for r in corpus.encoded.collect()}
    assert rows == {
        (0, 0): [4, 5, 4, 3, 2],
        (0, 1): [6, 5, 6, 3, 6, 3, 2],
        (1, 0): [7] * 19 + [2],
        (1, 1): [7] * 18 + [2],
        (2, 0): [4, 5, 2],
    }
    n = {k: len(v) - 1 for k, v in rows.items()}
    assert max(n.values()) == 19 and min(n.values()) == 2


def test_decoding(spark, corpus):
    df = spark.createDataFrame(
        [(1, [1, 4, 5, 99, 2, 6, 0]), (2, [0, 0]), (3, [4, 0, 3])], "k int, ids array<int>"
    )
    def texts(decode):
        return {r.k: r.text for r in decode(df, corpus.vocab, ["k"]).collect()}

    assert texts(encoding.decode_tokens) == {1: "the cat <UNK>", 2: "<PAD> <PAD>", 3: "the <PAD> <UNK>"}
    assert texts(encoding.decode_sample) == {1: "the cat", 2: "", 3: "the <UNK>"}
    assert texts(encoding.decode_keep_eos) == {1: "the cat <UNK> <EOS> a", 2: "", 3: "the <UNK>"}


def test_large_vocabulary_path_gives_the_same(spark, corpus, monkeypatch):
    want = sorted(map(tuple, corpus.encoded.select("doc_id", "line_no", F.col("ids").cast("string")).collect()))
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", 5)
    built = build_corpus(corpus.tokens.select("doc_id", "line_no", F.array_join("tokens", " ").alias("text")), corpus.keys)
    got = built.encoded.select("doc_id", "line_no", F.col("ids").cast("string"))
    assert sorted(map(tuple, got.collect())) == want
    decoded = encoding.decode_tokens(built.encoded, built.vocab, corpus.keys)
    assert {r.text for r in decoded.filter("doc_id = 2").collect()} == {"the cat"}


def test_encoding_shuffles_once(corpus):
    plan = corpus.encoded.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_vocabulary_b_ties_and_floor(spark):
    df = spark.createDataFrame([(0, "b a b c"), (1, "a d c e")], "doc_id int, text string")
    words = F.split("text", " ")
    ids = {r.word: r.id for r in vocabulary.vocab_topk(df, words, "doc_id").collect()}
    assert ids == {"<PAD>": 0, "<UNK>": 1, "b": 2, "a": 3, "c": 4}
    top = {r.word for r in vocabulary.vocab_topk(df, words, "doc_id", k=1).collect()}
    assert top == {"<PAD>", "<UNK>", "b"}


def test_vocabulary_file_round_trip(spark, corpus, tmp_path):
    path = str(tmp_path / "vocab")
    token_files.write_vocab_text(corpus.vocab, path)
    assert sorted(map(tuple, token_files.read_vocab_text(spark, path).collect())) == sorted(
        (r.word, r.id) for r in corpus.vocab.collect()
    )


def test_class_files_to_id_files(spark, tmp_path):
    (tmp_path / "nor.txt").write_text("good day all\ngood day\n", encoding="utf-8")
    (tmp_path / "toxic.txt").write_bytes("good \x93day\x94 \xe9".encode("latin-1"))
    files = {"toxic": str(tmp_path / "toxic.txt"), "nor": str(tmp_path / "nor.txt")}
    corpus_job(spark, files, str(tmp_path / "out"))
    read = token_files.read_token_ids(spark, str(tmp_path / "out" / "ids"))
    assert sorted((r.tag, r.ids) for r in read.collect()) == [
        ("nor", [4, 5, 2]), ("nor", [4, 5, 3, 2]), ("toxic", [4, 5, 2]),
    ]
    vocab = {r.word: r.id for r in token_files.read_vocab_text(spark, str(tmp_path / "out" / "vocab")).collect()}
    assert vocab["good"] == 4 and vocab["day"] == 5 and len(vocab) == 6


def test_first_seen_places_are_hashed(spark):
    df = spark.createDataFrame([(1, 2, ["b", "a"]), (1, 1, ["a", "c", "a"]), (-5, 9, ["c"])], "d long, n int, t array<string>")
    counts = vocabulary.first_seen_counts(df, F.col("t"), "d", "n")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert [(r.word, r.n) for r in counts.orderBy("first").collect()] == [("c", 2), ("a", 3), ("b", 1)]
    by_name = vocabulary.first_seen_counts(df.withColumn("d", F.col("d").cast("string")), F.col("t"), "d", "n")
    assert [r.word for r in by_name.orderBy("first").collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("kinds", [("bigint", "int"), ("int", "smallint"), ("tinyint",), ("int", "bigint"), ("bigint", "bigint"), ("string", "int")])
def test_packed_keys_keep_their_order(spark, kinds):
    rng = random.Random(1)
    bits = {"bigint": 63, "int": 31, "smallint": 15, "tinyint": 7, "string": 31}
    ends = {k: [-(1 << b), (1 << b) - 1, 0, -1, 1] for k, b in bits.items()}
    rows = [tuple(rng.choice((*ends[k], rng.randrange(-(1 << bits[k]), 1 << bits[k]))) for k in kinds) for _ in range(200)]
    df = spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"c{i} string" for i in range(len(kinds))))
    df = df.select(*[F.col(f"c{i}").cast(k).alias(f"c{i}") for i, k in enumerate(kinds)])
    names = df.columns
    got = [tuple(r)[:-1] for r in df.withColumn("p", common.packed(df, names)).orderBy("p").collect()]
    assert got == [tuple(r) for r in df.orderBy(*names).collect()]


def test_large_vocabulary_computes_its_items_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        seen.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, f"w{i % 40} w{i % 7} out") for i in range(200)], "k long, text string")
    items = docs.select("k", F.posexplode(counted("text")).alias("pos", "word"))
    table = spark.createDataFrame([(f"w{i}", i) for i in range(40)], "word string, id long")
    found = encoding.look_up(items, table, "word", "id", head_rows=5)
    got = {(r.k, r.pos): r.id for r in found.collect()}
    assert got == {(i, p): v for i in range(200) for p, v in enumerate((i % 40, i % 7, None))}
    assert seen.value == 200


def test_cut_encoding_has_true_lengths(spark):
    df = spark.createDataFrame([(1, ["a", "b", "z"]), (2, []), (3, ["b"] * 9), (4, None)], "k int, tokens array<string>")
    vocab = spark.createDataFrame([("<PAD>", 0), ("<UNK>", 1), ("a", 2), ("b", 3)], "word string, id long")
    got = {r.k: (r.ids, r.length) for r in encoding.encode_cut(df, vocab, ["k"], max_len=4).collect()}
    assert got == {1: ([2, 3, 1, 0], 3), 2: ([0] * 4, 0), 3: ([3] * 4, 4), 4: ([0] * 4, 0)}

from pyspark.sql import functions as F

from civitext.functions import text as X


def one(spark, value, *exprs):
    df = spark.createDataFrame([(value,)], "t string")
    return tuple(df.select(*[e(F.col("t")).alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[1] for r in df.select("i", expr(F.col("t")).alias("c")).orderBy("i").collect()]


def test_whitespace_is_pythons(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert len(spaces) == 29
    blank = "".join(spaces)
    text = blank + ("x" + blank + "y").join(["", ""]) + blank
    nonblank, stripped, words, squeezed = one(spark, text, X.is_nonblank, X.strip, X.words, X.squeeze)
    assert nonblank and stripped == text.strip() and words == text.split() and squeezed == "x y"
    assert column(spark, [blank, None, "", "​"], X.is_nonblank) == [False, False, False, True]


def test_letters_and_contractions(spark):
    assert one(spark, " I Cannot,\t do 2 it-now! ", X.letters_only) == ("i cannot do it now",)
    assert one(spark, "I cannot; Wanna gotta scannot", X.letter_words) == (
        ["i", "can", "not", "wan", "na", "got", "ta", "scannot"],
    )
    assert one(spark, "cannot", lambda c: X.letter_words(c, split_contractions=False)) == (["cannot"],)
    assert column(spark, ["", "123 !", None], X.letter_words) == [[], [], None]


def test_straighten_and_wordpunct(spark):
    assert one(spark, " ‘a’ \n “b”  ", X.straighten) == ("'a' \"b\"",)
    assert one(spark, "Don’t stop... é_1 (ok)", X.wordpunct) == (
        ["don", "'", "t", "stop", "...", "é_1", "(", "ok", ")"],
    )


def test_sanitize(spark):
    cases = {
        "Example 12: - hello there": "hello there",
        "OUTPUT - * > 'hi' ": "hi",
        "example x: no": "example x: no",
        " \"`quoted`\" ": "quoted",
        "-* > text\nnext": "text next",
    }
    assert column(spark, list(cases), X.sanitize_line) == list(cases.values())


def test_good_neutral(spark):
    good = ["this is fine", "words and 123", "redirecting this text now"]
    bad = [
        "a b", "ab c", "one two", "word " * 21, "redirect to another page", "a | b is here", "see {{this here", "see this}} here",
        "see [[this here", "see this]] here", "go http://x now", "go https://x now", "at www.site here now",
        "Talk: about this thing", "category: some things here", "Template: one two", "file: one two three",
        "USER: one two three", "name = one two three", "12 34 56 ab", None, "",
    ]
    assert column(spark, good + bad, X.is_good_neutral) == [True] * len(good) + [False] * len(bad)
    # Eleven letters in twenty characters are exactly the least share.
    edge = ["abcdefghijk 1234 567", "abcdefghij1 1234 567"]
    assert column(spark, edge, X.is_good_neutral) == [True, False]


def test_sentences_and_bigrams(spark):
    assert one(spark, "One. Two!  Three?no 4.", X.sentences_of) == (["One.", "Two!", "Three?no 4."],)
    assert one(spark, "A bc, de fg", lambda c: X.with_bigrams(X.ngram_terms(c))) == (
        ["bc", "de", "fg", "bc de", "de fg"],
    )
    assert column(spark, ["", "ab", "a"], lambda c: X.with_bigrams(X.ngram_terms(c))) == [[], ["ab"], []]

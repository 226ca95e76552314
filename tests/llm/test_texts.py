import math
import os
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from civitext.llm import toxicity
from civitext.llm.licenses import LICENCES, MIT, known_digests, scan_licenses
from civitext.llm.quality import BUCKETS, base_figures, bucket_counts, judge_quality
from civitext.llm.toxicity import fit_toxicity, fold_of, score_toxicity
from civitext.llm.urls import RULES, SOFT, SOFT_LIMIT, STRICT, judge_urls

# --- quality rules


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


TEXTS = [
    None, "", "  \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b\n\na b\n a b\na b", "#*$% &|<> ##",
    "\u00a0nbsp is\u00a0no space\u2003here \U0001f600 \u00e9\u00c9", "line\r\nline\r\nline\r", "the end of the line. " * 30,
    " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 60}" for i in range(120)), "one two three " * 70_000,
    " ".join(f"v{i % 40} v{i % 41} u{i}" for i in range(400)),
]


def test_base_figures_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in base_figures(docs).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(TEXTS)}


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def slow_grams(text):
    tokens = regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+", (text or "").lower())
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    pairs = [
        xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        for a, b in zip(hashes, hashes[1:])
    ]
    return [_signed(h) % BUCKETS for h in hashes + pairs]


def test_scores_match_brute_force(spark):
    good = [" ".join(f"good{(i * k) % 23}" for k in range(60)) for i in range(20)]
    bad = [" ".join(f"bad{(i + k) % 11} !!" for k in range(60)) for i in range(8)]
    rows = [(i, t, "extra") for i, t in enumerate([*good, *bad, None, "", "good1"])]
    rows += [(None, good[3], "x"), (4, good[4], "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    trusted = spark.createDataFrame([(i,) for i in range(15)] + [(None,), (3,)], "doc_id long")
    raw, own = Counter(), Counter()
    for key, text, _ in rows:
        raw.update(slow_grams(text))
        if key is not None and key < 15:
            own.update(slow_grams(text))
    n, m = sum(raw.values()) + BUCKETS, sum(own.values()) + BUCKETS

    def score(text):
        g = slow_grams(text)
        return sum(math.log((own[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in g) / len(g) if g else 0.0

    got = judge_quality(docs, trusted).select("row.doc_id", "row.text", "score", "kept", "base_failed").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(score(r["text"]), abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.1)
    assert judge_quality(docs.limit(0), trusted).count() == 0


def test_ngrams_are_counted_in_compiled_code(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (2, "a b"), (None, "a")], "doc_id long, text string")
    counted = bucket_counts(docs, spark.createDataFrame([(2,)], "doc_id long"))
    rows = {r["bucket"]: (r["n"], r["own"]) for r in counted.collect()}
    every, own = Counter(slow_grams("a b a") + slow_grams("a b") + slow_grams("a")), Counter(slow_grams("a b"))
    assert rows == {b: (n, own[b]) for b, n in every.items()}
    plan = counted._jdf.queryExecution().executedPlan().toString().splitlines()
    first, below = next((i, line) for i, line in enumerate(plan) if re.search(r"\bGenerate explode\(", line))
    partial = max(i for i, line in enumerate(plan[:first]) if "HashAggregate" in line)
    # Rows between the exploding generator and the partial counts carry one codegen mark: they are one loop.
    stages = {re.search(r"\*\((\d+)\)", line)[1] if "*(" in line else None for line in plan[partial : first + 1]}
    assert len(stages) == 1 and None not in stages and "lambda" not in below


# --- licences


def test_licences_in_all_their_spellings(spark):
    known = known_digests(spark)
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + MIT),
        (2, MIT.upper().replace("COPYRIGHT HOLDERS", "copyright   owners").replace("\n", " ")),
        (3, MIT + " And more."),
        (4, "Some words.\n  released under the MIT LICENCE!\nMore."),
        (4, "Some words.\n  released under the MIT LICENCE!\nMore."),
        (5, "Licensed under the Apache License, Version 2.0"),
        (6, None),
        (7, ""),
        (None, "Licensed under CC BY-NC 4.0.\n\u00a9 2021 Somebody"),
        (8, "it was released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r)[:4] for r in scan_licenses(docs, known).collect())))
    want = [(1, "text", None, "MIT"), (2, "text", None, "MIT"), (2, "line", 0, "MIT"), (4, "line", 1, "MIT"), (4, "line", 1, "MIT"),
            (5, "text", None, "Apache-2.0"), (5, "line", 0, "Apache-2.0"), (None, "text", None, "CC-BY-NC-4.0"), (None, "line", 0, "CC-BY-NC-4.0")]
    want = [w for w in want if w[0] != 2]
    assert [g for g in got if not g.startswith("(2,")] == sorted(map(str, want))
    assert known.count() <= len(LICENCES) and scan_licenses(docs.limit(0), known).count() == 0


# --- URL filter


def slow_url(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fit:
        best = max(fit, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]

    def hit(term):
        return re.search(rf"(?<![^\W_]){re.escape(term)}(?![^\W_])", url.lower())

    bad = any(map(hit, STRICT)) or sum(w for t, w in SOFT.items() if hit(t)) >= SOFT_LIMIT
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM/en/1", "http://www.example.com/en/x?y", "http://example.com/EN/",
    "https://x.net/es/", "https://x.net/es", "https://net/fr/#", "http://xnet/es/", "a://b.org?c://d.com/", "http://b.org#/x",
    "http://spam-farm.org/", "http://spamfarm.org/", "http://cheap-pills.org", "http://cheap.org/cheap", "http://free-bets.de/x",
    "http://b.org/casino_win", "http://b.org/q?x=porn", "http://b.org/essex", "http://b.org/\n/x", "http://É.org/sex", "http://Ésex.org",
]


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, u) for i, u in enumerate(URLS)] + [(None, URLS[6], "x"), (6, URLS[6], "x")], "page_id long, url string, host string")
    got = judge_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[6 if r["page_id"] is None else r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_url(url), url
    assert judge_urls(pages.limit(0)).count() == 0


# --- toxicity


def labelled(spark, n=400):
    import random

    rng = random.Random(2)
    plain = ["water", "garden", "letter", "morning", "window", "paper", "street", "music"]
    rude = ["blorgst", "zzuck", "krattig"]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(8, 60))]
        if toxic := i % 4 == 0:
            for _ in range(1 + len(words) // 12):
                words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "s", "en"]))
        rows.append((i, " ".join(words).capitalize() + ".", "x"))
        marks.append((i, int(toxic)))
    extra = [(None, "water garden", "x"), (n, "", "x"), (n + 1, None, "x"), (n + 2, "...", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, row string")
    return docs, spark.createDataFrame([*marks, (None, 1), (3, None), (3, 0), (n, 1)], "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, marks = labelled(spark)
    model = fit_toxicity(docs, marks)
    got = score_toxicity(docs, model)
    assert got.count() == docs.count() and got.select("row.*").columns == docs.columns
    rows = got.select("row.doc_id", "score", "predicted", (fold_of(F.col("row.doc_id")) == 0).alias("held")).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    blank = {r["score"] for r in rows if r["doc_id"] in (400, 401, 402)}
    assert blank == {model.prior} and score_toxicity(docs.limit(0), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs, marks = labelled(spark, 20)
    got = score_toxicity(docs, fit_toxicity(docs, marks.limit(0)))
    assert {r["predicted"] for r in got.collect()} == {0}


def test_held_out_recall_per_language(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rated = score_toxicity(docs, fit_toxicity(docs, marks)).select("row.doc_id", "row.lang", "predicted")
    held = rated.join(marks.select("doc_id", "toxic"), "doc_id").filter(fold_of(F.col("doc_id")) == 0).collect()
    found = {lang: [r["predicted"] for r in held if r["lang"] == lang and r["toxic"] == 1] for lang in ("en", "de", "fr", "es")}
    share = {lang: sum(p) / len(p) for lang, p in found.items()}
    assert share["en"] >= 0.85 and min(share["de"], share["fr"], share["es"]) >= 0.25, share
    assert sum(r["predicted"] for r in held if r["toxic"] == 0) <= 0.01 * len(held)


def test_joined_starts_score_as_broadcast_ones(spark):
    docs, marks = labelled(spark)

    def scores(**bound):
        model = fit_toxicity(docs, marks, **bound)
        rows = score_toxicity(docs, model).select("row.doc_id", "row.text", "score").collect()
        return model.words, sorted((str(r["doc_id"]), str(r["text"]), r["score"]) for r in rows)

    words, want = scores()
    assert words.tail is None
    starts = len(words.head)
    words, got = scores(head_starts=10)
    assert len(words.head) <= 10 and words.tail.count() == starts - len(words.head) > 50
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-5)


def slow_shared(keys):
    """P(last symbol | the symbols before) for tuples of symbols `keys`, by continuation counts."""
    levels = [Counter(keys)]
    while len(next(iter(levels[-1]))) > 1:
        levels.append(Counter(k[1:] for k in levels[-1]))

    def p(key):
        counts = levels[len(next(iter(levels[0]))) - len(key)]
        if len(key) == 1:
            return counts[key] / sum(counts.values())
        same = {k: n for k, n in counts.items() if k[:-1] == key[:-1]}
        total = sum(same.values())
        return (max(counts[key] - 0.75, 0) + 0.75 * len(same) * p(key[1:])) / total

    return p


def slow_class(counts, context, symbol, below):
    """P(symbol | context) of counts {(context, symbol): n} after discount, and the share left for `below`."""
    same = {k: n for k, n in counts.items() if k[0] == context and n}
    total = sum(same.values())
    if not total:
        return below, 1.0
    left = 0.75 * len(same) / total
    return max(counts.get((context, symbol), 0) - 0.75, 0) / total + left * below, left


RATED = [
    ("the cat sat on the mat", 0), ("a vile cat, a vile mat!", 1), ("vilest the the 42 mats", 1), ("sat sat on mats", 0),
    ("\u00e9t\u00e9 cat on", 0), ("vile vilest \u00e9t\u00e9", 1),
]


def test_gram_ratios_match_brute_force():
    grams = {label: Counter(g for t, y in RATED if y == label for g in toxicity.grams_of(t).tolist()) for label in (0, 1)}
    every = sorted(set(grams[0]) | set(grams[1]))
    counts = tuple(np.array([grams[c][g] for g in every]) for c in (0, 1))
    model = toxicity._model_of(np.array(every), counts)

    def symbols(g):
        return tuple(g >> shift & 63 for shift in (18, 12, 6, 0))

    shared = slow_shared([symbols(g)[1:] for g in every])
    for g, ratio in zip(every, model.ratios):
        s = symbols(g)
        ps = [slow_class({(symbols(k)[:3], symbols(k)[3]): n for k, n in grams[c].items()}, s[:3], s[3], shared(s[1:]))[0] for c in (1, 0)]
        assert math.log(ps[0] / ps[1]) == pytest.approx(ratio, abs=1e-5)


def test_groups_of_texts_have_the_features_of_single_ones(monkeypatch):
    rng, words = np.random.default_rng(3), ["one", "two", "thr\u00e9\u00e9", "4", "a-b", "Five!"]
    texts = [None, "", "x", " . ", *(" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(40)), "seven " * 500]
    keys = np.unique(np.concatenate([toxicity.starts_in(w.encode() + b" ")[0] for w in ("one", "two", "threx", "five")]))
    head = toxicity._Values(keys, rng.normal(size=len(keys)).astype(np.float32))
    row_of = rng.integers(0, 3, toxicity.GRAM_SPACE >> toxicity.SYMBOL_BITS).astype(np.int32)
    rows = rng.normal(size=3 * 64).astype(np.float32)
    single = np.concatenate([np.c_[toxicity.gram_features([t], row_of, rows), toxicity.word_features([t], head)[0]] for t in texts])
    for size in (1 << 16, 100):
        monkeypatch.setattr(toxicity, "_WORDS", size)
        groups = list(toxicity._grouped(toxicity.pa.array(texts)))
        assert [t for g in groups for t in g] == texts
        got = [np.c_[toxicity.gram_features(g, row_of, rows), toxicity.word_features(g, head)[0]] for g in groups]
        assert np.concatenate(got) == pytest.approx(single)
    grams = toxicity.grams_of(texts[20])
    ratios = rows[row_of[grams >> 6] * 64 + (grams & 63)]
    assert single[20, :3] == pytest.approx([ratios.mean(), np.maximum(ratios - 1, 0).mean(), len(grams) ** -0.5], abs=1e-6)


def test_word_ratios_match_brute_force(spark):
    read = spark.createDataFrame(RATED, "text string, toxic int").repartition(2)
    words = toxicity._word_model(read)
    counts = {0: Counter(), 1: Counter()}
    for text, label in RATED:
        for word in re.findall(r"[^\W_]+", text.lower()):
            raw = word.encode() + b" "
            counts[label].update(raw[: i + 1] for i in range(len(raw)))
    kept = {s for s in counts[0] | counts[1] if counts[0][s] + counts[1][s] >= toxicity.LEAST_SEEN}
    assert len(kept) == len(words.head)

    def low(start):
        last = [toxicity._symbol(b) for b in start[-3:]]
        return tuple([0] * (3 - len(last)) + last)

    shared = slow_shared([low(s) for s in kept])
    tables = {c: {(s[:-1], s[-1:]): counts[c][s] for s in kept} for c in (0, 1)}
    tables[2] = {k: tables[0][k] + tables[1][k] for k in tables[0]}

    def ratio(word):
        total, raw = 0.0, word.encode() + b" "
        for i in range(len(raw)):
            context, symbol = raw[:i], raw[i : i + 1]
            if raw[: i + 1] not in kept:
                if i:
                    left = [slow_class(tables[c], context, b"", 0.0)[1] for c in (1, 0)]
                    total += math.log(left[0] / left[1])
                break
            pooled = slow_class(tables[2], context, symbol, shared(low(raw[: i + 1])))[0]
            ps = [slow_class(tables[c], context, symbol, pooled)[0] for c in (1, 0)]
            total += math.log(ps[0] / ps[1])
        return total

    for word in ("vile", "vilest", "vilified", "the", "cat", "mats", "zebra", "\u00e9t\u00e9", "42"):
        got, _ = toxicity.word_features([word, None, f"{word} the", "."], words.head)
        assert got[:, 2].tolist() == [1, 0, 2, 0] and got[[1, 3], :2].any() == False  # noqa: E712
        assert got[[0, 2], 0] == pytest.approx([ratio(word), ratio(word) + ratio("the")], abs=1e-5), word

"""The registered queries: (spark, sf_dir) -> DataFrame, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.functions import scores, sequences, text
from civitext.operators import (
    adapters,
    augmentation,
    classifier,
    cleaning,
    encoding,
    labels,
    metrics,
    neutral_pool,
    pool_cycle,
    sampling,
    similarity,
    splitting,
    tfidf,
    vocabulary,
)
from civitext.plans import corpus as corpus_plan
from civitext.plans import experiment
from civitext.plans import inputs as src
from civitext.plans.inputs import FLAG_COLUMNS, LINE_KEYS, big, table
from civitext.session import stage, stage_path
from civitext.sources import comments, generated, reports, splits, textlines, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROLES = ["system", "user", "assistant"]
QUERY_CAPS = {"train": 50, "val": 5, "test": 5}
QUERY_SAMPLE = 50
QUERY_FALLBACK = 100
UNSEEN_ID = 1_000_000_000
# An ellipsis and a low quote.
SIGNS = "\u2026\u201a"
# Digits that scores of fixed models are rounded to before they are compared.
SCORE_DIGITS = 6
GENERATIONS = 2
# Slopes of a fitted model, over the number of training rows, below which it is at its optimum.
FLAT = 1e-5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(col, name: str):
    return F.round(col, 6).alias(name)


# --- scans, sources, sinks -------------------------------------------------


@query
def scan_labelled(spark, sf):
    docs = comments.read_comments(spark, f"{sf}/documents.parquet")
    docs = docs.select("doc_id", F.length("text").cast("bigint").alias("text_length"))
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text_length", big("toxic"), big("quality")
    )


@query
def scan_fallback(spark, sf):
    flags = src.flagged(spark, sf)
    ready = flags.withColumn("label", F.col("toxic"))

    def report(case, primary):
        used, rows = comments.labelled_or_flags(
            primary, lambda: flags, flags=FLAG_COLUMNS, key="doc_id"
        )
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives")).select(
            F.lit(case).alias("case"), F.lit(used).alias("source"), "rows", "positives"
        )

    missing = f"{sf}/no_such_table.parquet"
    return (
        report("with_label", lambda: ready)
        .unionByName(report("without_label", lambda: flags))
        .unionByName(report("missing", lambda: spark.read.parquet(missing)))
    )


@query
def split_roundtrip(spark, sf):
    path = stage_path(spark, "splits")
    first = splits.load_or_compute(spark, path, lambda: src.split_texts(spark, sf))
    again = splits.load_or_compute(spark, path, lambda: first.limit(0))
    return splitting.split_counts(again).select("split", big("label"), "rows")


@query
def gen_json_roundtrip(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("row_id"), F.col("role").alias("tag"), "text"
    )
    flat, arrays = stage_path(spark, "generated"), stage_path(spark, "generated")
    generated.write_generated(rows, flat, ROLES)
    generated.write_generated_columns(rows, arrays, ROLES)
    read = [
        generated.read_generated_rows(spark, flat).select(F.lit("rows").alias("form"), "tweet", "class"),
        generated.read_generated(spark, arrays, multi_line=False).select(
            F.lit("columns").alias("form"), "tweet", "class"
        ),
    ]
    both = reduce(DataFrame.unionByName, read)
    return both.groupBy("form", "class", F.md5("tweet").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query
def read_text_robust(spark, sf):
    docs = src.texts(spark, sf).select("text")
    paths = {name: stage_path(spark, name) for name in ("utf8", "latin", "windows")}
    docs.write.text(paths["utf8"])
    one_byte = docs.filter(~F.col("text").rlike(r"[^\x00-\xff]"))
    one_byte.select(F.encode("text", "ISO-8859-1").cast("string").alias("value")).write.text(paths["latin"])
    # Signs that only the Windows code page has, as the bytes it has them at.
    signs = one_byte.filter(~F.col("text").rlike(r"[\x80-\x9f]")).select(F.translate("text", ".,", SIGNS).alias("text"))
    as_bytes = F.encode(F.translate("text", textlines.C1_TO, textlines.C1_FROM), "ISO-8859-1")
    signs.select(as_bytes.cast("string").alias("value")).write.text(paths["windows"])
    parts = [
        textlines.read_text_lines(spark, path).select(F.lit(name).alias("encoding"), "value")
        for name, path in paths.items()
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("encoding", F.md5("value").alias("line_md5"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def tagged_lines(spark, sf):
    path = stage_path(spark, "tagged")
    rows = table(spark, sf, "conversations")
    rows.select("role", F.col("text").alias("value")).write.partitionBy("role").text(path)
    files = {role: f"{path}/role={role}" for role in ["user", "assistant", "system"]}
    read = textlines.read_tagged(spark, files, neutral="system", keep_blank=True)
    return read.groupBy("tag", big("tag_no")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(text.is_nonblank(F.col("value"))).alias("nonblank_lines")
    )


def _exported(spark, sf):
    path = stage_path(spark, "classes")
    textlines.write_class_text(labels.class_table(src.flagged(spark, sf), FLAG_COLUMNS, FLAG_COLUMNS), path)
    return textlines.read_class_text(spark, path)


@query
def class_export(spark, sf):
    return _exported(spark, sf).groupBy("tag", F.md5("text").alias("text_md5")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def class_counts(spark, sf):
    return labels.tag_counts(_exported(spark, sf))


@query
def token_ids_roundtrip(spark, sf):
    built = src.corpus(spark, sf)
    langs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("tag"))
    path = stage_path(spark, "ids")
    tokens.write_token_ids(built.encoded.join(langs, "doc_id"), path)
    read = tokens.read_token_ids(spark, path)
    return read.groupBy("tag", sequences.ids_to_text(F.col("ids")).alias("ids")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def vocab_roundtrip(spark, sf):
    path = stage_path(spark, "vocab_text")
    tokens.write_vocab_text(src.corpus(spark, sf).vocab, path)
    return tokens.read_vocab_text(spark, path).select(big("id"), "word")


# --- projections, filters --------------------------------------------------


@query
def binary_label(spark, sf):
    rows = labels.binary_labels(src.flagged(spark, sf), FLAG_COLUMNS, key="doc_id")
    return rows.select("doc_id", big("label"))


@query
def class_rows(spark, sf):
    rows = labels.per_class(src.flagged(spark, sf), FLAG_COLUMNS, carry=("doc_id",))
    return rows.select("tag", "doc_id")


@query
def nonblank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bare = docs.withColumn("text", F.regexp_replace("text", f"[^{text.WS}]+", " "))
    rows = docs.withColumn("variant", F.lit("whole")).unionByName(bare.withColumn("variant", F.lit("bare")))
    return labels.nonblank(rows).select("doc_id", "variant")


@query
def neutral_subset(spark, sf):
    return labels.neutral_rows(src.flagged(spark, sf), FLAG_COLUMNS).select("doc_id")


@query
def adapt_threeway(spark, sf):
    posts = src.lines(spark, sf).withColumnRenamed("text", "tweet")
    posts = posts.withColumn("class", ((F.col("doc_id") + F.col("line_no")) % 4 - 1).cast("int"))
    rows = adapters.adapt("three_way", posts, carry=tuple(LINE_KEYS))
    return rows.select("doc_id", big("line_no"), big("label"))


@query
def adapt_annotated(spark, sf):
    posts = src.annotated_posts(spark, sf)
    rows = adapters.adapt("annotated", posts, carry=("conv_id", "turn"))
    return rows.select("conv_id", "turn", big("label"), F.md5("text").alias("text_md5"))


@query
def clean_reasons(spark, sf):
    sents = src.sentences(spark, sf).withColumnRenamed("sent_no", "item_no")
    decoded = src.round_trip(spark, sf).withColumnRenamed("line_no", "item_no")
    parts = [
        cleaning.with_cleaning(df).select(
            F.lit(name).alias("source"), "doc_id", big("item_no"), F.coalesce("reason", F.lit("kept")).alias("reason")
        )
        for name, df in (("sentences", sents), ("decoded", decoded))
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def clean_generated(spark, sf):
    return cleaning.clean_generated(src.round_trip(spark, sf)).select("doc_id", big("line_no"), "text")


@query
def clean_report(spark, sf):
    report = cleaning.clean_report(cleaning.with_cleaning(src.round_trip(spark, sf)))
    return report.select("reason", "n", r6(F.col("share"), "share"))


@query
def encode_tokens(spark, sf):
    return src.corpus(spark, sf).encoded.select(
        "doc_id", big("line_no"), sequences.ids_to_text(F.col("ids")).alias("ids")
    )


@query
def encode_framed(spark, sf):
    built = src.corpus(spark, sf)
    framed = corpus_plan.encode_framed(built.tokens, built.vocab, LINE_KEYS)
    return framed.select("doc_id", big("line_no"), sequences.ids_to_text(F.col("ids")).alias("ids"))


@query
def encode_cut(spark, sf):
    docs = src.texts(spark, sf).select("doc_id", text.words(F.lower("text")).alias("tokens"))
    vocab = stage(vocabulary.vocab_topk(docs, F.col("tokens"), "doc_id"), "vocab")
    coded = encoding.encode_cut(docs, vocab, ["doc_id"])
    return coded.select("doc_id", sequences.ids_to_text(F.col("ids")).alias("ids"), big("length"))


@query
def neutral_candidates(spark, sf):
    pages = src.texts(spark, sf, "pages", "page_id", "html").toDF("doc_id", "text")
    page_lines = src.exploded(pages, ["doc_id"], text.lines_of(F.col("text")), "line_no", "text")
    parts = [
        df.select(
            F.lit(name).alias("source"),
            "doc_id",
            big("line_no"),
            text.is_good_neutral(F.col("text")).cast("bigint").alias("ok"),
        )
        for name, df in (("documents", src.lines(spark, sf)), ("pages", page_lines))
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def quick_cap(spark, sf):
    return sampling.quick_cap(src.split_rows(spark, sf), QUERY_CAPS, "doc_id").select("split", "doc_id")


# --- lookups ---------------------------------------------------------------


def _padded(spark, sf):
    """Framed, padded sequences; every third line starts with an id outside the vocabulary."""
    built = src.corpus(spark, sf)
    framed = F.concat(F.array(F.lit(1)), F.col("ids"))
    framed = F.when(F.col("line_no") % 3 == 0, F.concat(F.array(F.lit(UNSEEN_ID)), framed)).otherwise(framed)
    return built, built.encoded.withColumn("ids", sequences.pad(framed, 24))


def _decoded(spark, sf, decode):
    built, ids = _padded(spark, sf)
    return decode(ids, built.vocab, LINE_KEYS).select("doc_id", big("line_no"), "text")


@query
def decode_tokens(spark, sf):
    return _decoded(spark, sf, encoding.decode_tokens)


@query
def decode_sample(spark, sf):
    return _decoded(spark, sf, encoding.decode_sample)


@query
def decode_keep_eos(spark, sf):
    return _decoded(spark, sf, encoding.decode_keep_eos)


@query
def fallback_pool(spark, sf):
    rows = src.turns(spark, sf).withColumn("row_id", F.concat_ws(":", "conv_id", "turn", "line_no"))
    neutrals = rows.filter(F.col("tag") == "assistant")
    examples = rows.filter(F.col("tag") == "system")
    pool = neutral_pool.fallback_pool(neutrals, examples, QUERY_FALLBACK)
    return pool.select(big("rank"), "text")


@query
def max_anchor_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    best = similarity.max_anchor_cosine(
        vectors.filter(F.col("label") != 0), vectors.filter(F.col("label") == 0), "vec_id", "embedding"
    )
    return best.select("vec_id", r6(F.col("max_cos"), "max_cos"))


# --- aggregations ----------------------------------------------------------


@query
def token_counts(spark, sf):
    docs = src.texts(spark, sf)
    return vocabulary.token_counts(docs, text.words(F.lower("text")))


@query
def vocab_first_seen(spark, sf):
    return src.corpus(spark, sf).vocab.select("word", big("id"))


@query
def vocab_topk(spark, sf):
    docs = src.texts(spark, sf)
    return vocabulary.vocab_topk(docs, text.words(F.lower("text")), "doc_id")


@query
def vocab_size(spark, sf):
    return vocabulary.vocab_size(src.lines(spark, sf), text.letter_words(F.col("text")))


@query
def label_distribution(spark, sf):
    report = labels.label_distribution(src.label_rows(spark, sf))
    return report.select(
        "label", "n", r6(F.col("share"), "share"), r6(F.col("ratio"), "ratio"), big("imbalanced")
    )


@query
def class_weights(spark, sf):
    return labels.class_weights(src.train_rows(spark, sf)).select("label", r6(F.col("weight"), "weight"))


@query
def augmentation_impact(spark, sf):
    impact = augmentation.augmentation_impact(src.train_rows(spark, sf), src.candidates(spark, sf))
    return impact.select("setting", "n0", "n1", r6(F.col("pct1"), "pct1"))


@query
def augment_union(spark, sf):
    train = src.split_texts(spark, sf).filter(F.col("split") == "train")
    added = augmentation.augment(train.select("text", "label"), src.candidates(spark, sf))
    both = train.select(F.lit("baseline").alias("setting"), "label").unionByName(
        added.select(F.lit("augmented").alias("setting"), "label")
    )
    return both.groupBy("setting", big("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def majority_vote(spark, sf):
    votes = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("vote"))
    return adapters.majority_vote(votes, "conv_id", "vote", F.col("turn"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(src.with_stand_in(src.label_rows(spark, sf)))


@query
def binary_metrics(spark, sf):
    wide = metrics.binary_metrics(src.with_stand_in(src.label_rows(spark, sf)))
    return wide.select(*[r6(F.col(m), m) for m in metrics.METRICS])


@query
def roc_auc(spark, sf):
    area = metrics.roc_auc(src.with_stand_in(src.label_rows(spark, sf)))
    return area.select(r6(F.col("auc_roc"), "auc_roc"))


@query
def log_loss(spark, sf):
    rows = src.with_stand_in(src.label_rows(spark, sf))
    rows = rows.withColumn("weight", F.col("label") + 1.0)
    plain, weighted = metrics.log_loss(rows), metrics.log_loss(rows, weight="weight")
    both = plain.select(F.lit("plain").alias("kind"), "log_loss").unionByName(
        weighted.select(F.lit("weighted").alias("kind"), "log_loss")
    )
    return both.select("kind", r6(F.col("log_loss"), "log_loss"))


@query
def mean_score(spark, sf):
    vectors = table(spark, sf, "embeddings")
    probs = vectors.select("label", scores.softmax(F.col("embedding")).alias("p"))
    missed = probs.withColumn("score", scores.miss_score(F.col("p"), F.col("label")))
    return metrics.mean_score(missed, "label").select(big("label"), r6(F.col("mean_score"), "mean_score"))


def _counted_terms(spark, sf):
    return tfidf.counted_terms(stage(src.labelled(spark, sf).select("doc_id", "text"), "labelled"), "doc_id")


@query
def tfidf_terms(spark, sf):
    return _counted_terms(spark, sf)[0].select("term", "tot", "df")


@query
def tfidf_weights(spark, sf):
    terms, counts = _counted_terms(spark, sf)
    terms = tfidf.with_idf(terms, src.label_rows(spark, sf).count())
    weights = tfidf.weigh(counts, terms, "doc_id")
    return weights.select("doc_id", "term", r6(F.col("weight"), "weight"))


# --- windows, sorts, limits, samples ---------------------------------------


@query
def stratified_split(spark, sf):
    return src.split_rows(spark, sf).select("doc_id", big("label"), "split")


@query
def dedup_first_seen(spark, sf):
    rows = neutral_pool.dedup_first_seen(src.lines(spark, sf), LINE_KEYS)
    return rows.select("doc_id", big("line_no"), "text")


def _survivors(spark, sf):
    pool = neutral_pool.score_pool(src.lines(spark, sf), (F.col("doc_id") % 10) / F.lit(10.0))
    return neutral_pool.refresh_pool(pool, LINE_KEYS)


def _fewshot(spark, sf):
    pool = _survivors(spark, sf).withColumn("row_id", F.concat_ws(":", *LINE_KEYS))
    return neutral_pool.fewshot_examples(pool, order=LINE_KEYS)


@query
def pool_refresh(spark, sf):
    return _survivors(spark, sf).select(big("rank"), "doc_id", big("line_no"), "score")


@query
def fewshot_examples(spark, sf):
    return _fewshot(spark, sf).select(big("rank"), "text")


@query
def prompt_text(spark, sf):
    return neutral_pool.prompt_text(_fewshot(spark, sf))


@query
def sample_k(spark, sf):
    return sampling.sample_k(table(spark, sf, "documents").select("doc_id"), QUERY_SAMPLE, "doc_id")


# --- scalar functions ------------------------------------------------------


@query
def normalize_text(spark, sf):
    t = F.col("text")
    return src.lines(spark, sf).select(
        "doc_id", big("line_no"), text.letters_only(t).alias("letters"), text.straighten(t).alias("straight")
    )


@query
def sanitize_lines(spark, sf):
    heads = ["Example 3: ", "OUTPUT - ", '-* > "', ""]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("line_no") % 4 + 1).cast("int"))
    return src.lines(spark, sf).select(
        "doc_id", big("line_no"), text.sanitize_line(F.concat(head, F.col("text"))).alias("text")
    )


def _tokenized(spark, sf, tokenize):
    rows = src.lines(spark, sf).select("doc_id", big("line_no"), tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", "line_no", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


@query
def tokenize_words(spark, sf):
    return _tokenized(spark, sf, text.letter_words)


@query
def tokenize_wordpunct(spark, sf):
    return _tokenized(spark, sf, text.wordpunct)


@query
def pad_truncate(spark, sf):
    encoded = src.corpus(spark, sf).encoded
    ids = F.col("ids")
    parts = [
        encoded.select(
            "doc_id",
            big("line_no"),
            F.lit(length).cast("bigint").alias("length"),
            sequences.ids_to_text(sequences.fixed_length(ids, length)).alias("ids"),
            sequences.ids_to_text(sequences.fixed_length(ids, length, force_eos=True)).alias("closed"),
            sequences.nonpad_length(sequences.fixed_length(ids, length)).cast("bigint").alias("nonpad"),
        )
        for length in (20, 8)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def shift_targets(spark, sf):
    ids = F.col("ids")
    return src.corpus(spark, sf).encoded.select(
        "doc_id",
        big("line_no"),
        sequences.ids_to_text(sequences.shift_inputs(ids)).alias("inputs"),
        sequences.ids_to_text(sequences.shift_targets(ids)).alias("targets"),
    )


@query
def one_hot(spark, sf):
    hot = scores.one_hot(F.col("label"), 12)
    as_text = F.array_join(hot.cast("array<int>").cast("array<string>"), " ")
    return table(spark, sf, "embeddings").select("vec_id", as_text.alias("one_hot"))


@query
def softmax_argmax(spark, sf):
    raw = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        scores.argmax(raw).cast("bigint").alias("best"),
        r6(F.array_max(scores.softmax(raw)), "max_p"),
    )


@query
def metric_delta(spark, sf):
    rows = src.with_stand_in(src.label_rows(spark, sf)).select(
        "label",
        "prob",
        F.inline(
            F.array(
                F.struct(F.lit("baseline").alias("setting"), F.lit(0.5).alias("cut")),
                F.struct(F.lit("augmented").alias("setting"), F.lit(0.3).alias("cut")),
            )
        ),
    )
    rows = rows.withColumn("prediction", (F.col("prob") > F.col("cut")).cast("int"))
    both = metrics.compare(metrics.binary_metrics(rows, ["setting"]))
    return both.select(
        "metric",
        r6(F.col("baseline"), "baseline"),
        r6(F.col("augmented"), "augmented"),
        r6(F.col("delta"), "delta"),
        "verdict",
    )


def _class_rows(spark, sf):
    """(row_id, text, class_idx): lines of turns by role, and candidates as a class of their own."""
    real = src.turns(spark, sf).select(F.concat_ws(":", "conv_id", "turn", "line_no").alias("row_id"), "tag", "text")
    synthetic = src.candidates(spark, sf).select(F.concat_ws(":", F.lit("added"), *LINE_KEYS).alias("row_id"), "text")
    tags = textlines.order_tags(["user", "assistant", "system"], "system")
    return labels.class_training_table(real, synthetic, tags, neutral="system"), len(tags) + 1


@query
def multiclass_table(spark, sf):
    rows, classes = _class_rows(spark, sf)
    counts = rows.groupBy(big("class_idx")).agg(F.count(F.lit(1)).alias("n"))
    hot = scores.one_hot(F.col("class_idx"), classes).cast("array<int>").cast("array<string>")
    return counts.select("class_idx", F.array_join(hot, " ").alias("one_hot"), "n")


@query
def multiclass_rows(spark, sf):
    rows, _ = _class_rows(spark, sf)
    return rows.select("row_id", big("class_idx"), F.md5("text").alias("text_md5"))


# --- models ----------------------------------------------------------------


def _outside_candidates(spark, sf):
    """Candidates from documents without a label, so that no test text is trained on."""
    return src.candidates(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


def _fitted(spark, sf):
    """Split texts, the fitted baseline and augmented models, and the candidates of the latter."""
    rows = stage(
        src.split_texts(spark, sf).withColumn("row_id", F.col("doc_id").cast("string")), "split_texts"
    )
    added = _outside_candidates(spark, sf)
    added = stage(added.select(F.concat_ws(":", F.lit("added"), *LINE_KEYS).alias("row_id"), "text"), "outside")
    fitted = experiment.fit_settings(rows.filter(F.col("split") == "train"), added)
    return rows, fitted, added


@query
def tfidf_lr_predict(spark, sf):
    rows = stage(src.split_texts(spark, sf), "split_texts")
    train = rows.filter(F.col("split") == "train")
    model = classifier.fit_text_classifier(train, "doc_id")
    scored = model.score(rows.filter(F.col("split") == "test").select("doc_id", "text", "label"))
    return scored.select("doc_id", big("label"), big("prediction"), r6(F.col("prob"), "prob"))


@query
def predictions_table(spark, sf):
    rows, fitted, _ = _fitted(spark, sf)
    test = rows.filter(F.col("split") == "test").select("row_id", "text", "label")
    scored = stage(experiment.score_all(fitted, test), "scored")
    base, augmented = (scored.filter(F.col("setting") == s) for s in ("baseline", "augmented"))
    table_ = reports.prediction_table(base, augmented)
    path = stage_path(spark, "predictions")
    reports.write_predictions(table_, path)
    read = spark.read.schema(table_.schema).parquet(path)
    return read.select(
        F.col("row_id").cast("bigint").alias("doc_id"),
        *[big(c) for c in ("label", "pred_b", "pred_a")],
        r6(F.col("prob_b"), "prob_b"),
        r6(F.col("prob_a"), "prob_a"),
    )


@query
def experiment_report(spark, sf):
    rows, fitted, added = _fitted(spark, sf)
    test = rows.filter(F.col("split") == "test").select("row_id", "text", "label")
    train = rows.filter(F.col("split") == "train")
    report = experiment.report(train, added, test, experiment.evaluate(fitted, test))
    path = stage_path(spark, "report")
    reports.write_report(report, path)
    read = spark.read.schema(report.schema).json(path)
    long = metrics.long_metrics(read.select(F.inline("in_domain")), ["model", "setting"])
    return long.select("model", "setting", "metric", r6(F.col("value"), "value"))


def _outside_sets(spark, sf, labelled):
    """Loaders of the sets models are tried on: adapted posts, labelled rows by language, and one that is not there."""

    def three_way():
        posts = src.lines(spark, sf).withColumnRenamed("text", "tweet")
        posts = posts.withColumn("class", ((F.col("doc_id") + F.col("line_no")) % 4 - 1).cast("int"))
        rows = adapters.adapt("three_way", posts, carry=tuple(LINE_KEYS))
        return rows.withColumn("row_id", F.concat_ws(":", *LINE_KEYS))

    def annotated():
        rows = adapters.adapt("annotated", src.annotated_posts(spark, sf), carry=("conv_id", "turn"))
        return rows.withColumn("row_id", F.concat_ws(":", "conv_id", "turn"))

    def of(lang):
        return lambda: labelled.filter(F.col("lang").eqNullSafe(F.lit(lang))).select("row_id", "text", "label")

    sets = {"three_way": three_way, "annotated": annotated}
    # One set for each language that occurs; rows without one are a set too.
    sets |= {f"lang_{r['lang']}": of(r["lang"]) for r in labelled.select("lang").distinct().collect()}
    sets["absent"] = lambda: spark.read.parquet(f"{sf}/no_such_table.parquet")
    return sets


def _cross_dataset(spark, sf, rows, fitted, **options):
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    # Only rows that no model was fitted on.
    labelled = stage(rows.filter(F.col("split") != "train").join(langs, "doc_id"), "labelled")
    wide = experiment.cross_dataset(fitted, _outside_sets(spark, sf, labelled), **options)
    long = metrics.long_metrics(wide, ["model", "setting", "dataset"])
    return long.select("model", "setting", "dataset", "metric", r6(F.col("value"), "value"))


@query
def cross_dataset(spark, sf):
    rows, fitted, _ = _fitted(spark, sf)
    return _cross_dataset(spark, sf, rows, fitted).drop("setting")


@query
def cross_dataset_fixed(spark, sf):
    """The same evaluation of models whose coefficients follow a rule, so that SQL can follow."""
    rows = stage(src.split_texts(spark, sf).withColumn("row_id", F.col("doc_id").cast("string")), "split_texts")
    return _cross_dataset(spark, sf, rows, _fixed_models(spark, sf), setting=None, digits=SCORE_DIGITS)


def _fixed_terms(spark, sf):
    """(idx, term, idf) of all labelled texts."""
    return stage(tfidf.with_idf(_counted_terms(spark, sf)[0], src.label_rows(spark, sf).count()), "terms")


def _fixed_models(spark, sf):
    """Baseline and augmented two-class models with coefficients by a fixed rule."""
    terms = _fixed_terms(spark, sf)
    rules = {"baseline": (7, 23, -0.3), "augmented": (5, 19, 0.1)}
    return {
        ("fixed", setting): classifier.TextClassifier(
            terms.withColumn("coef", ((F.col("idx") * step) % size - size // 2) / 5.0), intercept
        )
        for setting, (step, size, intercept) in rules.items()
    }


def _fixed_scorer(spark, sf, step, key, terms=None):
    """Three-class scorer with coefficients by a fixed rule."""
    terms = _fixed_terms(spark, sf) if terms is None else terms
    classes = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("class")
    coefs = terms.select("idx", classes).withColumn("coef", ((F.col("idx") * step + F.col("class") * 5) % 23 - 11) / 5.0)
    return classifier.ClassScorer(terms, coefs, [0.0, 0.1, 0.2], key)


def _fixed_test(spark, sf):
    rows = src.split_texts(spark, sf).withColumn("row_id", F.col("doc_id").cast("string"))
    return stage(rows, "split_texts")


@query
def fixed_predictions(spark, sf):
    """The prediction table of two models with fixed coefficients, written and read."""
    test = _fixed_test(spark, sf).filter(F.col("split") == "test").select("row_id", "text", "label")
    scored = stage(experiment.score_all(_fixed_models(spark, sf), test, digits=SCORE_DIGITS), "scored")
    base, augmented = (scored.filter(F.col("setting") == s) for s in ("baseline", "augmented"))
    path = stage_path(spark, "predictions")
    reports.write_predictions(reports.prediction_table(base, augmented), path)
    read = spark.read.parquet(path)
    return read.select(
        F.col("row_id").cast("bigint").alias("doc_id"), *[big(c) for c in ("label", "pred_b", "pred_a")], "prob_b", "prob_a"
    )


@query
def fixed_report(spark, sf):
    """The experiment's report of two models with fixed coefficients, written and read."""
    rows = _fixed_test(spark, sf)
    test = rows.filter(F.col("split") == "test").select("row_id", "text", "label")
    train = rows.filter(F.col("split") == "train")
    in_domain = experiment.evaluate(_fixed_models(spark, sf), test, digits=SCORE_DIGITS)
    report = experiment.report(train, _outside_candidates(spark, sf), test, in_domain)
    path = stage_path(spark, "report")
    reports.write_report(report, path)
    read = spark.read.schema(report.schema).json(path)
    long = metrics.long_metrics(read.select(F.inline("in_domain")), ["setting"])
    sizes = ["train_original", "original_toxic", "original_nontoxic", "generated_cleaned", "train_augmented", "augmented_toxic", "test_size"]
    counts = read.select(F.lit("sizes").alias("setting"), *[F.col(c).cast("double").alias(c) for c in sizes])
    deltas = read.select(F.inline("improvement")).select(F.lit("delta").alias("setting"), "metric", F.col("delta").alias("value"))
    parts = [long, counts.unpivot(["setting"], sizes, "metric", "value"), deltas]
    return reduce(DataFrame.unionByName, parts).select("setting", "metric", r6(F.col("value"), "value"))


@query
def lr_optimality(spark, sf):
    """What the fit of the baseline model has seen, and that its loss is flat where it ended."""
    train = stage(src.split_texts(spark, sf).filter(F.col("split") == "train"), "train")
    model = classifier.fit_text_classifier(train, "doc_id")
    return _optimality(train, model, classifier.binary_gradient(model, train), labels.class_weights(train), "label")


def _optimality(train, model, gradient, balance, label):
    n = train.count()
    slopes = classifier.optimality(gradient).withColumn("_one", F.lit(1))
    weights = train.select(F.col(label).alias("label")).join(F.broadcast(balance), "label")
    totals = weights.agg(F.count(F.lit(1)).alias("rows"), r6(F.sum("weight"), "weight_sum")).withColumn("_one", F.lit(1))
    size = model.terms.agg(F.count(F.lit(1)).alias("terms")).withColumn("_one", F.lit(1))
    # Aggregates of one row each.
    return totals.join(size, "_one").join(slopes, "_one").select(
        "rows", "terms", "weight_sum",
        (F.col("largest") <= FLAT * n).cast("bigint").alias("flat_by_coefficient"),
        F.round(F.col("intercepts") / n, 3).alias("slope_by_intercept"),
    )


def _class_train(spark, sf):
    """(row_id, text, class_idx) of the tagged training texts: neutral, toxic, low quality."""
    train = src.split_rows(spark, sf).filter(F.col("split") == "train").select("doc_id")
    tagged = labels.class_table(src.flagged(spark, sf).join(train, "doc_id"), FLAG_COLUMNS, FLAG_COLUMNS, carry=("doc_id",))
    real = tagged.select(F.concat_ws(":", "tag", "doc_id").alias("row_id"), "tag", "text")
    return labels.class_training_table(real, None, ["nor", *FLAG_COLUMNS])


@query
def class_optimality(spark, sf):
    """As `lr_optimality`, of the K-class scorer on the tagged training texts."""
    train = stage(_class_train(spark, sf), "class_train")
    model = classifier.fit_class_scorer(train)
    balance = labels.class_weights(train.select(F.col("class_idx").alias("label")))
    return _optimality(train, model, classifier.class_gradient(model, train), balance, "class_idx")


@query
def class_scores(spark, sf):
    """Probabilities of three classes for texts outside the training split, coefficients by a fixed rule."""
    rows = stage(src.split_texts(spark, sf).filter(F.col("split") != "train"), "unseen")
    scored = _fixed_scorer(spark, sf, 7, "doc_id").score(rows.select("doc_id", "text"))
    probs = [F.round(F.col("probs")[k], SCORE_DIGITS).alias(f"p{k}") for k in range(3)]
    return scored.select("doc_id", big("prediction"), *probs)


@query
def class_fit_scores(spark, sf):
    """A K-class scorer fitted on the tagged training texts, saved, loaded, and its scores of the test texts."""
    path = stage_path(spark, "class_scorer")
    classifier.fit_class_scorer(stage(_class_train(spark, sf), "class_train")).save(path)
    rows = src.split_texts(spark, sf).filter(F.col("split") == "test").select(F.col("doc_id").alias("row_id"), "text")
    scored = classifier.ClassScorer.load(spark, path).score(stage(rows, "test"))
    probs = [r6(F.col("probs")[k], f"p{k}") for k in range(3)]
    return scored.select(F.col("row_id").alias("doc_id"), big("prediction"), *probs)


@query
def pool_generations(spark, sf):
    """Three generations of the pool of all lines, each scored by a model of its own with fixed coefficients."""
    rows = src.lines(spark, sf).withColumn("row_id", F.concat_ws(":", *LINE_KEYS))
    terms = _fixed_terms(spark, sf)

    def model(generation):
        scorer = _fixed_scorer(spark, sf, generation + 3, "row_id", terms)
        return pool_cycle.class_model(scorer, 0, SCORE_DIGITS)

    cycle = pool_cycle.PoolCycle(spark, stage_path(spark, "pool"), LINE_KEYS)
    cycle.run(rows, model, GENERATIONS)
    parts = [
        cycle.read(g).select(F.lit(g).cast("bigint").alias("generation"), "doc_id", big("line_no"), "score")
        for g in range(GENERATIONS + 1)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def multiclass_scores(spark, sf):
    scored = classifier.multiclass_scores(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return scored.select("vec_id", big("label"), big("prediction"), r6(F.col("p0"), "p0"))

"""Mixing sources to target weights, in DataFrame functions only.

The words of a source are laid end to end and cut into blocks of a fixed length.
The mix is a sequence of slots, each filled with one block, in output shards of a
fixed number of slots. Every shard draws how many of its slots go to which source
from a multinomial with the target shares. A source's slots count through its blocks
in a pseudorandom order: the index of a slot within its source is mapped by a
permutation of the source's block numbers, another one for each pass. So slots and
blocks meet in a join by block number, and no list of blocks is shuffled as a whole.

What the draws leave above a source's quota of blocks goes to the sources they left
below it, slot by slot, so that the mix hits its targets to a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civitext.llm.common import as_row, count_words, words
from civitext.operators.ordered import with_running_sum
from civitext.session import broadcast_if_small, stage

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 20240607
# Slots that one task makes of its counts.
TASK_SLOTS = 1 << 17
# Steps of the walk back into the range of a permutation. The walk leaves the range with a
# probability of 1 / sqrt(blocks) at most and is over after blocks outside of it plus one.
_WALK = 40
_ROUNDS = 4


def _uniform(*keys: Column) -> Column:
    """Pseudorandom double in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in the order of their code points, the null source last, take weights 3, 1,
    2 in turn and share TOTAL_SHARE of all words by weight. A target stops at MOST_TIMES
    its source's size; what it cannot take is shared again by the rest, until none is
    above. The level at which the targets stop is found in one pass: in the order of
    size per weight, the first sources are full up to the point where an even share of
    what is left is below the next one's size.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    weighed = by_source.withColumn("weight", weight.cast("double"))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(float(MOST_TIMES)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    weighed = weighed.withColumn("level", level)
    open_level = F.max(F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))).over(everything)
    weighed = weighed.withColumn("open", open_level)
    share = F.when(F.col("open").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("open") * F.col("weight")))
    return weighed.select("source", "source_size", share.alias("target"))


def _blocks_of(targets: DataFrame) -> DataFrame:
    """Adds number, blocks (of the source) and quota (blocks to take), sources numbered by name."""
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    # The last block may be short: the quota counts blocks of the source's mean length.
    mean = F.col("source_size") / F.col("blocks")
    quota = F.least(F.round(F.col("target") / mean), F.col("blocks") * MOST_TIMES)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sized = targets.withColumn("number", number).withColumn("blocks", blocks.cast("long"))
    return sized.withColumn("quota", F.coalesce(F.when(F.col("blocks") > 0, quota), F.lit(0)).cast("long"))


def _spread(counts: DataFrame, size: str, *order: str) -> DataFrame:
    """Adds `first`: sum of `size` over earlier rows in the given order, over few rows."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum(size).over(before), F.lit(0)))


def slot_counts(sources: DataFrame) -> DataFrame:
    """(shard, number, count, first): slots of each shard and source; `first` is the index of the first.

    Every slot draws a source by a uniform number that depends on shard and slot alone;
    the counts per shard are multinomial. A source keeps its first `quota` slots; slots
    above that are dealt, in their order, to the sources that are below theirs.
    """
    spark = sources.sparkSession
    wanted = sources.filter("quota > 0")
    slots = int(wanted.agg(F.sum("quota")).first()[0] or 0)
    upto = F.sum("quota").over(Window.orderBy("number")) / F.lit(float(max(slots, 1)))
    ends = wanted.select("number", upto.alias("end")).agg(
        F.sort_array(F.collect_list(F.struct("end", "number"))).alias("ends")
    )
    # One row with one entry per source; the join with it adds no rows.
    drawn = spark.range(slots).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), _uniform(F.col("id")).alias("u"))
    drawn = drawn.withColumn("one", F.lit(1)).join(F.broadcast(ends.withColumn("one", F.lit(1))), "one")
    at = F.size(F.filter("ends", lambda e: e["end"] <= F.col("u"))) + 1
    number = F.element_at("ends", F.least(at, F.size("ends")))["number"]
    drawn = drawn.select("shard", number.alias("number")).groupBy("shard", "number").agg(F.count(F.lit(1)).alias("drawn"))
    drawn = stage(drawn, "draws")
    kept = with_running_sum(drawn, [F.col("shard")], "drawn", "before", ["number"])
    kept = kept.join(wanted.select("number", "quota"), "number")
    room = F.greatest(F.lit(0), F.col("quota") - F.col("before"))
    kept = kept.select("shard", "number", "drawn", F.least("drawn", room).alias("count"))
    spare = _spread(kept.filter("drawn > count").select("shard", "number", (F.col("drawn") - F.col("count")).alias("n")), "n", "shard", "number")
    totals = drawn.groupBy("number").agg(F.sum("drawn").alias("total"))
    short = wanted.join(totals, "number", "left").withColumn("n", F.col("quota") - F.coalesce("total", F.lit(0)))
    short = _spread(short.filter("n > 0").select("number", "n"), "n", "number")
    places = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("place")
    moved = spare.select("shard", places).join(short.select("number", places), "place")
    counts = kept.select("shard", "number", "count").unionByName(
        moved.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("count"))
    )
    counts = counts.groupBy("shard", "number").agg(F.sum("count").alias("count")).filter("count > 0")
    return with_running_sum(counts, [F.col("shard")], "count", "first", ["number"])


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0 .. size - 1, one for each key.

    A Feistel network over a grid of about sqrt(size) rows and columns; places of the
    grid that are no index are walked through until one is.
    """
    rows = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    columns = F.ceil(size / rows).cast("long")

    def mixed(x: Column) -> Column:
        state = F.struct((x % rows).alias("r"), F.floor(x / rows).cast("long").alias("c"))

        def turn(s: Column, i: Column) -> Column:
            r = F.when(i % 2 == 0, F.pmod(s["r"] + F.pmod(F.xxhash64(s["c"], i, *key), rows), rows)).otherwise(s["r"])
            c = F.when(i % 2 == 1, F.pmod(s["c"] + F.pmod(F.xxhash64(s["r"], i, *key), columns), columns)).otherwise(s["c"])
            return F.struct(r.alias("r"), c.alias("c"))

        turns = F.array(*[F.lit(i) for i in range(_ROUNDS)])
        return F.aggregate(turns, state, turn, lambda s: s["c"] * rows + s["r"])

    walk = F.array(*[F.lit(i) for i in range(_WALK)])
    return F.aggregate(walk, mixed(index), lambda x, _: F.when(x < size, x).otherwise(mixed(x)))


def mix_slots(sources: DataFrame) -> DataFrame:
    """(shard, number, index, pass, block): the block in every slot of the mix."""
    counts = slot_counts(sources).join(sources.select("number", "blocks"), "number")
    # Few short rows become very many: without this they would do so in one task.
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    counts = counts.repartition(1 + slots // TASK_SLOTS, "shard", "number")
    slots = counts.select(
        "shard", "number", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("index")
    )
    turn = F.floor(F.col("index") / F.col("blocks"))
    slots = slots.withColumn("pass", turn)
    block = permuted(F.col("index") % F.col("blocks"), F.col("blocks"), F.col("number"), F.col("pass"))
    return slots.select("shard", "number", "index", "pass", block.alias("block"))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: (row, uid, size, source_size, target), every row of `docs` as a struct.
    pieces: (uid, shard, index, pass, from_word, n_words): the words of a
    document that a slot takes; `from_word` counts from 0 in the document. Within a
    source, documents lie in the order of their keys.

    Null and empty texts have no words and no pieces; the null source is a source like
    any other; repeated rows are documents of their own. An empty table gives no rows.
    """
    marked = stage(
        docs.select(
            as_row(docs),
            F.col(f"`{key}`").alias("key"),
            F.monotonically_increasing_id().alias("uid"),
            F.col(f"`{source}`").alias("source"),
            count_words(F.col(f"`{text}`")).alias("size"),
        ),
        "sizes",
    )
    return _mixed(marked)


def _mixed(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    narrow = marked.select("uid", "key", "source", "size")
    sources = stage(_blocks_of(source_targets(narrow)), "targets")
    named = narrow.join(broadcast_if_small(sources), narrow["source"].eqNullSafe(sources["source"])).drop("source")
    placed = with_running_sum(
        named.select("uid", "key", "number", "size"), [F.col("key"), F.col("uid")], "size", "begin", ["number"]
    )
    placed = placed.filter("size > 0")
    first, last = F.floor(F.col("begin") / BLOCK_WORDS), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK_WORDS)
    parts = placed.select("uid", "number", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * BLOCK_WORDS - F.col("begin"))
    end = F.least(F.col("size"), (F.col("block") + 1) * BLOCK_WORDS - F.col("begin"))
    parts = parts.select("uid", "number", "block", start.alias("from_word"), (end - start).alias("n_words"))
    # Sides that grow with the corpus are merged at every size: none passes through the driver.
    pieces = parts.join(mix_slots(sources).hint("merge"), ["number", "block"])
    pieces = pieces.select("uid", "shard", "index", "pass", "from_word", "n_words")
    documents = marked.join(broadcast_if_small(sources), marked["source"].eqNullSafe(sources["source"]))
    return documents.select(marked["*"], "source_size", "target"), pieces


def taken_words(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, size, source_size, target, taken): words of each document and those the mix takes."""
    marked = stage(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.monotonically_increasing_id().alias("uid"),
            F.col(f"`{source}`").alias("source"),
            count_words(F.col(f"`{text}`")).alias("size"),
        ),
        "sizes",
    )
    documents, pieces = _mixed(marked)
    taken = pieces.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    out = documents.join(taken.hint("merge"), "uid", "left")
    return out.select(
        F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix as rows of `docs`: one for each pass that takes words of a document.

    A row that a pass takes whole keeps its text as it is; of others the text is the
    taken words in their order, joined by blanks. Documents without words, and those
    no pass takes, are not in the mix. Columns other than the text are as they came.
    """
    documents, pieces = mix_documents(docs, key, source, text)
    spans = pieces.groupBy("uid", "pass").agg(
        F.sum("n_words").alias("taken"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("spans")
    )
    chosen = documents.select("row", "uid", "size").join(spans.hint("merge"), "uid")
    own = F.col(f"row.`{text}`")
    cut = F.flatten(F.transform("spans", lambda s: F.slice(F.col("tokens"), (s["from_word"] + 1).cast("int"), s["n_words"].cast("int"))))
    tokens = F.when(F.col("taken") < F.col("size"), words(own))
    chosen = chosen.withColumn("tokens", F.explode_outer(F.array(tokens)))
    chosen = chosen.withColumn("mixed", F.when(F.col("taken") == F.col("size"), own).otherwise(F.array_join(cut, " ")))
    return chosen.select(*[F.col("mixed" if c == text else f"row.`{c}`").alias(c) for c in docs.columns])

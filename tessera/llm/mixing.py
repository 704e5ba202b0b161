"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end; the row of words is cut into
blocks of equal size, each source into blocks of its own, of the common size at most. A
source has as many slots as its target has blocks. Slot i of the mix takes golden-ratio point
i, by its place among all points, through the cumulative numbers of slots to its source; the
slot's rank among the source's slots names the block that it takes, going round the source's
blocks again when they are used up. So any stretch of the mix holds every source in its share,
and each source's words come within a block of its target.

``mixed_blocks`` joins the blocks to the slots: the mix, piece by piece. ``mixed_documents``
keeps a document that goes over the edge of blocks in one piece, at its first block's slot: as
blocks are taken in order, what the mix takes of it in one round is always its beginning.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .runtime import bucket_count, materialize, numbered, pick, positional, prefix_sums, scratch, text_key

WORD = r"[^\x20\x09-\x0D]+"
#: Fraction of 2**32 nearest to the golden ratio: the step of the Weyl sequence.
GOLDEN = 2_654_435_769
#: Slots are ranked in runs of this length.
SLOT_RUN = 4_096
#: Blocks that a source is cut into at least, if it has so many words.
LEAST_BLOCKS = 16


@dataclass(frozen=True)
class MixPlan:
    """Sizes that fix a schedule. ``words`` is the size of the mix, ``block`` that of the largest block."""

    words: int
    block: int
    max_epochs: int = 3


def plan_mix(words: int, max_epochs: int = 3, least_slots: int = 1 << 16, most_block: int = 1 << 16) -> MixPlan:
    """Blocks are a 65,536th of the mix, of 1 to 65,536 words; a larger mix gets more slots."""
    return MixPlan(words, max(1, min(words // least_slots, most_block)), max_epochs)


def source_targets(sizes: DataFrame, total: int, max_epochs: int = 3) -> DataFrame:
    """(source_id, source, source_size, weight, target) from (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... Targets share ``total``; one
    that stands above ``max_epochs`` times its source's size is held there and the excess goes
    to the others by weight, until none is above. Each round sends two numbers to the driver.
    """
    rows = numbered(sizes, [F.col("source").isNull(), F.col("source")], "source_id")
    rows = rows.withColumn("weight", (F.col("source_id") % 3 + 1).cast("double"))
    rows = materialize(rows.withColumn("most", (F.col("source_size") * max_epochs).cast("double")), "sources")
    level, held_before = 0.0, -1
    while True:
        held = F.col("most") < F.lit(level) * F.col("weight")
        n, fixed, open_weight = rows.agg(
            F.count_if(held), F.sum(F.when(held, F.col("most")).otherwise(0.0)), F.sum(F.when(~held, F.col("weight")).otherwise(0.0))
        ).first()
        if n == held_before or not open_weight:
            break
        level, held_before = (total - fixed) / open_weight, n
    return rows.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("most")


def block_count(plan: MixPlan) -> Column:
    """How many blocks a source of ``source_size`` words is cut into; their sizes differ by one at most."""
    size = F.col("source_size")
    return F.greatest(F.ceil(size / F.lit(plan.block)), F.least(size, F.lit(LEAST_BLOCKS))).cast("bigint")


def block_begin(block: Column) -> Column:
    """Where a block begins among its source's words, by ``source_size`` and ``blocks``."""
    return block * F.expr("source_size div blocks") + F.least(block, F.col("source_size") % F.col("blocks"))


def block_of(word: str) -> Column:
    """The block that a word of the source stands in: the larger blocks come first."""
    larger = "(source_size % blocks) * (source_size div blocks + 1)"
    return F.expr(
        f"CASE WHEN {word} < {larger} THEN ({word}) div (source_size div blocks + 1)"
        f" ELSE source_size % blocks + ({word} - {larger}) div (source_size div blocks) END"
    )


def schedule(spark: SparkSession, targets: DataFrame, plan: MixPlan) -> DataFrame:
    """(slot, source_id, rank, block): which block of which source each slot of the mix takes.

    Each source has the slots that its target has blocks, to the nearest.
    """
    counts = (
        targets.filter("target > 0")
        .withColumn("blocks", block_count(plan))
        .withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"))
        .filter("slots > 0")
        .select("source_id", "blocks", "slots", F.lit(0).alias("all"), F.floor(F.col("source_id") / SLOT_RUN).alias("run"))
    )
    counts = prefix_sums(counts, ["all"], "run", ["source_id"], "slots", "lo")
    counts = materialize(counts.select("source_id", "blocks", "slots", "lo", (F.col("lo") + F.col("slots")).alias("hi")), "slots")
    n_slots = counts.agg(F.sum("slots")).first()[0] or 0
    places = counts.withColumn("from", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(SLOT_RUN).cast("bigint"))))
    places = places.withColumn(
        "place", F.explode(F.sequence("from", F.least(F.col("from") + SLOT_RUN, F.col("hi")) - 1))
    ).select("place", "source_id", "blocks")
    point = (F.col("slot") % (1 << 31)) * F.lit(GOLDEN) % F.lit(1 << 32) / F.lit(float(1 << 32))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u"))
    slots = slots.select(
        "slot", "u", F.lit(0).alias("all"), F.floor(F.col("u") * bucket_count(n_slots)).alias("cell"), F.lit(1).alias("one")
    )
    slots = prefix_sums(slots, ["all"], "cell", ["u", "slot"], "one", "place").select("slot", "place", "one")
    placed = slots.join(places, "place").withColumn("run", F.floor(F.col("slot") / SLOT_RUN))
    ranked = prefix_sums(placed, ["source_id"], "run", ["slot"], "one", "rank")
    return ranked.select("slot", "source_id", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size): ``key`` tells rows of one doc_id apart by content."""
    rows = pick(docs, doc_id="bigint", text="string", source="string")
    return rows.select(
        "doc_id",
        text_key(F.col("text"), F.col("source")).alias("key"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )


def lay_out(rows: DataFrame, targets: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Add source_id, source_size, target and ``begin``: where in its source's shuffled words a row stands."""
    named = targets.select(F.col("source").alias("_source"), "source_id", "source_size", "target")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_mix", F.xxhash64(F.lit(seed), "doc_id", "key"))
    rows = rows.withColumn("_bucket", F.pmod("_mix", F.lit(bucket_count(n_rows))))
    return prefix_sums(rows, ["source_id"], "_bucket", ["_mix", "doc_id", "key"], "size", "begin").drop("_mix", "_bucket")


def mix(docs: DataFrame, seed: int = 1, max_epochs: int = 3) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` counts the row's words that the mix takes, repeats included. Null and empty texts
    have size 0; a null source is a source of its own; repeated rows each have their part; an
    empty table gives an empty result. The same rows give the same mix on every run.
    """
    with scratch(docs.sparkSession):
        laid, targets, slots, plan = prepare(docs, seed, max_epochs)
        return materialize(with_taken(laid, targets, plan, slots), "mix", keep=True)


def prepare(docs: DataFrame, seed: int, max_epochs: int) -> tuple[DataFrame, DataFrame, DataFrame, MixPlan]:
    """Rows at their places in their sources, the targets, the schedule, and its plan."""
    rows = materialize(sized(docs), "sized")
    n_rows, words = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    plan = plan_mix(words or 0, max_epochs)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, plan.words, max_epochs), "targets")
    laid = materialize(lay_out(rows, targets, n_rows, seed), "laid")
    return laid, targets, materialize(schedule(docs.sparkSession, targets, plan), "schedule"), plan


def pieces(laid: DataFrame, plan: MixPlan) -> DataFrame:
    """(source_id, begin, block, first, part, doc_id, key): the words [first, first + part) of rows that stand in each block."""
    block = F.col("block")
    cut = (
        laid.filter("size > 0")
        .withColumn("blocks", block_count(plan))
        .withColumn("block", F.explode(F.sequence(block_of("begin"), block_of("begin + size - 1"))))
        .withColumn("from", F.greatest(F.col("begin"), block_begin(block)))
        .withColumn("part", F.least(F.col("begin") + F.col("size"), block_begin(block + 1)) - F.col("from"))
    )
    return cut.select("source_id", "begin", "block", (F.col("from") - F.col("begin")).alias("first"), "part", "doc_id", "key")


def with_taken(laid: DataFrame, targets: DataFrame, plan: MixPlan, slots: DataFrame | None = None) -> DataFrame:
    """Join the pieces that blocks cut rows into with the times that the schedule (``slots``) takes each block."""
    slots = slots or schedule(laid.sparkSession, targets, plan)
    times = slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        pieces(laid, plan).select("source_id", "begin", "block", "part")
        .join(times, ["source_id", "block"])
        .groupBy("source_id", "begin")
        .agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    )
    # rows of size 0 share their begin with the next row; only that one has words
    joined = laid.join(taken.withColumn("_sized", F.lit(True)), ["source_id", "begin"], "left")
    return joined.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0)).select(
        "doc_id", "key", "source", "source_id", "begin", "size", "source_size", "target", "taken"
    )


def mixed_blocks(docs: DataFrame, seed: int = 1, max_epochs: int = 3) -> DataFrame:
    """(slot, source_id, block, begin, doc_id, text): the mix as the schedule joins it from blocks.

    Each slot gives its block's pieces in their order, ``begin`` being a piece's place in its
    source. A piece's text is its words as they stand, with what parts them. Rows of size 0 have no
    piece. The files that hold the result are in slot order.
    """
    spark = docs.sparkSession
    with scratch(spark):
        laid, _, slots, plan = prepare(docs, seed, max_epochs)
        cut = pieces(laid, plan)
        placed = slots.join(cut, ["source_id", "block"])
        rows = placed.select("slot", "source_id", "block", (F.col("begin") + F.col("first")).alias("begin"), "first", "part", "doc_id", "key")
        texts, _ = keyed_texts(docs)
        texts = texts.select("_id", "_key", F.col("_text"))
        joined = rows.join(texts, rows["doc_id"].eqNullSafe(texts["_id"]) & (rows["key"] == texts["_key"]))
        made = in_order(joined.select("slot", "source_id", "block", "begin", "doc_id", "_text", "first", "part"), "slot", "begin")
        text = word_range(F.col("_text"), F.col("first"), F.col("first") + F.col("part"))
        return materialize(made.select("slot", "source_id", "block", "begin", "doc_id", text.alias("text")), "blocks", keep=True)


def mixed_documents(docs: DataFrame, seed: int = 1, max_epochs: int = 3) -> DataFrame:
    """The mix itself: every document as often as the schedule takes it, with all its columns, in slot order.

    A document that the mix takes q times in full and w words more gives q rows as they were and
    one row whose text is its first w words, each at the slot of its first block; one of which no
    word is taken gives none. Of rows alike in doc_id, text and source, the least by all columns as
    JSON stands for each.
    """
    spark = docs.sparkSession
    with scratch(spark):
        laid, targets, slots, plan = prepare(docs, seed, max_epochs)
        taken = with_taken(laid, targets, plan, slots).filter("taken > 0").withColumn("blocks", block_count(plan))
        takes = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(taken - 1) div size"))))
        whole = (F.col("epoch") + 1) * F.col("size") <= F.col("taken")
        takes = takes.select(
            "doc_id", "key", "source_id", "begin", "size",
            F.when(whole, F.col("size")).otherwise(F.col("taken") % F.col("size")).alias("_words"),
            (F.col("epoch") * F.col("blocks") + block_of("begin")).alias("rank"),
        )
        takes = takes.join(slots.select("source_id", "rank", "slot"), ["source_id", "rank"])
        takes = materialize(takes.select("doc_id", "key", "size", "_words", "slot", "begin"), "takes", keep=True)
    texts, names = keyed_texts(docs)
    rows = texts.join(takes, texts["_id"].eqNullSafe(takes["doc_id"]) & (texts["_key"] == takes["key"]))
    at = f"c{names.index('text')}"
    rows = in_order(rows, "slot", "begin")
    cut = F.when(F.col("_words") == F.col("size"), F.col("_text")).otherwise(word_range(F.col("_text"), F.lit(0).cast("bigint"), F.col("_words")))
    return rows.select(*(cut.alias(c) if c == at else F.col(c) for c in (f"c{i}" for i in range(len(names))))).toDF(*names)


def in_order(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt out by ranges of ``cols`` and sorted, so that files hold them in that order."""
    return rows.repartitionByRange(*cols).sortWithinPartitions(*cols)


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` as c0, c1, ... with _id, _key and _text, one row of those alike in doc_id, text and source."""
    plain, names = positional(docs)
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source")}
    key = text_key(at["text"].cast("string"), at["source"].cast("string"))
    plain = plain.withColumns({"_id": at["doc_id"].cast("bigint"), "_key": key, "_text": at["text"].cast("string")})
    if plain.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return plain, names
    cols = plain.columns
    order = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return plain.groupBy("_id", "_key").agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*"), names


@F.pandas_udf(StringType())
def word_range(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """Each text from its word ``begins`` up to the end of the word before ``ends``."""
    word = re.compile(WORD)

    def cut(text: str, begin: int, end: int) -> str:
        first, last = None, 0
        for found in itertools.islice(word.finditer(text), int(begin), int(end)):
            first = found.start() if first is None else first
            last = found.end()
        return text[0 if begin == 0 else first or 0 : last]

    return pd.Series([cut(t, a, b) for t, a, b in zip(texts, begins, ends, strict=True)], dtype=object)

"""Importance resampling to a target distribution, drawn by merging sorted runs.

Hashed word n-grams are counted over all documents and over the target's texts. The ratio of their smoothed shares
gives each bucket a gain, an array of fixed size by which a text's buckets are scored. A document's weight is
the sum of its gains; with Gumbel noise the highest scores are a draw without replacement in proportion to the weights.

Every partition sorts its eligible rows into runs that are written in blocks. Heads of blocks cut the order into
ranges; each range's slices of the runs are merged by a tournament tree, which opens a slice when the merge has
come to its head, and stops after the number of rows that the draw still takes from this range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, numbered, pick, scratch

#: Rows of a sorted run, and of the blocks in which it is written.
RUN_ROWS = 1 << 18
BLOCK_ROWS = 1 << 11
#: Rows that a merge should take, about, and the number of ranges at most.
RANGE_ROWS = 1 << 15
MOST_RANGES = 4_096
#: A-Z in lower case, digits, a-z and all bytes of other characters as they are; anything else parts words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


class Buckets(dict):
    """The bucket of each feature (CRC-32 of its bytes, modulo a count); forgets all of them before it holds too many."""

    def __init__(self, count: int):
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        from zlib import crc32

        if len(self) >= 1 << 18:
            self.clear()
        found = self[feature] = crc32(feature) % self.count
        return found


def text_buckets(raw: bytes | None, longest: int, known: Buckets) -> tuple[int, np.ndarray]:
    """The number of words and the buckets of all runs of 1 to ``longest`` words."""
    words = raw.translate(WORD_BYTES).split(b" ") if raw else []
    words = list(filter(None, words))
    found = list(map(known.__getitem__, words))
    for n in range(2, longest + 1):
        found += map(known.__getitem__, map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return len(words), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all ``texts`` fall in each bucket: ``buckets`` numbers, whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(text_buckets(text.as_py(), longest, known)[1], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    rows = pick(texts, text="string").select(F.col("text").cast("binary"))
    out = np.zeros(buckets, np.int64)
    for r in rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of shares, each count raised by one; floors go down."""
    s, t = have.astype(float), want.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first eight hex digits of SHA-256 of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored_rows(docs: DataFrame, gains: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row; ``gains`` goes to the tasks, of fixed size."""
    held = gains.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held, np.int64)
        known = Buckets(len(table))
        for batch in batches:
            found = [text_buckets(text.as_py(), longest, known) for text in batch.column(1)]
            columns = [[n for n, _ in found], [len(b) for _, b in found], [int(table[b].sum()) for _, b in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", F.col("text").cast("binary"))
    found = rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Blocks of sorted runs of (down, no_id, doc_id, row): lists of each, with the first of each as the block's head.

    ``down`` is the score with its sign turned, so that all four ascend. A run is what a task holds of
    its partition at once, ``RUN_ROWS`` rows at most.
    """
    names = ["down", "no_id", "doc_id", "row"]

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.Table.from_batches(held).sort_by([(n, "ascending") for n in names]).combine_chunks()
        n = run.num_rows
        bounds = pa.array(np.array([*range(0, n, BLOCK_ROWS), n], np.int32))
        heads = np.arange(0, n, BLOCK_ROWS)
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in run.columns]
        yield pa.RecordBatch.from_arrays(
            [*(c.take(pa.array(heads)) for c in columns), *(pa.ListArray.from_arrays(bounds, c) for c in columns)],
            names=[*names, *(f"all_{n}" for n in names)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from blocks(held)
                held, rows = [], 0
        if rows:
            yield from blocks(held)

    kinds = [f"{n} bigint" for n in names] + [f"all_{n} array<bigint>" for n in names]
    # a null doc_id comes last among ties
    no_id = F.col("doc_id").isNull().cast("bigint").alias("no_id")
    flat = rows.select((-F.col("score")).alias("down"), no_id, F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row")
    return flat.mapInArrow(run, ", ".join(kinds))


def range_slices(blocks: DataFrame, cuts: list[tuple[int, ...]]) -> DataFrame:
    """(range, n, head, rows): blocks cut at ``cuts``; range k holds what is not below cut k - 1 and is below cut k."""
    from bisect import bisect_left, bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, parts = [], []
            for i in range(batch.num_rows):
                rows = list(zip(*(c[i].values.to_pylist() for c in batch.columns), strict=True))
                at, k = 0, bisect_right(cuts, rows[0])
                while at < len(rows):
                    end = bisect_left(rows, cuts[k], at) if k < len(cuts) else len(rows)
                    if end > at:
                        which.append(k)
                        parts.append(rows[at:end])
                    at, k = end, k + 1
            flat = np.array([r for p in parts for r in p], np.int64).reshape(-1, 4)
            bounds = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
            heads = np.array([p[0] for p in parts], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which, pa.int32()), pa.array([len(p) for p in parts], pa.int32())]
                + [pa.array(heads[:, c]) for c in range(4)]
                + [pa.ListArray.from_arrays(bounds, pa.array(flat[:, c])) for c in range(4)],
                names=names,
            )

    names = ["range", "n", "h0", "h1", "h2", "h3", "r0", "r1", "r2", "r3"]
    kinds = ["range int", "n int"] + [f"{n} bigint" for n in names[2:6]] + [f"{n} array<bigint>" for n in names[6:]]
    return blocks.select([c for c in blocks.columns if c.startswith("all_")]).mapInArrow(run, ", ".join(kinds))


class Tournament:
    """A tree of matches between sorted slices: its winner is the least row of all of them.

    A slice enters at a free leaf when it is opened and its leaf is free again when it is used up; a taken
    row is replaced by the slice's next one, which plays the matches from its leaf to the root again.
    """

    END = (float("inf"),)

    def __init__(self):
        self.leaves, self.free = 1, [0]
        self.slices: list = [None]
        self.tree: list = [(self.END, 0)] * 2

    def play(self, leaf: int, row) -> None:
        tree, at = self.tree, leaf + self.leaves
        tree[at] = (row, leaf)
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def open(self, rows: list) -> None:
        if not self.free:  # twice the leaves, the old ones first
            old = [self.tree[self.leaves + i][0] for i in range(self.leaves)]
            self.free = list(range(2 * self.leaves - 1, self.leaves - 1, -1))
            self.slices += [None] * self.leaves
            self.leaves *= 2
            self.tree = [(self.END, 0)] * self.leaves + [(self.END, i) for i in range(self.leaves)]
            for leaf, row in enumerate(old):
                self.play(leaf, row)
        leaf = self.free.pop()
        self.slices[leaf] = iter(rows)
        self.play(leaf, next(self.slices[leaf]))

    def take(self, below=END) -> Iterator[tuple]:
        """The rows in order, as long as they are less than ``below``."""
        while (winner := self.tree[1])[0] < below:
            row, leaf = winner
            following = next(self.slices[leaf], self.END)
            if following is self.END:
                self.slices[leaf] = None
                self.free.append(leaf)
            self.play(leaf, following)
            yield row


def merged(slices: Iterable[tuple[tuple, list]]) -> Iterator[tuple]:
    """All rows in order, of sorted slices that come in the order of their heads.

    A slice is opened when the merge has come to its head, so of each run one slice is open at a time.
    """
    tree = Tournament()
    for head, rows in slices:
        yield from tree.take(head)
        tree.open(rows)
    yield from tree.take()


def merged_ranks(slices: DataFrame, starts: list[int], draw: int) -> DataFrame:
    """(row, rank) of the first ``draw`` rows; ``starts`` are the numbers of rows before each range."""
    from itertools import groupby, islice

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            which, heads = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[2:6]]
            for i, k in enumerate(which):
                rows = zip(*(c[i].values.to_pylist() for c in batch.columns[6:]), strict=True)
                yield k, tuple(h[i] for h in heads), list(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, group in groupby(rows_of(batches), key=lambda x: x[0]):
            order, rank = merged(x[1:] for x in group), starts[k]
            order = islice(order, max(0, draw - starts[k]))  # not a row more than the draw takes
            while part := [r[3] for r in islice(order, 1 << 14)]:
                ranks = np.arange(rank + 1, rank + len(part) + 1)
                rank += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(ranks)], names=["row", "rank"])

    heads = ["h0", "h1", "h2", "h3"]
    dealt = slices.repartition(max(1, len(starts)), "range").sortWithinPartitions("range", *heads)
    return dealt.mapInArrow(run, "row bigint, rank bigint")


def draw_ranks(rows: DataFrame, draw: int, eligible: int) -> DataFrame:
    """(row, rank): the ``draw`` highest scores of ``rows`` (doc_id, score, row), ties to the smaller doc_id."""
    blocks = materialize(sorted_runs(rows), "runs")
    ranges = min(MOST_RANGES, max(1, -(-eligible // RANGE_ROWS)))
    cuts = []
    if ranges > 1:
        order = ["down", "no_id", "doc_id", "row"]
        heads = blocks.select(*order)
        each = max(1, heads.count() // ranges)
        placed = numbered(heads, [F.col(c) for c in order], "at")
        cuts = sorted(tuple(r[c] for c in order) for r in placed.filter(f"at > 0 AND at % {each} = 0").collect())
    slices = materialize(range_slices(blocks, cuts), "slices")
    sizes = {r["range"]: r["n"] for r in slices.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts = [0]
    for k in range(len(cuts)):
        starts.append(starts[-1] + sizes.get(k, 0))
    needed = [s for s in starts if s < draw] or [0]
    return merged_ranks(slices.filter(F.col("range") < len(needed)), needed, draw)


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (10, 100),
    least_words: int = 20,
    buckets: int = 10_000,
    longest: int = 1,
    seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; rank is null for rows that aren't drawn.

    Of the rows of ``least_words`` words or more, the share (part, whole) of highest scores is drawn, rounded
    down; ties go to the smaller doc_id, and a null doc_id comes last. Every row counts as a document: repeated
    rows have the same score and ranks of their own. A null or empty text has no features and weight 0; an empty target leaves
    all shares to the smoothing. An empty table gives an empty result.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = scored_rows(docs, gains, longest, seed).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored", keep=True)
    with scratch(docs.sparkSession):
        eligible = scored.filter(F.col("n_words") >= least_words)
        n = eligible.count()
        ranks = materialize(draw_ranks(eligible, n * share[0] // share[1], n), "ranks", keep=True)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")

"""MinHash near-duplicates: banded candidates, Bayesian verification in sequence, exact confirmation.

A text's set of shingles gives a signature of ``bands * rows`` minima of hash functions. Two texts are
candidates if all rows of a band agree, which at a similarity of s escapes with probability
``(1 - s**rows) ** bands`` (below one in a million for 46 bands of 6 at 0.8). Candidates compare their
signatures a batch at a time: with a uniform prior, m agreements among the first n leave a posterior
probability of P(Bin(n + 1, s) <= m) that the similarity is s or more, and a pair goes once that is below the chosen
miss probability. What is left is confirmed on the whole sets.

Texts of equal sets are one node. In a bucket of a band, nodes are first compared with a single one, the
most central, then with another one; only nodes that are still not connected are compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, pick, scratch, text_key
from .simhash import WordHashes, components, marked, shingle_set, shingle_sets, with_both

BANDS, ROWS = 46, 6
#: Rows of a signature that are compared before the next decision.
BATCH = 32
#: A pair is dropped when its chance of being similar is below this.
MISS = 1e-6
#: Times that a bucket is compared with one of its nodes before its nodes are compared with each other.
STAR_TURNS = 2
#: Hash functions of the signatures by which nodes of a bucket are compared with each other, and nodes in one side of a cell.
LONG, CELL = 1_104, 1_024
#: Shingles that are hashed at once.
BLOCK = 1 << 13


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(grams: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each multiplier the least upper half of the products with all of ``grams``."""
    out = np.full(len(odd), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(grams), BLOCK):
        part = mixed(grams[at : at + BLOCK])
        for k in range(0, len(odd), 16):
            np.minimum(out[k : k + 16], (odd[k : k + 16, None] * part[None, :]).min(1), out=out[k : k + 16])
    return (out >> np.uint64(32)).astype(np.uint32)


def band_tokens(sig: np.ndarray, bands: int) -> np.ndarray:
    """One number for each band and its rows' values."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def signed_sets(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, place, key, n, tokens, sig) for every row: the text's key, digest and size of its set, bands, signature.

    A text without words has n = 0, no tokens and no signature.
    """
    odd = multipliers(bands * rows)

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        bounds = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(kind.to_pandas_dtype()) if parts else [], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, none = WordHashes(), np.zeros(0, np.uint64)
        for batch in batches:
            sizes, low, high, tokens, sigs = [], [], [], [], []
            for text in batch.column(2):
                grams = shingle_set(text.as_py(), shingle, known)
                if len(grams) == 1 and not grams[0]:  # no word
                    grams = none
                raw = grams.tobytes()
                sizes.append(len(grams))
                low.append(xxhash.xxh64_intdigest(raw, 1))
                high.append(xxhash.xxh64_intdigest(raw, 2))
                sigs.append(signature(grams, odd) if len(grams) else np.zeros(0, np.uint32))
                tokens.append(band_tokens(sigs[-1], bands) if len(grams) else none)
            digest = pa.StructArray.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)], names=["a", "b"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], digest, pa.array(sizes, pa.int64()), lists(tokens, pa.int64()), lists(sigs, pa.int32())],
                names=["doc_id", "place", "key", "n", "tokens", "sig"],
            )

    pair = "struct<a:bigint,b:bigint>"
    kind = f"doc_id bigint, place {pair}, key {pair}, n bigint, tokens array<bigint>, sig array<int>"
    return pick(docs, doc_id="bigint", text="string").select("doc_id", text_key(F.col("text")).alias("place"), "text").mapInArrow(run, kind)


def least_matches(hashes: int, batch: int, similar: tuple[int, int], miss: float) -> list[tuple[int, int]]:
    """(n, m) for each batch's end n: with less than m agreements among n the posterior is below ``miss``.

    From a uniform prior, m of n leave Beta(m + 1, n - m + 1), whose upper tail at s is the chance that of
    n + 1 draws with probability s at most m succeed.
    """
    (top, bottom), rare = similar, Fraction(miss)
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        chance, m = 0, 0
        while True:
            chance += comb(n + 1, m) * top**m * (bottom - top) ** (n + 1 - m)
            if m > n or chance >= rare * bottom ** (n + 1):
                break
            m += 1
        out.append((n, m))
    return out


def star_pairs(live: DataFrame, turn: int) -> DataFrame:
    """Candidates (a, b): each node of a bucket with the bucket's head.

    The head is the node that meets most others in all its buckets in the first turn, as the text does
    that others are copies of, and another one in each further turn.
    """
    weight = live.groupBy("node").agg((F.sum("met") if turn == 0 else F.min(F.xxhash64(F.lit(turn), "node"))).cast("bigint").alias("w"))
    ranked = live.join(weight, "node")
    head = ranked.groupBy("token").agg(F.max(F.struct("w", "node", "n", "root")).alias("h"))
    heads = head.select("token", F.col("h.node").alias("h_node"), F.col("h.n").alias("h_n"), F.col("h.root").alias("h_root"))
    met = live.join(heads, "token").filter("node <> h_node AND root <> h_root")
    return met.select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b"), "n", "h_n")


def cells(live: DataFrame) -> DataFrame:
    """(token, lo, hi, band, node, n, root, block): buckets as pairs of blocks of some ``CELL`` nodes, each with its two blocks.

    A bucket of one block is one cell; in a larger one a node stands in as many cells as there are blocks.
    """
    sizes = live.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int").alias("block")
    rows = live.join(sizes, "token").select("token", "band", "node", "n", "root", "blocks", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "band", "node", "n", "root", "block")


def cell_pairs(similar: tuple[int, int], steps: list[tuple[int, int]], rows: int) -> Callable:
    """Per cell the pairs of different roots that sizes and signatures leave, each in the first band that both share."""
    top, bottom = similar

    def left_over(one: list, two: list, same: bool, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (na, sa, ra, ga), (nb, sb, rb, gb) = one, two
        for at in range(0, len(na), 64):  # some rows of the cell at a time
            part = slice(at, at + 64)
            may = (ra[part, None] != rb) & (np.minimum(sa[part, None], sb) * bottom >= np.maximum(sa[part, None], sb) * top)
            if same:
                may &= na[part, None] < nb
            for k in range(band):
                met = np.ones(may.shape, bool)
                for j in range(k * rows, (k + 1) * rows):
                    met &= ga[part, j, None] == gb[:, j]
                may &= ~met
            i, j = np.nonzero(may)
            agreed, before = np.zeros(len(i), np.int64), 0
            for n, least in steps:
                agreed += (ga[i + at, before:n] == gb[j, before:n]).sum(1)
                stay = agreed >= least
                i, j, agreed, before = i[stay], j[stay], agreed[stay], n
            yield na[i + at], nb[j]

    def compared(columns: list[list], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        nodes, sizes, roots, blocks = (np.array(c) for c in columns[1:5])
        sigs = np.stack([np.frombuffer(g, np.uint16) for g in columns[5]])
        sides = [[x[blocks == side] for x in (nodes, sizes, roots, sigs)] for side in (lo, hi)]
        for a, b in left_over(*sides, lo == hi, columns[0][0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            for key, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True), strict=True):
                if key != cell:
                    if len(held) > 1:
                        yield from compared(list(zip(*held, strict=True)), *cell[1:])
                    held, cell = [], key
                held.append(row)
        if len(held) > 1:
            yield from compared(list(zip(*held, strict=True)), *cell[1:])

    return run


def long_signatures(rows: DataFrame, shingle: int, hashes: int) -> DataFrame:
    """(node, sig) of rows (node, text): signatures of ``hashes`` functions, 16 bits of each value."""
    odd = multipliers(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sigs = [signature(shingle_set(t.as_py(), shingle, known), odd).astype(np.uint16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], names=["node", "sig"])

    return rows.mapInArrow(run, "node bigint, sig binary")


def other_pairs(live: DataFrame, texts_of: Callable, shingle: int, similar: tuple[int, int], rows: int, miss: float) -> DataFrame:
    """Candidates (a, b) of the same bucket and different roots that long signatures leave a chance to be similar.

    Buckets are compared in cells of two blocks each, in tasks, so that no pair is a row before its signatures have spoken.
    """
    nodes = materialize(live.select("node").distinct(), "apart")
    sigs = materialize(long_signatures(texts_of(nodes), shingle, LONG), "long")
    dealt = cells(live).join(sigs, "node")
    dealt = dealt.select("token", "lo", "hi", "band", "node", "n", "root", "block", "sig").repartition("token", "lo", "hi")
    kept = dealt.sortWithinPartitions("token", "lo", "hi").mapInArrow(
        cell_pairs(similar, least_matches(LONG, BATCH, similar, miss), rows), "a bigint, b bigint"
    )
    return kept.distinct()


def promising(pairs: DataFrame, signatures: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """The pairs whose signatures leave them, batch after batch, a chance of ``miss`` or more to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3))
            )
            alive, agreed, before = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                agreed = agreed + (left[alive, before:n] == right[alive, before:n]).sum(1)
                stay = agreed >= least
                alive, agreed, before = alive[stay], agreed[stay], n
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], names=["a", "b"])

    both = with_both(pairs, signatures, "sig")
    return both.select("a", "b", "a_sig", "b_sig").mapInArrow(run, "a bigint, b bigint")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def promising_pairs(pairs: DataFrame, table: DataFrame, similar: tuple[int, int], steps: list[tuple[int, int]]) -> DataFrame:
    """Those of the candidates (a, b, n, h_n) that sizes and signatures leave a chance to be similar."""
    top, bottom = similar
    near = pairs.filter(F.least("n", "h_n") * bottom >= F.greatest("n", "h_n") * top).select("a", "b").distinct()
    near = materialize(near, "candidates")
    met = materialize(ends(near), "met")
    signatures = table.select(F.col("row").alias("node"), "sig").filter(marked(met)(F.col("node"))).join(met, "node", "left_semi")
    return promising(near, materialize(signatures, "signatures"), steps)


def confirmed(near: DataFrame, texts_of: Callable, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets, made from the texts anew, have a Jaccard similarity of ``similar`` or more."""
    top, bottom = similar
    near = materialize(near, "promising")
    sets = materialize(shingle_sets(texts_of(ends(near)), shingle), "sets")
    both = with_both(near, sets, "grams")
    shared = F.size(F.array_intersect("a_grams", "b_grams")).cast("bigint")
    union = F.size("a_grams") + F.size("b_grams") - shared
    return both.filter(shared * bottom >= union * top).select("a", "b")


def crowded(firsts: DataFrame) -> DataFrame:
    """(token, band, node, n, met, root): the bands that ``met`` > 1 nodes share; each node is its own root at first."""
    rows = firsts.select("node", "n", F.posexplode("tokens").alias("band", "token"))
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    return materialize(rows.join(met, "token").withColumn("root", F.col("node")), "crowded")


def minhash_components(
    docs: DataFrame, shingle: int = 4, similar: tuple[int, int] = (4, 5), bands: int = BANDS, rows: int = ROWS, miss: float = MISS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if their sets of runs of ``shingle`` words (A-Z lower-cased; a shorter text is one
    run) have a Jaccard similarity of ``similar`` or more; ``component_id`` is the least doc_id that links
    reach. Two texts at just that similarity stay apart by chance in less than two of a million cases, unless a third one
    connects them. Texts that are null or have no word are linked with nothing. Every row counts as a
    document: repeated rows are copies of each other, and rows of one doc_id are all kept if one is. A null doc_id counts as
    the largest, and its row is kept if no other row reaches it. An empty table gives an empty result.
    """
    steps = least_matches(bands * rows, BATCH, similar, miss)
    table = signed_sets(docs, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id())
    table = materialize(table, "signed", keep=True)
    with scratch(docs.sparkSession):
        sets = table.filter("n > 0").select(F.col("row").alias("node"), "place", "key", "n", "tokens")
        firsts = materialize(sets.dropDuplicates(["key"]), "firsts")
        texts = pick(docs, text="string").select(text_key(F.col("text")).alias("place"), "text")

        def texts_of(nodes: DataFrame) -> DataFrame:
            """(node, text) of ``nodes``; a map of their texts' keys keeps most other texts out of the join."""
            places = materialize(firsts.select("node", "place").join(nodes, "node"), "places")
            some = texts.filter(marked(places.select("place"))(F.col("place")))
            return some.groupBy("place").agg(F.any_value("text").alias("text")).join(places, "place").select("node", "text")

        live, links = crowded(firsts), None
        for turn in range(STAR_TURNS + 1):
            last = turn == STAR_TURNS
            if last:
                near = other_pairs(live, texts_of, shingle, similar, rows, miss)
            else:
                near = promising_pairs(star_pairs(live, turn), table, similar, steps)
            more = confirmed(near, texts_of, shingle, similar)
            links = materialize(more if links is None else links.unionByName(more), "links")
            roots = materialize(components(links), "components")
            if last:
                break
            named = live.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
            live = materialize(named.join(apart.select("token"), "token", "left_semi"), "live")
            if live.isEmpty():
                break
        rooted = firsts.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
        least = table.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
        rooted = materialize(rooted.join(least, "key"), "rooted")
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = materialize(rooted.join(ids, "root").select("key", "component_id"), "named", keep=True)
    found = table.select("doc_id", "key", "n").join(named, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

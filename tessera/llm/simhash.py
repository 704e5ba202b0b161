"""SimHash near-duplicates by pigeonring filtering.

A fingerprint of 64 bits stands for each document. Two fingerprints with at most ``tau``
differing bits are linked. Cut into ``m`` segments laid on a ring, some segment starts a
chain in which every l consecutive segments differ in at most floor(l * tau / m) bits
together. While that budget is zero the segments are equal, so the first
``ceil(m / tau) - 1`` segments of the chain form an equality key of some 27 bits; the rest
of the chain prunes candidates before the full Hamming check.

A key under which more than ``cap`` fingerprints meet is refined: as its bits agree, the
difference lies in the others, which are cut into ``m`` segments in the same way and give
longer keys, until so few bits are free that a bucket's size is bounded by them. No link is
lost.

Word shingles of near copies differ in many bits: at a Jaccard similarity of 0.8 on shingles
of five words some 10 of 64, too many for equality keys. ``similar_components`` therefore adds
to the SimHash neighbours all texts that share a rare shingle of their prefixes, which no pair
of that similarity escapes, and counts the similarity of each candidate exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from .runtime import SLICE_BYTES, drop_later, drop_path, materialize, new_path, pick, scratch, text_key, text_slices

SEGMENTS = 7
BUCKET_CAP = 256
#: Keys are refined while a bucket is above the cap and more bits than this are free.
FREE_BITS = 13
#: Texts are similar from a Jaccard similarity of 4/5 of their shingles.
SIMILAR = (4, 5)
#: One text in so many is counted to tell frequent shingles, and multiples of the least frequency in which they are told apart.
SAMPLE = 8
LEVELS = (1, 8, 64)
#: Sets that meet in a token are compared pair by pair up to this number; above it, each with one
#: of them in so many turns, and in full after that unless they are connected by then.
MET_CAP = 8
STAR_TURNS = 2
#: Sets of a token that stand in one block of its cells, about, and bits of a set's map at most.
MET_BLOCK = 1_024
MAP_BITS = 1 << 18
#: Bits of a map that says which shingles are frequent, or which sets candidates need.
MARKS = 1 << 24


def shingle_fingerprints(shingle: int) -> Callable[[list], np.ndarray]:
    """A function from texts to fingerprints (XXH64, seed 42, majority over all shingles)."""

    def fingerprints(texts: list) -> np.ndarray:
        from itertools import repeat

        import xxhash

        join, digest = b" ".join, xxhash.xxh64_intdigest
        out = np.zeros(len(texts), np.uint64)
        for k, text in enumerate(texts):
            words = text.encode().lower().split() if text else []
            if not words:
                continue
            if len(words) < shingle:
                out[k] = digest(join(words), 42)
                continue
            grams = map(join, zip(*(words[i:] for i in range(shingle)), strict=False))
            hashes = np.fromiter(map(digest, grams, repeat(42)), np.uint64, len(words) - shingle + 1)
            counts = np.zeros(64, np.int64)
            for i in range(0, len(hashes), 1 << 14):
                part = hashes[i : i + (1 << 14)]
                counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            bits = (2 * counts > len(hashes)).astype(np.uint8)
            out[k] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
        return out

    return fingerprints


def fingerprint_table(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, key, fingerprint) for every row; ``key`` tells rows of one doc_id apart by content.

    A text that is null or has no word has fingerprint 0. Hex digits are at ``hex_fingerprint``.
    """
    compute = shingle_fingerprints(shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = compute(batch.column(2).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], names=["doc_id", "key", "fp"])

    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, key struct<a:bigint,b:bigint>, fp bigint")


def ring_segments(bits: list[int], m: int) -> list[list[int]]:
    """``bits`` cut into m runs whose lengths differ by one at most."""
    n = len(bits)
    return [bits[i * n // m : (i + 1) * n // m] for i in range(m)]


def chain_length(m: int, tau: int) -> int:
    """How many segments from the start of a chain must agree in full."""
    return m if tau == 0 else -(-m // tau) - 1


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_keys(free: int, m: int, tau: int) -> list[tuple[int, list[int]]]:
    """For each chain start: the mask of the key's bits and the masks of the segments, in ring order."""
    segments = ring_segments([b for b in range(64) if free >> b & 1], m)
    length = chain_length(m, tau)
    out = []
    for i in range(m):
        ring = [mask_of(segments[(i + j) % m]) for j in range(m)]
        out.append((sum(ring[:length]), ring))
    return out


def forest_edges(rings: dict[int, list[int]], tau: int, m: int, most: int) -> Callable:
    """Per bucket a spanning forest of its links: chains first, then the full Hamming check."""

    def linked(fps: np.ndarray, checks: np.ndarray, ring: list[np.uint64], length: int) -> Iterator[tuple[int, int]]:
        rows = max(1, (1 << 18) // len(fps))
        for at in range(0, len(fps), rows):
            diff = fps[at : at + rows, None] ^ fps[None, :]
            total = np.zeros(diff.shape, np.uint8)
            ok = np.ones(diff.shape, bool)
            for n, mask in enumerate(ring, 1):
                total += np.bitwise_count(diff & mask)
                if n > length:
                    ok &= total <= (n * tau) // m
            ok &= np.bitwise_count(diff) <= tau
            ok &= np.bitwise_count(checks[at : at + rows, None] ^ checks[None, :]) <= most
            for i, j in zip(*np.nonzero(np.triu(ok, at + 1)), strict=True):
                yield int(i) + at, int(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = chain_length(m, tau)
        for batch in batches:
            left, right = [], []
            for path, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = members.values
                fps, nodes, checks = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.lexsort((nodes, fps))
                fps, nodes, checks = fps[order].view(np.uint64), nodes[order], checks[order].view(np.uint64)
                root = list(range(len(fps)))
                for i, j in linked(fps, checks, [np.uint64(x) for x in rings[path]], length):
                    a, b = i, j
                    while root[a] != a:
                        root[a] = a = root[root[a]]
                    while root[b] != b:
                        root[b] = b = root[root[b]]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        left.append(int(nodes[i]))
                        right.append(int(nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right)], names=["a", "b"])

    return run


def fingerprint_links(
    distinct: DataFrame, tau: int, most: int = 64, segments: int = SEGMENTS, cap: int = BUCKET_CAP
) -> DataFrame:
    """Links (a, b) between nodes that connect them as all pairs within ``tau`` bits do.

    ``distinct`` has (view, fp, node, check): fingerprints are compared within a view, each once;
    a pair also needs ``check`` values within ``most`` bits. Each bucket gives a spanning forest
    of its links, never all its pairs.
    """
    everything = (1 << 64) - 1
    starts = dict(enumerate(chain_keys(everything, segments, tau)))
    member = ["view", "fp", "node", "check"]

    def keyed(rows: DataFrame, options: dict[int, tuple[int, list[int]]]) -> DataFrame:
        made = F.array(
            *(
                F.struct(F.lit(p).cast("bigint").alias("path"), F.col("fp").bitwiseAND(F.lit(signed(key))).alias("part"))
                for p, (key, _) in options.items()
            )
        )
        return rows.select(*member, F.explode(made).alias("k")).select("k.path", "k.part", *member)

    rows, found, level = keyed(distinct, starts), None, 0
    while True:
        level += 1
        bucket = ["view", "path", "part"]
        sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = materialize(rows.join(sizes, bucket), f"chains{level}")
        free = max(64 - key.bit_count() for key, _ in starts.values())
        last = free <= FREE_BITS or chain_length(segments, tau) == segments
        small = rows if last else rows.filter(F.col("n") <= cap)
        rings = {p: ring for p, (_, ring) in starts.items()}
        buckets = small.groupBy(*bucket).agg(F.collect_list(F.struct("fp", "node", "check")).alias("members"))
        links = buckets.select("path", "members").mapInArrow(forest_edges(rings, tau, segments, most), "a bigint, b bigint")
        found = links if found is None else found.unionByName(links)
        large = rows.filter(F.col("n") > cap)
        paths = [] if last else sorted(r["path"] for r in large.select("path").distinct().collect())
        if not paths:
            return found.distinct()
        # a fingerprint goes on under the keys that grow from its own large buckets only
        finer = {
            p * segments + i: (starts[p][0] | more, ring)
            for p in paths
            for i, (more, ring) in enumerate(chain_keys(everything & ~starts[p][0], segments, tau))
        }
        masks = distinct.sparkSession.createDataFrame(
            [(p // segments, p, signed(key)) for p, (key, _) in finer.items()], "old bigint, path bigint, mask bigint"
        )
        # one row for each chain start of a path, bounded by the number of keys
        rows = large.withColumnRenamed("path", "old").drop("part", "n").join(F.broadcast(masks), "old")
        rows = rows.select("path", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), *member)
        starts = finer


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of ``links`` can reach. Nodes without links are absent.

    Alternating large-star and small-star rounds, each written to the shared folder. Minima are
    aggregated before they are joined back, so a hub's neighbours never meet in one task.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()

    def written(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        drop_later(path)
        back = spark.read.schema("u bigint, v bigint").parquet(path)
        mark = back.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return back, path, tuple(mark)

    edges, path, mark = written(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = star.groupBy("u").agg(F.min("v").alias("m"))
        moved = star.join(lower, "u")
        small = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        after, after_path, after_mark = written(small)
        drop_path(spark, path)
        done = after_mark == mark
        edges, path, mark = after, after_path, after_mark
        if done:
            break
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def simhash_components(docs: DataFrame, shingle: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, key, fp, component_id) for every row of ``docs``.

    Fingerprints within ``tau`` bits are linked; ``component_id`` is the least doc_id of all
    documents that links reach (a null doc_id counts as the largest). Repeated rows, null and
    empty texts (fingerprint 0) are linked like any other; an empty table gives an empty result.
    """
    table = materialize(fingerprint_table(docs, shingle), "fingerprints", keep=True)
    with scratch(docs.sparkSession):
        distinct = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        nodes = distinct.select(F.lit(0).alias("view"), "fp", F.col("fp").alias("node"), F.col("fp").alias("check"))
        roots = components(fingerprint_links(nodes, tau))
        rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
        rooted = materialize(rooted, "roots")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named", keep=True)
    return table.join(named, "fp").select("doc_id", "key", "fp", "component_id")


class WordHashes(dict):
    """XXH64 of words, seed 42; forgets all of them before it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def shingle_set(text: str | None, shingle: int, hashes: WordHashes) -> np.ndarray:
    """The distinct runs of ``shingle`` words as ascending hashes of 64 bits.

    A shorter text is one run; one without a word has the set {0}.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(w))
    m = len(w) - width + 1
    out = np.full(m, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def majority_bits(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]


def star_pairs(large: DataFrame, turn: int) -> DataFrame:
    """One candidate (a, b) a set: the head of most of its tokens; a token's head is a set that holds it.

    In the first turn it is the set whose tokens are met most, as the text is that others are copies of,
    then another one each turn. These pairs only connect what is alike before it is compared in full,
    so one for each set is enough.
    """
    first = -F.sum("met").over(Window.partitionBy("node")) if turn == 0 else F.lit(0)
    large = large.withColumn("r", F.struct(first.cast("bigint").alias("w"), F.xxhash64(F.lit(turn), "node").alias("x")))
    head = F.min(F.struct("r", "node", "n", "at", "root")).alias("h")
    met = met_pairs(large, large.groupBy("token").agg(head).select("token", "h.*"), ("a_node", "b_node"))
    often = met.groupBy("a_node", "b_node").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy("a_node").agg(F.max_by("b_node", F.struct("n", F.xxhash64(F.lit(turn), "b_node"))).alias("b_node"))
    return best.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def bit_map(cells: DataFrame) -> np.ndarray:
    """A map of ``MARKS`` bits, as bytes, with those of the numbers ``c`` set; made in tasks, a few MB on the driver."""
    bits = cells.groupBy(F.bitmap_bucket_number("c").alias("k"))
    marks = np.zeros(MARKS // 8 + 4096, np.uint8)
    for r in bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits")).collect():
        marks[r["k"] * 4096 : r["k"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return marks


def is_marked(marks: np.ndarray, cells: np.ndarray) -> np.ndarray:
    # bucket k of the map holds the numbers from 32,768 (k - 1) + 1 on; number 0 is in bucket 0
    at = np.where(cells > 0, cells + 32_767, 0)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def common_shingles(rows: DataFrame, shingle: int) -> list[bytes]:
    """Maps of the cells in which shingles fall that many texts hold, for rising numbers of texts.

    One text in ``SAMPLE`` is counted. The least number is such that the first map is an eighth full at
    most. The maps only fix the order in which prefixes are taken, which may be any that is the same for
    all sets; so no result depends on them, but frequent shingles would make many candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), shingle, known) for text in batch.column(0)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    texts = rows.filter(F.pmod(F.col("key.a"), F.lit(SAMPLE)) == 0).dropDuplicates(["key"]).select("text")
    counts = texts.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = materialize(counts, "common")
    sizes = counts.groupBy(F.least("n", F.lit(4_096)).alias("n")).agg(F.count(F.lit(1)).alias("shingles")).orderBy(F.desc("n")).collect()
    least, held = 4_097, 0
    for r in sizes:
        held += r["shingles"]
        if held > MARKS // 8:
            break
        least = r["n"]
    cell = F.col("h").bitwiseAND(F.lit(MARKS - 1)).alias("c")
    return [bit_map(counts.filter(F.col("n") >= least * step).select(cell)).tobytes() for step in LEVELS]


def prefix_table(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, n, prefix, fp): the size of each text's set of shingles, the prefix of the set, its SimHash.

    A set's prefix is the first n - ceil(0.8 n) + 1 of its n shingles, rare ones first, ties by hash:
    an order that is the same for all. Sets of a similarity of 0.8 share a shingle of their prefixes.
    """
    common = common_shingles(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maps = WordHashes(), [np.frombuffer(m, np.uint8) for m in common]
        for batch in batches:
            sizes, prefixes, fps = [], [], []
            for text in batch.column(2):
                grams = shingle_set(text.as_py(), shingle, known)
                fps.append(majority_bits(grams))
                cells = (grams & np.uint64(MARKS - 1)).astype(np.int64)
                levels = sum((is_marked(m, cells).astype(np.int8) for m in maps), np.zeros(len(grams), np.int8))
                if levels.any():
                    grams = grams[np.argsort(levels, kind="stable")]
                sizes.append(len(grams))
                prefixes.append(grams[: len(grams) - -(-len(grams) * SIMILAR[0] // SIMILAR[1]) + 1])
            lengths = np.array([0, *(len(p) for p in prefixes)], np.int64)
            flat = pa.array(np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int32()), lists, pa.array(np.array(fps, np.uint64).view(np.int64))],
                names=["doc_id", "key", "n", "prefix", "fp"],
            )

    return rows.mapInArrow(run, "doc_id bigint, key struct<a:bigint,b:bigint>, n int, prefix array<bigint>, fp bigint")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) of rows (node, text): the whole sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start, end in text_slices(batch.column(1).to_numpy(zero_copy_only=False), SLICE_BYTES):
                sets = [shingle_set(text.as_py(), shingle, known) for text in batch.column(1).slice(start, end - start)]
                bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], names=["node", "grams"])

    return rows.mapInArrow(run, "node bigint, grams array<bigint>")


def sets_of(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) of ``nodes`` (node, key), from the texts of their keys."""
    once = texts.filter(marked(nodes.select("key"))(F.col("key"))).groupBy("key").agg(F.any_value("text").alias("text"))
    return shingle_sets(once.join(nodes, "key").select("node", "text"), shingle)


def simhash_pairs(sets: DataFrame, tau: int) -> DataFrame:
    """Candidates (a, b) of fingerprints within ``tau`` bits: heads of a fingerprint, and each text with its head."""
    heads = materialize(sets.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    nodes = heads.select(F.lit(0).alias("view"), "fp", F.col("head").alias("node"), F.col("fp").alias("check"))
    same = sets.select("node", "fp").join(heads, "fp").filter("head < node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return fingerprint_links(nodes, tau).unionByName(same)


def prefix_keys(firsts: DataFrame) -> DataFrame:
    """(token, node, n, at, met): the shingles of prefixes that ``met`` > 1 sets hold there."""
    rows = firsts.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    return materialize(rows.join(met, "token").withColumn("root", F.col("node")), "prefixes")


def shingle_maps(sets: DataFrame) -> DataFrame:
    """(node, map) of rows (node, grams): a map with a bit for each shingle's hash, sixteen times as many bits as shingles or more.

    Its length is a power of two and ``MAP_BITS`` at most, so that maps of two lengths compare when the longer is folded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for grams in batch.column(1):
                hashes = grams.values.to_numpy(zero_copy_only=False).view(np.uint64)
                bits = np.zeros(min(MAP_BITS, max(512, 1 << (16 * len(hashes) - 1).bit_length())), bool)
                bits[hashes & np.uint64(len(bits) - 1)] = True
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["node", "map"])

    return sets.mapInArrow(run, "node bigint, map binary")


def one_of_equal(live: DataFrame) -> DataFrame:
    """``live`` with one token of those that the same sets hold, as the shingles of a passage are."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)]
    members = live.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *hashes)
    tokens = members.groupBy("size", "x1", "x2").agg(F.min("token").alias("token"))
    blocks = F.ceil(F.col("size") / MET_BLOCK).cast("int").alias("blocks")
    return live.select("token", "node", "n", "root").join(tokens.select("token", blocks), "token")


def compared_maps() -> Callable:
    """Rows (token, lo, hi, block, node, n, root, map) by cells to the pairs (a, b) that sizes and maps leave.

    Two sets that differ in d shingles have maps that differ in d bits at most, whatever part of the maps is counted.
    """
    top, both = SIMILAR[0], sum(SIMILAR)

    def left_over(one: tuple, two: tuple, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (na, sa, ra, ma), (nb, sb, rb, mb) = one, two
        for at in range(0, len(na), 64):  # some rows of the cell at a time
            part = slice(at, at + 64)
            total = sa[part, None] + sb
            shared = -(-total * top // both)  # that a similarity of 0.8 needs
            i, j = np.nonzero(apart[part] & (ra[part, None] != rb) & (np.minimum(sa[part, None], sb) >= shared))
            most, differ, words = (total - 2 * shared)[i, j], np.zeros(len(i), np.int64), ma.shape[1]
            i, before, step = i + at, 0, max(1, words // 8)
            while before < words and len(i):
                cut = [slice(k, k + (1 << 16)) for k in range(0, len(i), 1 << 16)]
                end = min(words, before + step)
                differ += np.concatenate([np.bitwise_count(ma[i[c], before:end] ^ mb[j[c], before:end]).sum(1, dtype=np.int64) for c in cut])
                stay = differ <= most
                i, j, most, differ, before, step = i[stay], j[stay], most[stay], differ[stay], end, 2 * step
            yield na[i], nb[j]

    def compared(columns: list[tuple], one_block: bool) -> Iterator[pa.RecordBatch]:
        blocks, nodes, sizes, roots = (np.array(c, np.int64) for c in columns[:4])
        lengths = np.array([len(m) for m in columns[4]])
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            # sets of a similarity of 0.8 have maps of one length or of neighbouring ones
            for other in (own, np.flatnonzero(lengths == 2 * length)):
                mine, theirs = (np.frombuffer(b"".join(columns[4][x] for x in rows), np.uint64) for rows in (own, other))
                mine = mine.reshape(len(own), -1)
                theirs = np.bitwise_or.reduce(theirs.reshape(len(other), 1 if other is own else 2, -1), axis=1) if len(other) else mine[:0]
                apart = np.ones((len(own), len(other)), bool) if one_block else blocks[own][:, None] != blocks[other]
                if other is own:
                    apart &= nodes[own][:, None] < nodes[other]
                sides = [(nodes[x], sizes[x], roots[x], maps) for x, maps in ((own, mine), (other, theirs))]
                for a, b in left_over(*sides, apart):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
            for key, row in zip(keys, zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True), strict=True):
                if key != cell:
                    if len(held) > 1:
                        yield from compared(list(zip(*held, strict=True)), cell[1] == cell[2])
                    held, cell = [], key
                held.append(row)
        if len(held) > 1:
            yield from compared(list(zip(*held, strict=True)), cell[1] == cell[2])

    return run


def met_apart(live: DataFrame, firsts: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Candidates (a, b) of different roots that share a token, if their sizes and maps leave a similarity of 0.8 possible.

    The sets of a token are compared in cells of two blocks each, in tasks, so that no pair is a row before its maps have spoken.
    """
    live = materialize(one_of_equal(live), "apart")
    nodes = materialize(firsts.select("node", "key").join(live.select("node").distinct(), "node"), "apart_nodes")
    maps = materialize(shingle_maps(sets_of(nodes, texts, shingle)), "maps")
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int").alias("block")
    rows = live.select("token", "node", "n", "root", "blocks", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(maps, "node").select(
        "token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "root", "map"
    )
    dealt = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return dealt.mapInArrow(compared_maps(), "a bigint, b bigint").distinct()


def met_pairs(left: DataFrame, right: DataFrame, sides_as: tuple[str, str] | None = None) -> DataFrame:
    """Candidates (a, b) of different roots that can be similar, if the token is the first that they share."""
    sides = [
        rows.select("token", *(F.col(c).alias(side + c) for c in ("node", "n", "at", "root")))
        for side, rows in (("a_", left), ("b_", right))
    ]
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    met = sides[0].join(sides[1], "token").filter("a_node <> b_node AND a_root <> b_root")
    met = met.filter(most * sum(SIMILAR) >= (F.col("a_n") + F.col("b_n")) * SIMILAR[0])
    if left is right:  # each pair once
        met = met.filter("a_node < b_node")
    return met.select(*sides_as) if sides_as else met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def marked(keys: DataFrame) -> Callable[[Column], Column]:
    """A function from a column to a predicate that holds for all values of ``keys`` and few others.

    A map of fixed size, whatever the number of keys, keeps most other rows out of joins.
    """
    cell = lambda key: F.pmod(F.xxhash64(key), F.lit(MARKS))
    marks = bit_map(keys.select(cell(keys.columns[0]).alias("c"))).tobytes()

    @F.pandas_udf(BooleanType())
    def wanted(cells: pd.Series) -> pd.Series:
        return pd.Series(is_marked(np.frombuffer(marks, np.uint8), cells.to_numpy()))

    return lambda key: wanted(cell(key))


def with_both(pairs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of both nodes' rows, as a_* and b_*."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in cols)), side)
    return pairs


def similar_pairs(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more, counted exactly.

    Prefixes, a fifth of the sets, come first: what two sets share stands in both prefixes, or behind
    the prefix that ends first. So the prefixes' common shingles and the larger rest bound what is
    shared, and a pair goes on only if that can be enough. Whole sets are made from the texts anew,
    for the nodes of those pairs.
    """
    enough = lambda shared: shared * sum(SIMILAR) >= (F.col("a_n") + F.col("b_n")) * SIMILAR[0]
    rest = F.greatest(*(F.col(f"{s}_n") - F.size(f"{s}_prefix") for s in "ab"))
    near = with_both(pairs.distinct(), firsts, "n", "prefix")
    near = near.filter(enough(F.size(F.array_intersect("a_prefix", "b_prefix")) + rest)).select("a", "b", "a_n", "b_n")
    near = materialize(near, "near")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    nodes = materialize(firsts.select("node", "key").join(ends, "node"), "nodes")
    both = with_both(near, materialize(sets_of(nodes, texts, shingle), "sets"), "grams")
    return both.filter(enough(F.size(F.array_intersect("a_grams", "b_grams")))).select("a", "b")


def similar_components(docs: DataFrame, shingle: int = 5, tau: int = 3) -> DataFrame:
    """(doc_id, key, root): one root for all rows that exact and near copies connect.

    Two texts are linked if their sets of ``shingle`` words have a Jaccard similarity of 0.8 or
    more. Candidates are SimHash neighbours within ``tau`` bits and all pairs that share a token
    of their prefixes, which none of that similarity escapes. Where many share a token, each is
    compared with one of them first; what is then still apart is compared in cells. Null and empty
    texts are copies of each other.
    """
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", text_key(F.coalesce("text", F.lit(""))).alias("key"), "text")
    table = materialize(prefix_table(rows, shingle).withColumn("node", F.monotonically_increasing_id()), "prefix_table")
    first = table.groupBy("key").agg(F.min("node").alias("node"))
    firsts = materialize(table.join(first.select("node"), "node", "left_semi").drop("doc_id"), "firsts")
    texts = rows.select("key", "text")
    pairs, live, links = simhash_pairs(firsts.select("node", "fp"), tau), prefix_keys(firsts), None
    for turn in range(STAR_TURNS + 1):
        last = turn == STAR_TURNS
        large = live.filter(F.col("met") > MET_CAP)
        if turn == 0:
            small = live.filter(F.col("met") <= MET_CAP)
            pairs = pairs.unionByName(met_pairs(small, small)).unionByName(star_pairs(large, turn))
        else:
            pairs = met_apart(large, firsts, texts, shingle) if last else star_pairs(large, turn)
        more = similar_pairs(pairs, firsts, texts, shingle)
        links = materialize(more if links is None else links.unionByName(more), "links")
        roots = materialize(components(links), "components")
        if last:
            break
        named = large.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ends = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        live = materialize(named.join(ends.select("token"), "token", "left_semi"), "live")
        if live.isEmpty():
            break
    named = firsts.select("node", "key").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return table.select("doc_id", "key").join(named, "key")


def hex_fingerprint(fp) -> object:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 5, tau: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the least doc_id, ties by content.

    All columns come back as they were. Rows alike in doc_id and text count as one document.
    """
    with scratch(docs.sparkSession):
        winners = materialize(least_of_each(similar_components(docs, shingle, tau)), "winners", keep=True)
    plain, names = positional_with_key(docs)
    kept = plain.join(winners, plain["_id"].eqNullSafe(winners["w_id"]) & (plain["_key"] == winners["w_key"]))
    cols = [f"c{i}" for i in range(len(names))]
    once = kept.filter("n = 1").select(*cols)
    # rows alike in doc_id and text: the least by all other columns, as JSON and in bytes
    rest = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    again = kept.filter("n > 1").groupBy("_id", "_key").agg(F.min_by(F.struct(*cols), rest).alias("r")).select("r.*")
    return once.unionByName(again).toDF(*names)


def least_of_each(groups: DataFrame) -> DataFrame:
    """(w_id, w_key, n) of the row of the least doc_id of each root, ties by content; ``n`` rows are alike in both."""
    groups = materialize(groups, "groups")
    best = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("w")
    )
    winners = best.select(F.col("w.doc_id").alias("w_id"), F.col("w.key").alias("w_key"))
    copies = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    return winners.join(
        copies, winners.w_id.eqNullSafe(copies.doc_id) & (winners.w_key == copies.key)
    ).select("w_id", "w_key", "n")


def positional_with_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    plain = plain.withColumn("_id", F.col(f"c{names.index('doc_id')}").cast("bigint"))
    text = F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))
    return plain.withColumn("_key", text_key(text)), names

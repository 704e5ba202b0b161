"""Minimax contiguous partition: shards of atomic groups, the largest as small as can be.

Groups stand in a fixed order, by a 60-bit hash of their key. The smallest capacity under
which a greedy fill needs no more than the given shards is found by binary search; the
greedy fill's cuts are the shard bounds.

No task or driver holds the list of groups. The driver works on ranges of hash values with
their total bytes and row count, which stand for the groups in them. Taking ranges as
unsplittable gives a feasible capacity, taking them as a fluid an infeasible one; the ranges
in which a cut may fall between the two are split further until the cuts are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bucket_count, materialize, pick, prefix_sums

KEY_BITS = 60
#: A range is split into 2**STEP_BITS ranges at a time.
STEP_BITS = 12


@dataclass(frozen=True)
class Range:
    """Hash values [start, start + 2**bits): total size, largest group, number of groups."""

    start: int
    bits: int
    size: int
    largest: int
    groups: int


def greedy_cuts(ranges: list[Range], capacity: int) -> list[int]:
    """Indexes at which a greedy fill opens a new shard, every range unsplittable."""
    cuts, held = [], 0
    for i, r in enumerate(ranges):
        if held and held + r.size > capacity:
            cuts.append(i)
            held = 0
        held += r.size
    return cuts


def smallest_capacity(ranges: list[Range], shards: int) -> int:
    """The least capacity for which unsplittable ranges fit into ``shards`` shards."""
    low, high = max((r.size for r in ranges), default=0), sum(r.size for r in ranges)
    low = max(low, -(-high // shards))
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(ranges, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def fluid_bound(ranges: list[Range], shards: int) -> int:
    """No capacity below this can do: an even share, or the largest group."""
    return max([-(-sum(r.size for r in ranges) // shards), *(r.largest for r in ranges)], default=0)


def cut_candidates(ranges: list[Range], shards: int, low: int, high: int) -> list[int]:
    """Ranges of several groups in which a greedy fill of a capacity from low to high may cut."""
    before, total = [], 0
    for r in ranges:
        before.append(total)
        total += r.size
    found = set()
    least = most = 0
    for _ in range(shards - 1):
        # A fill that starts between least and most ends at start + capacity, less a part of one group.
        least_end, most_end = least + low, most + high
        lowest = most_end
        for i, r in enumerate(ranges):
            if before[i] + r.size > least_end and before[i] <= most_end:
                lowest = min(lowest, before[i] if r.groups > 1 else min(before[i], least_end))
                if r.groups > 1:
                    found.add(i)
        least, most = min(lowest, least_end), most_end
        if least_end > total:
            break
    return sorted(found)


def shard_bounds(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """The hash values at which shards 1, 2, ... begin, and the smallest capacity.

    ``groups`` has (h, size), one row per group, and is read once per level: each level brings
    2**12 ranges at most for each range that a cut may fall in.
    """

    def split(ranges: list[Range] | None, bits: int) -> list[Range]:
        rows = groups
        if ranges is not None:
            starts = [r.start >> (bits + STEP_BITS) for r in ranges]
            rows = groups.filter(F.shiftright("h", bits + STEP_BITS).isin(starts))
        got = (
            rows.groupBy(F.shiftright("h", bits).alias("p"))
            .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        return sorted((Range(r["p"] << bits, bits, r["size"], r["largest"], r["n"]) for r in got), key=lambda r: r.start)

    bits = KEY_BITS - STEP_BITS
    ranges = split(None, bits)
    while True:
        high = smallest_capacity(ranges, shards)
        low = fluid_bound(ranges, shards)
        open_ranges = [ranges[i] for i in cut_candidates(ranges, shards, low, high) if ranges[i].bits]
        if not open_ranges:
            break
        by_bits: dict[int, list[Range]] = {}
        for r in open_ranges:
            by_bits.setdefault(r.bits, []).append(r)
        gone = {r.start for r in open_ranges}
        ranges = [r for r in ranges if r.start not in gone]
        for b, some in by_bits.items():
            ranges += split(some, b - STEP_BITS)
        ranges.sort(key=lambda r: r.start)
    capacity = smallest_capacity(ranges, shards)
    return [ranges[i].start for i in greedy_cuts(ranges, capacity)], capacity


def assign_shards(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Size is the text's UTF-8 bytes plus ``overhead``; equal texts are one group, and so are null
    texts (size ``overhead``, CRC 0). Slots count from 0 within a shard without gaps; rows alike
    in doc_id and text take neighbouring slots in any order. Law ``bytes``: the largest shard is
    as small as contiguous atomic groups allow, so ``grown_shard`` is null. An empty table gives
    an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    digest = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    rows = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), digest).otherwise(F.lit(0).cast("bigint")).alias("h"),
    )
    rows = materialize(rows, "sized")
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    bounds, _ = shard_bounds(groups, shards)
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (F.col("h") >= F.lit(b)).cast("int")
    placed = rows.withColumn("shard", shard)
    n_buckets = bucket_count(rows.count())
    placed = placed.withColumn("_mix", F.xxhash64("doc_id", "h"))
    placed = placed.withColumn("_bucket", F.pmod("_mix", F.lit(n_buckets))).withColumn("_one", F.lit(1).cast("bigint"))
    slotted = prefix_sums(placed, ["shard"], "_bucket", ["_mix", "doc_id", "h"], "_one", "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

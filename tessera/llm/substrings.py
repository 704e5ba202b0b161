"""Removal of repeated substrings by longest-previous-factor arrays.

A byte is redundant if a string of ``length`` bytes that covers it starts at another place too.
No machine holds the corpus' suffix array; it is needed only where repeats can be:

1. The window of ``LEAST_FACTOR`` bytes (``length``, if that is less) at every position takes the least
   hash among its 32-byte grams as its anchor, so equal windows have equal anchors, and equal strings of
   ``length`` bytes, which begin with equal windows, too. Neighbouring windows of one anchor form a
   span. An anchor that stands once in the corpus has no repeats, and most do.
2. Equal spans are counted by hash. All but the first copy are repeats as a whole.
3. One copy of each distinct span goes to its anchor's bucket, with ``length`` bytes from each window's
   start where the text has them. There, previous and next smaller positions in suffix order give the
   longest previous factor of every start whose window stands there again; where it reaches ``length``,
   the string is a repeat and its source an earlier copy.
4. A bucket of over ``cap`` distinct spans or ``cap_bytes`` is not gathered: its windows are counted by hash, and
   their first ``LEAST_FACTOR`` bytes by another, so that a note of a shorter factor doesn't depend on the cap.

Matches never cross documents. ``keep="first"`` leaves the first copy of every string in place
(by doc_id, then content, then position); ``keep="none"`` removes that too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import SLICE_BYTES, drop_path, new_path, pick, text_key, text_slices

LENGTH = 400
GRAM = 32
#: Distinct spans of an anchor, and bytes of them, that are gathered for one suffix order.
GROUP_CAP, GROUP_BYTES = 4_096, 8 << 20
#: Windows whose hashes stand in one row.
WINDOW_ROWS = 1 << 14
#: Bits of a position in a slice of texts; a text has fewer bytes than 2**31.
POSITION_BITS = 32
#: Bytes, some fifty words, from which a factor is worth a note.
LEAST_FACTOR = 256
#: Bytes of spans that one suffix order takes at once, and that a bucket should hold about.
ORDER_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
#: Tasks that buckets are dealt to at most; then each takes more of them, one suffix order after the other.
MOST_BUCKETS = 20_000

DOC = "doc_id bigint, ka bigint, kb bigint"
INTERVAL = f"{DOC}, s bigint, e bigint, f bigint"


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes (a power of two) from every position."""
    h, factor, width = raw.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, 2 * width
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: of a block's end and the next block's beginning."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    to_here = np.minimum.accumulate(blocks, axis=1).ravel()
    from_here = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_here[: n - width + 1], to_here[width - 1 : n])


def anchored_spans(raws: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first, last, anchor hash, several) of runs of windows whose anchors are one gram, at one place or several.

    Positions are in the document.
    """
    sizes = np.array([len(r) for r in raws], np.int64)
    begins = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - length + 1, 0)
    total = int(many.sum())
    if not total:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    hashes = gram_hashes(np.frombuffer(b"".join(raws), np.uint8), gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    # the leftmost of equal hashes: the position fills the low bits, as many in every slice, so that equal windows agree
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_minimum(ranked, length - gram + 1) & low
    doc = np.repeat(np.arange(len(raws)), many)
    start = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + begins[doc]
    anchor = least[start]
    # windows whose anchors are equal grams stay together, else each window of a run of one letter would be a span
    mixed, new_doc = hashes[anchor.astype(np.int64)], np.diff(doc, prepend=-1) != 0
    cut = np.flatnonzero(new_doc | np.concatenate([[True], mixed[1:] != mixed[:-1]]))
    end = np.append(cut[1:], total) - 1
    d = doc[cut]
    return d, start[cut] - begins[d], start[end] - begins[d], mixed[cut], anchor[cut] != anchor[end]


def find_spans(length: int, window: int, gram: int) -> Callable:
    """Rows (doc_id, ka, kb, text) to spans of windows with their anchor's and content's hashes.

    The content reaches to ``stop``: ``length`` bytes from the last window's start, or the text's end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for start, end in text_slices(texts, SLICE_BYTES):
                raws = [t.encode() if t else b"" for t in texts[start:end]]
                doc, first, last, anchor, several = anchored_spans(raws, window, gram)
                views = [memoryview(r) for r in raws]
                stop = np.minimum(last + length, np.array([len(r) for r in raws], np.int64)[doc])
                spans = zip(doc.tolist(), first.tolist(), stop.tolist(), strict=True)
                content = np.frombuffer(b"".join(digest(views[d][a:b]) for d, a, b in spans), np.int64).reshape(-1, 2)
                rows = pa.array(doc + start)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(3)), pa.array(anchor.view(np.int64)),
                     pa.array(content[:, 0].copy()), pa.array(content[:, 1].copy()), pa.array(first), pa.array(last), pa.array(stop), pa.array(several)],
                    names=["doc_id", "ka", "kb", "h", "ca", "cb", "first", "last", "stop", "several"],
                )

    return run


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a number that orders as they do; zeros follow the end."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : n + i]
    return out


def order_to(raw: np.ndarray, length: int) -> np.ndarray:
    """Every suffix's rank by its first ``length`` bytes; equal prefixes have equal ranks.

    Ranks by a prefix give those by one three times as long, or twice where three ranks don't fit in one number.
    """
    n = len(raw)
    rank = np.unique(words_at(raw), return_inverse=True)[1].astype(np.int64)
    reach = 8

    def after(step: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - step)] = rank[step:] + 1
        return out

    while reach < length:
        width = int(rank.max(initial=0)) + 2
        first, second = min(reach, length - reach), min(2 * reach, length - reach)
        key = rank * width + after(first)
        if second > first and width**3 < 1 << 63:
            key, first = key * width + after(second), second
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        reach += first
    return rank


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For every element the place of the nearest smaller one before it, -1 for none.

    All elements follow their links at once: a link to a larger element moves on to where that
    one links, as nothing between is smaller.
    """
    link = np.arange(len(x)) - 1
    open_ = np.flatnonzero((link >= 0) & (x[link] > x))
    while len(open_):
        link[open_] = link[link[open_]]
        to = link[open_]
        open_ = open_[(to >= 0) & (x[to] > x[open_])]
    return link


def common_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, ``length`` at most, the suffixes at ``a`` and ``b`` have in common."""
    out = np.full(len(a), length, np.int64)
    alive = np.arange(len(a))
    for at in range(0, length, 8):
        if not len(alive):
            break
        differ = words[a[alive] + at] ^ words[b[alive] + at]
        ended = differ != 0
        first = (differ[ended].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        out[alive[ended]] = np.minimum(at + first, length)
        alive = alive[~ended]
    return out


def repeated_ranks(words: np.ndarray, head: np.ndarray, full: np.ndarray, starts: np.ndarray, window: int, length: int) -> np.ndarray | None:
    """Ranks of ``starts`` by their ``length`` bytes, within equal windows; windows themselves are in the order of their hashes.

    ``head`` and ``full`` are hashes of the windows and of the whole strings. None if strings of equal hashes differ.
    """
    order = np.lexsort((full, head))
    new = np.concatenate([[True], (head[order][1:] != head[order][:-1]) | (full[order][1:] != full[order][:-1])])
    kind = np.cumsum(new) - 1
    one = order[new]  # a start of each string
    own, others = starts[one[kind[~new]]], starts[order[~new]]
    if (common_bytes(words, own, others, length) < length).any():
        return None
    tied = np.flatnonzero(head[one][1:] == head[one][:-1])
    if (common_bytes(words, starts[one[tied]], starts[one[tied + 1]], window) < window).any():
        return None
    both = np.union1d(tied, tied + 1)
    rest = [words[starts[one[both]] + max(0, min(at, length - 8))] for at in range(window, length, 8)]
    place = np.arange(len(one))
    # equal windows stand side by side, so their strings change places among themselves
    place[both[np.lexsort((*rest[::-1], head[one[both]]))]] = both
    rank = np.empty(len(starts), np.int64)
    rank[order] = place[kind]
    return rank


def window_hashes(grams: np.ndarray, gram: int, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each start, of the hashes of the grams that cover them."""
    out = np.zeros(len(starts), np.uint64)
    for at in [*range(0, width - gram, gram), width - gram]:
        out = (out ^ grams[starts + at]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def factors_from(raw: np.ndarray, starts: np.ndarray, window: int, length: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``previous_factors`` of the same groups for factors of ``window`` bytes or more; shorter ones may be less.

    Starts whose window stands once have none and are left out; the rest is ordered behind the window only. Starts of
    equal windows must be of one group.
    """
    best, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    gram = 1 << (window.bit_length() - 1)
    grams = gram_hashes(raw, gram)
    head = window_hashes(grams, gram, starts, window)
    order = np.argsort(head)
    same = head[order][1:] == head[order][:-1]
    again = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
    if len(again):
        words, at = words_at(raw), starts[again]
        rank = repeated_ranks(words, head[again], window_hashes(grams, gram, at, length), at, window, length)
        factors, there = previous_factors(raw, at, length, group[again] if rank is None else None, rank, words)
        best[again] = factors
        source[again] = np.where(there >= 0, again[there], -1)
    return best, source


def previous_factors(
    raw: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray | None = None, rank: np.ndarray | None = None, words: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factor at each of the ascending ``starts``, and where it stands (-1 for none).

    With a number of its ``group`` for each start, factors are those of starts of the same group. The starts'
    ``rank`` in suffix order may be given.

    In suffix order, of all earlier starts the previous smaller and the next smaller position share
    the longest prefixes with a suffix; the longer of the two is its factor. Factors are counted up
    to ``length`` bytes, which every start must have behind it. Suffixes alike that far stand by
    falling position, so the next of them is an earlier match.
    """
    words = words_at(raw) if words is None else words
    rank = order_to(raw, length)[starts] if rank is None else rank
    group = np.zeros(len(starts), np.int64) if group is None else group
    key = rank + group * (int(rank.max(initial=0)) + 1)
    order = len(starts) - 1 - np.argsort(key[::-1], kind="stable")
    best = np.zeros(len(starts), np.int64)
    source = np.full(len(starts), -1, np.int64)
    for turn in (order, order[::-1]):
        link = smaller_before(turn)
        here = turn[link >= 0]
        there = turn[link[link >= 0]]
        own = group[here] == group[there]
        here, there = here[own], there[own]
        same = rank[here] == rank[there]
        shared = np.full(len(here), length, np.int64)
        shared[~same] = common_bytes(words, starts[here[~same]], starts[there[~same]], length)
        longer = shared > best[here]
        best[here[longer]] = shared[longer]
        source[here[longer]] = there[longer]
    return best, source


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint runs that don't touch."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    if not len(s):
        return s, e
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[new], e[np.append(new[1:], len(s)) - 1]


def match_bucket(length: int, window: int, keep: str) -> Callable:
    """Rows (h, doc_id, ka, kb, first, last, n, content), sorted, to intervals that are repeats.

    ``f`` is a factor's length; a row of an empty interval notes a span's longest factor under ``length``.
    """
    names = ["doc_id", "ka", "kb", "s", "e", "f"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        # behind a text's end stand bytes that UTF-8 has not, so strings that reach over it are equal only if they end alike
        raw = b"".join(r[7].ljust(r[5] - r[4] + length, b"\xff") for r in rows)
        sizes = np.array([r[5] - r[4] + length for r in rows], np.int64)
        begins = np.cumsum(sizes) - sizes
        many = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), many)
        starts = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + begins[owner]
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1][owner]
        factors, source = factors_from(np.frombuffer(raw, np.uint8), starts, window, length, group)
        factors = np.minimum(factors, (begins + np.array([len(r[7]) for r in rows], np.int64))[owner] - starts)
        repeat = factors >= length
        noted = factors.copy()  # a factor's source holds the same string
        np.maximum.at(noted, source[source >= 0], factors[source >= 0])
        longest = np.maximum.reduceat(noted, np.cumsum(many) - many)
        for i in np.flatnonzero((longest >= LEAST_FACTOR) & (longest < length)):
            out.append((*rows[i][1:4], 0, 0, int(longest[i])))
        if keep == "none":  # the first of equal windows is some later one's source
            repeat[source[repeat]] = True
        hit, who = starts[repeat], owner[repeat]
        bounds = np.searchsorted(who, np.arange(len(rows) + 1))
        for i in np.unique(who):
            at = hit[bounds[i] : bounds[i + 1]] - begins[i] + rows[i][4]
            for s, e in zip(*merged(at, at + length), strict=True):
                out.append((*rows[i][1:4], int(s), int(e), length))
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] == held[-1][:5]:
                    continue  # a row that repeats doc_id and text is the same document
                if held and row[0] != held[-1][0] and size > ORDER_BYTES:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield solve(held)

    return run


def cut_spans(length: int, window: int) -> Callable:
    """Rows (doc_id, ka, kb, text, wanted) to the wanted spans' bytes, or for hot ones hashes of their windows.

    ``windows`` are hashes of the ``length`` bytes from each start, null where the text ends before, ``heads`` of the
    window alone; a long span's come in several rows.
    """

    names = ["h", "doc_id", "ka", "kb", "first", "last", "n", "content", "windows", "heads"]
    kinds = [*[pa.int64()] * 7, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, ka, kb, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for w in wanted:
                    a, b = w["first"], w["last"]
                    for at in range(a, b + 1, WINDOW_ROWS if w["hot"] else b + 1):
                        end = min(b, at + WINDOW_ROWS - 1) if w["hot"] else b
                        part = memoryview(raw)[at : end + length]
                        hashes = [None, None]
                        if w["hot"]:
                            hashes = [[digest(part[i : i + n]) if i + n <= len(part) else None for i in range(end - at + 1)] for n in (length, window)]
                        rows.append((w["h"], doc_id, ka, kb, at, end, w["n"], None if w["hot"] else part.tobytes(), *hashes))
                        held += len(part) if w["hot"] is False else 64 * (end - at + 1)
                        if held > SLICE_BYTES or len(rows) >= 2048:
                            yield made(rows)
                            rows, held = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, ka, kb, text); the key's two hashes tell texts of one doc_id apart."""
    rows = pick(docs, doc_id="bigint", text="string").withColumn("k", text_key(F.col("text")))
    return rows.select("doc_id", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "text")


def join_docs(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, ka, kb), a null doc_id equal to another; ``right``'s keys are dropped."""
    r = right.withColumnsRenamed({"doc_id": "r_id", "ka": "r_a", "kb": "r_b"})
    same = left["doc_id"].eqNullSafe(r["r_id"]) & (left["ka"] == r["r_a"]) & (left["kb"] == r["r_b"])
    return left.join(r, same, how).drop("r_id", "r_a", "r_b")


def repeated_intervals(docs: DataFrame, length: int, keep: str, cap: int = GROUP_CAP, cap_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, ka, kb, cuts, longest): byte intervals [s, e) of documents that are repeats, which may overlap, and the longest factor."""
    spark = docs.sparkSession
    rows = keyed(docs)
    window = min(length, LEAST_FACTOR)
    temporary = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        temporary.append(path)
        return spark.read.schema(df.schema).parquet(path)

    schema = f"{DOC}, h bigint, ca bigint, cb bigint, first bigint, last bigint, stop bigint, several boolean"
    found = stored(rows.filter(F.octet_length("text") >= window).mapInArrow(find_spans(length, window, GRAM), schema), "spans")
    # tables of their own: a join on a frequent anchor can then be split, its count needs no split
    met = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or("several").alias("several"))
    anchors = stored(met.filter("n > 1 OR several").select("h"), "anchors")
    shared = stored(found.join(anchors, "h"), "shared")
    place = F.struct("doc_id", "ka", "kb", "first", "last", "stop")
    distinct = shared.groupBy("h", "ca", "cb").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("r"), F.bool_or("several").alias("several"))
    distinct = stored(distinct.select("h", "ca", "cb", "n", "several", "r.*"), "distinct")

    copies = distinct.filter("n > 1").select(
        "h", "ca", "cb", F.col("doc_id").alias("r_id"), F.col("ka").alias("r_a"), F.col("kb").alias("r_b"), F.col("first").alias("r_first")
    )
    whole = shared.join(copies, ["h", "ca", "cb"])
    enough = F.col("stop") - F.col("first") >= length
    if keep == "first":
        is_first = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("ka") == F.col("r_a")) & (F.col("kb") == F.col("r_b"))
        whole = whole.filter(~(enough & is_first & (F.col("first") == F.col("r_first"))))
    full, none = F.lit(length).cast("bigint").alias("f"), F.lit(0).cast("bigint")
    # copies of under ``length`` bytes, at the ends of texts, are noted and stay
    taken = (F.when(enough, F.col(c)).otherwise(none).alias(out) for c, out in (("first", "s"), ("stop", "e")))
    whole = whole.select("doc_id", "ka", "kb", *taken, F.least(F.col("stop") - F.col("first"), full).alias("f"))

    size = F.sum(F.col("stop") - F.col("first"))
    # a span whose gram stands at several places may repeat within itself, also where it is alone
    groups = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("d"), size.alias("bytes"), F.bool_or("several").alias("several")).filter("d > 1 OR several")
    wanted = distinct.join(stored(groups, "groups"), "h").withColumn("hot", (F.col("d") > cap) | (F.col("bytes") > cap_bytes))
    per_doc = wanted.groupBy("doc_id", "ka", "kb").agg(F.collect_list(F.struct("h", "first", "last", "n", "hot")).alias("wanted"))
    cut = join_docs(rows, per_doc, "inner").select("doc_id", "ka", "kb", "text", "wanted")
    schema = f"h bigint, {DOC}, first bigint, last bigint, n bigint, content binary, windows array<binary>, heads array<binary>"
    cut = stored(cut.mapInArrow(cut_spans(length, window), schema), "cut")
    size = cut.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    columns = ["h", "doc_id", "ka", "kb", "first", "last", "n", "content"]
    buckets = (
        cut.filter("content is not null").select(*columns)
        .repartition(max(1, min(-(-size // BUCKET_BYTES), MOST_BUCKETS)), "h")
        .sortWithinPartitions("h", "doc_id", "ka", "kb", "first")
    )
    parts = whole.unionByName(buckets.mapInArrow(match_bucket(length, window, keep), INTERVAL))
    hot = cut.filter("content is null").dropDuplicates(["h", "doc_id", "ka", "kb", "first"])
    if not hot.isEmpty():
        windows = stored(
            hot.select("h", "doc_id", "ka", "kb", "first", F.posexplode(F.arrays_zip("windows", "heads")).alias("i", "x")).select(
                "h", "doc_id", "ka", "kb", (F.col("first") + F.col("i")).alias("at"), F.col("x.windows").alias("w"), F.col("x.heads").alias("head")
            ),
            "windows",
        )
        again = windows.filter("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "ka", "kb", "at")).alias("r"))
        matched = windows.join(stored(again.filter("n > 1"), "again"), "w")
        if keep == "first":
            matched = matched.filter(F.struct("doc_id", "ka", "kb", "at") != F.col("r"))
        parts = parts.unionByName(
            matched.select("doc_id", "ka", "kb", F.col("at").alias("s"), (F.col("at") + length).alias("e"), full)
        )
        heads = stored(windows.groupBy("h", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "head"), "heads")
        noted = windows.join(heads, ["h", "head"]).select("doc_id", "ka", "kb").distinct()
        parts = parts.unionByName(noted.select("*", none.alias("s"), none.alias("e"), F.lit(window).cast("bigint").alias("f")))
    path = new_path(spark, "intervals")
    cut = F.collect_list(F.when(F.col("e") > F.col("s"), F.struct("s", "e"))).alias("cuts")
    parts.groupBy("doc_id", "ka", "kb").agg(cut, F.max("f").alias("longest")).write.parquet(path)
    for t in temporary:
        drop_path(spark, t)
    return spark.read.schema(f"{DOC}, cuts array<struct<s:bigint,e:bigint>>, longest bigint").parquet(path)


def apply_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, cuts, longest) to what is left of each text and what was taken; ``longest`` goes along."""
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.string()]
    for batch in batches:
        rows = []
        for doc_id, text, cuts in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            raw = text.encode() if text else b""
            s, e = merged(*(np.array([c[k] for c in cuts or []], np.int64) for k in ("s", "e")))
            edges = [0, *(int(x) for pair in zip(s, e, strict=True) for x in pair), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, kept, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*made, batch.column(3)], names=[*names, "longest_factor"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256, longest_factor) for every row of ``docs``.

    ``kept`` is the text's bytes less those that repeats cover; a cut may split a character.
    A null or empty text keeps nothing and loses nothing, nor does one of under ``length`` bytes
    lose any. Rows that repeat doc_id and text are one document to ``keep="first"`` and copies of
    each other to ``keep="none"``. An empty table gives an empty result. ``longest_factor`` is the
    longest factor, up to ``length``, that a string of the text has or is the source of, 0 if it is
    under ``LEAST_FACTOR``; in buckets that are not gathered, a factor under ``length`` shows as
    ``LEAST_FACTOR``, or as the length of a copy that ends a text. One under ``length`` has no part in what is removed.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    cuts = repeated_intervals(docs, length, keep)
    joined = join_docs(keyed(docs), cuts, "left").select("doc_id", "text", "cuts", F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"))
    schema = "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, longest_factor bigint"
    return joined.mapInArrow(apply_cuts, schema)

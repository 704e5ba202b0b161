"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds whole documents: its terms in order, each
term's postings (word positions within the segment, ascending) and the documents' bounds, so
a segment is searched without any other and tasks share nothing. Test phrases bring their
terms; the terms' counts over all segments put each phrase's terms in order from the rarest.
A phrase's candidates are the rarest term's postings less its offset; the next terms' lists,
adjusted by their offsets, are intersected with them one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import drop_path, materialize, new_path, pick, positional, scratch, text_key, text_slices

SEGMENT_BYTES = 4 << 20
#: Words of test items at which windows begin that are searched at once, about; more are taken in further blocks.
BLOCK_WORDS = 100_000
PIECE_WINDOWS = 4_096
WINDOW = 13

SEGMENT = "doc_ids array<bigint>, keys array<struct<a:bigint,b:bigint>>, lengths binary, terms binary, counts binary, positions binary"
VERDICT = "doc_id bigint, key struct<a:bigint,b:bigint>, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
HITS = "seg bigint, ordinal int, doc_id bigint, key struct<a:bigint,b:bigint>, n_words bigint, runs array<struct<s:bigint,e:bigint>>, items array<bigint>"


def word_table() -> bytes:
    """Bytes of words: a-z (A-Z lower-cased), 0-9 and all above 0x7F; others become spaces."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for lo, hi in (b"09", b"az"):
        table[lo : hi + 1] = bytes(range(lo, hi + 1))
    table[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
    return bytes(table)


def words_of() -> Callable[[str | None], list[bytes]]:
    table = word_table()
    return lambda text: text.encode().translate(table).split() if text else []


def index_segments() -> Callable:
    """Rows (doc_id, key, text) to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in text_slices(texts, SEGMENT_BYTES):
                numbers: dict[bytes, int] = {}
                number, ids, lengths = numbers.setdefault, [], []
                for text in texts[start:end]:
                    found = words(text)
                    lengths.append(len(found))
                    ids.append(np.fromiter((number(w, len(numbers)) for w in found), np.int32, len(found)))
                ids = np.concatenate(ids)
                terms = sorted(numbers)
                place = np.empty(len(terms), np.int32)
                place[[numbers[t] for t in terms]] = np.arange(len(terms), dtype=np.int32)
                ids = place[ids] if len(terms) else ids
                counts = np.bincount(ids, minlength=len(terms)).astype("<i4")
                positions = np.argsort(ids, kind="stable").astype("<i4")
                cells = [np.array(lengths, "<i4").tobytes(), b" ".join(terms), counts.tobytes(), positions.tobytes()]
                lists = [pa.array([c.slice(start, end - start).to_pylist()], pa.list_(c.type)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*lists, *(pa.array([c], pa.binary()) for c in cells)],
                    names=["doc_ids", "keys", "lengths", "terms", "counts", "positions"],
                )

    return run


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of all words of ``docs`` to ``path``; the table is searched as often as wanted."""
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", text_key(F.col("text")).alias("key"), "text")
    segments = rows.mapInArrow(index_segments(), SEGMENT).withColumn("seg", F.monotonically_increasing_id())
    segments.write.parquet(path)
    return docs.sparkSession.read.schema(segments.schema).parquet(path)


class Phrases:
    """Distinct phrases as runs of term numbers, with the ids of the items that hold them.

    Phrase p's terms are ``term[first[p] : first[p] + length[p]]``, its items those of
    ``item[item_first[p] : item_first[p + 1]]``; ``order`` has the places of each phrase's terms,
    the rarest first. Arrays of 4 bytes a word, so that a block takes some MB.
    """

    def __init__(self, pieces: list[tuple[int | None, str | None]], window: int | None):
        words = words_of()
        found = [(item_id, w) for item_id, text in pieces if (w := words(text))]
        self.terms = sorted({t for _, w in found for t in w})
        number = {t: i for i, t in enumerate(self.terms)}
        by_width: dict[int, list[tuple[np.ndarray, int | None]]] = {}
        for item_id, w in found:
            ids = np.fromiter((number[t] for t in w), np.int32, len(w))
            width = len(w) if window is None else min(window, len(w))
            by_width.setdefault(width, []).append((np.lib.stride_tricks.sliding_window_view(ids, width), item_id))
        self.groups: list[tuple[int, int]] = []  # (phrases, width), in order
        terms, items, counts = [], [], []
        for width, held in sorted(by_width.items()):
            rows, which = np.unique(np.concatenate([m for m, _ in held]), axis=0, return_inverse=True)
            owner = np.repeat(np.arange(len(held)), [len(m) for m, _ in held])
            known = np.array([i is not None for _, i in held])[owner]
            ids = np.array([i or 0 for _, i in held], np.int64)[owner]
            pairs = np.unique(np.stack([which.ravel()[known], ids[known]]), axis=1)
            self.groups.append(rows.shape)
            terms.append(rows.ravel())
            items.append(pairs[1])
            counts.append(np.bincount(pairs[0], minlength=len(rows)))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.term, self.item = join(terms, np.int32), join(items, np.int64)
        self.length = np.repeat(*np.array([(w, n) for n, w in self.groups], np.int64).reshape(-1, 2).T) if self.groups else np.zeros(0, np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.item_first = np.concatenate([[0], np.cumsum(join(counts, np.int64))])
        self.order = np.zeros_like(self.term)

    def rarest_first(self, counts: np.ndarray) -> None:
        """Order each phrase's terms by their counts over the whole index."""
        at = 0
        for n, width in self.groups:
            rows = self.term[at : at + n * width].reshape(n, width)
            self.order[at : at + n * width] = np.argsort(counts[rows], axis=1, kind="stable").ravel()
            at += n * width


def search_segment(
    phrases: Phrases | SimpleNamespace, terms: pa.Array, counts: np.ndarray, positions: np.ndarray, bounds: np.ndarray, slop: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, document) of every match in a segment.

    ``start`` is where the phrase begins if the rarest term stands in its place. With slop 0 all
    terms stand in their places; else each within ``slop`` words of its place, in that document.
    Phrases whose rarest term the segment lacks are left at once; the other terms are looked up
    for what is left.
    """
    none = np.empty(0, np.int64)
    at = pc.index_in(pa.array(phrases.terms, pa.binary()), value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
    if not len(at) or not len(positions):
        return none, none, none
    rarest = phrases.order[phrases.first]
    alive = np.flatnonzero(at[phrases.term[phrases.first + rarest]] >= 0)
    for r in range(1, int(phrases.length[alive].max(initial=0))):
        used = phrases.length[alive] > r
        here = np.where(used, phrases.first[alive] + r, phrases.first[alive])
        offset = phrases.order[here]
        alive = alive[~used | (at[phrases.term[phrases.first[alive] + offset]] >= 0)]
    if not len(alive):
        return none, none, none
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    n = len(positions)
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * n + positions
    rarest = rarest[alive].astype(np.int64)
    anchor = at[phrases.term[phrases.first[alive] + rarest]]
    many = counts[anchor].astype(np.int64)
    which = np.repeat(np.arange(len(alive)), many)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    here = positions[first[anchor][which] + inside].astype(np.int64)
    phrase, start = alive[which], here - rarest[which]
    doc = np.searchsorted(bounds, here, side="right") - 1
    ok = (start >= bounds[doc]) & (start + phrases.length[phrase] <= bounds[doc + 1]) if not slop else np.ones(len(here), bool)
    phrase, start, doc = phrase[ok], start[ok], doc[ok]
    for r in range(1, int(phrases.length.max(initial=0))):
        if not len(phrase):
            break
        used = r < phrases.length[phrase]
        offset = phrases.order[phrases.first[phrase] + np.where(used, r, 0)].astype(np.int64)
        term = at[phrases.term[phrases.first[phrase] + offset]]
        low = np.maximum(start + offset - slop, bounds[doc])
        high = np.minimum(start + offset + slop, bounds[doc + 1] - 1)
        found = np.searchsorted(keys, term * n + low)
        hit = (found < n) & (low <= high)
        hit &= keys[np.minimum(found, n - 1)] <= term * n + high
        ok = hit | ~used
        phrase, start, doc = phrase[ok], start[ok], doc[ok]
    return phrase, start, doc


def covered_runs(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals as disjoint ascending runs."""
    order = np.argsort(starts, kind="stable")
    runs: list[tuple[int, int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if runs and s <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], e)
        else:
            runs.append((s, e))
    return runs


def segment_arrays(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(n)[i].as_buffer(), "<i4") for n in names]


def search(phrases, slop: int) -> Callable:
    """Segments to one row per document with what the phrases hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = SimpleNamespace(**phrases.value)
        run_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, counts, positions = segment_arrays(batch, i, "lengths", "counts", "positions")
                terms = pa.array(batch.column("terms")[i].as_py().split(), pa.binary())
                bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                # documents without words have no positions of their own; search sees the others
                full = np.flatnonzero(lengths)
                phrase, start, doc = search_segment(
                    wanted, terms, counts, positions, np.concatenate([bounds[full], bounds[-1:]]), slop
                )
                doc = full[doc] if len(doc) else doc
                runs: list[list] = [[] for _ in lengths]
                items: list[list] = [[] for _ in lengths]
                by_doc = np.argsort(doc, kind="stable")
                phrase, start, doc = phrase[by_doc], start[by_doc], doc[by_doc]
                cuts = [*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(doc)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    d = int(doc[a])
                    s = start[a:b] - bounds[d]
                    found = covered_runs(s, s + wanted.length[phrase[a:b]])
                    runs[d] = [{"s": x, "e": y} for x, y in found]
                    held = [wanted.item[wanted.item_first[p] : wanted.item_first[p + 1]] for p in np.unique(phrase[a:b])]
                    items[d] = np.unique(np.concatenate(held)).tolist()
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("seg")[i].as_py()] * n, pa.int64()),
                        pa.array(np.arange(n, dtype=np.int32)),
                        batch.column("doc_ids")[i].values,
                        batch.column("keys")[i].values,
                        pa.array(lengths.astype(np.int64)),
                        pa.array(runs, run_type),
                        pa.array(items, pa.list_(pa.int64())),
                    ],
                    names=["seg", "ordinal", "doc_id", "key", "n_words", "runs", "items"],
                )

    return run


def term_counts(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How often each term stands in the whole index: segments are counted in tasks and summed."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.binary())
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                (counts,) = segment_arrays(batch, i, "counts")
                at = pc.index_in(wanted, value_set=pa.array(batch.column("terms")[i].as_py().split(), pa.binary()))
                here = at.is_valid().to_numpy(zero_copy_only=False)
                total[here] += counts[at.drop_null().to_numpy()]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "n"])

    summed = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # a number per test term, bounded by BLOCK_WORDS
    counts = np.zeros(len(terms), np.int64)
    counts[got["term"].to_numpy()] = got["n"].to_numpy()
    return counts


def item_pieces(tests: DataFrame, window: int | None) -> DataFrame:
    """(item_id, text, windows): items cut into pieces of ``PIECE_WINDOWS`` windows at most, which overlap so that none is lost.

    Repeated rows are dropped first. A whole item is one phrase where ``window`` is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of()
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py())
                width = len(w) if window is None else min(window, len(w))
                for i in range(0, len(w) - width + 1 if width else 0, PIECE_WINDOWS):
                    piece = w[i : i + PIECE_WINDOWS - 1 + width]
                    rows.append((item_id, b" ".join(piece).decode(), len(piece) - width + 1))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item_id", "text", "windows"])

    rows = pick(tests, item_id="bigint", text="string").filter("text is not null").dropDuplicates()
    return rows.mapInArrow(run, "item_id bigint, text string, windows bigint").dropDuplicates(["item_id", "text"])


def phrase_hits(index: DataFrame, tests: DataFrame, window: int | None = WINDOW, slop: int = 0) -> DataFrame:
    """For every indexed document the runs of words that test phrases cover, and the items that hit.

    ``tests`` has (item_id, text); a phrase is ``window`` consecutive words, or a whole item where
    it is shorter or ``window`` is None. Pieces of items are searched in blocks of a bounded number of
    windows, so neither the driver nor a task holds a test set of any size.
    """
    spark = index.sparkSession
    pieces = materialize(item_pieces(tests, window), "pieces")
    size = pieces.agg(F.sum("windows" if window else F.octet_length("text") / 6)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        part = pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        phrases = Phrases([(r["item_id"], r["text"]) for r in part.collect()], window)
        phrases.rarest_first(term_counts(index, phrases.terms))
        hits = index.mapInArrow(search(spark.sparkContext.broadcast(vars(phrases)), slop), HITS)
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("seg", "ordinal", "doc_id", "key", "n_words").agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
    return found


def covered(runs: Column) -> Column:
    """How many words disjoint or overlapping runs cover together."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))

    def add(acc: Column, r: Column) -> Column:
        new = F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], acc["reach"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["reach"], r["e"]).alias("reach"))

    return F.aggregate(F.array_sort(runs), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A document is contaminated if test windows cover one in ``one_in`` of its words or more. Null and
    empty texts have no words and are clean; items without words match nothing; repeated rows
    are judged one by one; items that repeat an id count once, items of a null id cover words
    but are not listed. Empty tables give an empty result or clean documents.
    """
    spark = docs.sparkSession
    path, out = new_path(spark, "index"), new_path(spark, "hits")
    with scratch(spark):
        judged(phrase_hits(build_index(docs, path), tests, window), one_in).write.parquet(out)
    drop_path(spark, path)
    return spark.read.schema(VERDICT).parquet(out)


def judged(hits: DataFrame, one_in: int) -> DataFrame:
    """Counts, items and verdict from runs and items."""
    n_hit = covered(F.col("runs"))
    named = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    rows = hits.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
    )
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def proximity_matches(docs: DataFrame, tests: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id): items all of whose words stand within ``slop`` words of their place, by the rarest one."""
    hits = phrase_hits(build_index(docs, new_path(docs.sparkSession, "index")), tests, None, slop)
    return hits.select("doc_id", F.explode("items").alias("item_id"))


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they were."""
    bad = contamination(docs, tests, window, one_in).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("b_id"), F.col("key").alias("b_key")).distinct()
    plain, names = positional(docs)
    doc_id = F.col(f"c{names.index('doc_id')}").cast("bigint")
    key = text_key(F.col(f"c{names.index('text')}").cast("string"))
    plain = plain.withColumn("_id", doc_id).withColumn("_key", key)
    kept = plain.join(bad, F.col("_id").eqNullSafe(F.col("b_id")) & (F.col("_key") == F.col("b_key")), "left_anti")
    return kept.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)

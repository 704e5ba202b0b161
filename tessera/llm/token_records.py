"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames::

    uint64 length | uint32 masked CRC-32C of those 8 bytes | payload | uint32 masked CRC-32C of the payload | 0x0A
    payload: int64 doc_id | uint8 flags | ids

All numbers are little-endian. Flag 1 marks a null doc_id, flag 2 ids of 4 bytes (2 bytes
otherwise). A mask is a rotation by 15 bits plus 0xa282ead8, so that checksums of data which
holds checksums stay sound. Files are numbered by the range of doc_ids that they hold (part)
and by their place in it (shard); records ascend by doc_id within and across files (null
first). The index is a Parquet table of (part, shard, record, doc_id, offset, length, n_tokens,
local_start, ids_crc32), by which a reader can take records in any order.

Spark's own writer commits the files, so a lost executor's files are written again and never
appear twice, on any file system that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import new_path, pick, text_slices

#: Bytes of text that one task takes, about, until there are this many tasks; then they grow.
PART_BYTES = 16 << 20
MOST_PARTS = 20_000
#: Bytes of text that go into one file, about.
FILE_BYTES = 4 << 20
#: Bytes of text, about, that are encoded and framed, and bytes of frames that are verified, at once.
SLICE_BYTES = 1 << 20
#: Encoded pieces that a worker keeps in each of its two caches.
CACHE_ENTRIES = 260_000
#: Fixed values of the CRC-32C checksum and its mask.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
#: The pattern by which byte-level BPE cuts a text before merging (a fixed value).
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Its classes in the standard library's terms; they agree but for the characters left out.
CLASSES = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d", r"\s": r"\s"}
#: Characters on which libraries' tables of letters and spaces may differ.
UNSURE = r"\x00-\x08\x0e-\x1f\x7f-\xa0\u0300-\u036f\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufe00-\uffff\U00010000-\U0010ffff"

RECORD = "part int, shard int, record int, doc_id bigint, offset bigint, length bigint, n_tokens bigint, local_start bigint, ids_crc32 bigint"


def crc32c_many() -> Callable[[list[bytes]], np.ndarray]:
    """A function from byte strings of 4 bytes or more to their CRC-32C checksums.

    The checksum is linear over bits: a byte's part depends on its value and its distance from
    the end only, so all bytes of a block are looked up at once and blocks are chained.
    """
    block = 512
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), step >> 1).astype(np.uint32)
    part = np.empty((block, 256), np.uint32)  # part[j, b]: byte b that stands j bytes before the end
    part[0] = step
    for j in range(1, block):
        part[j] = step[part[j - 1] & 255] ^ (part[j - 1] >> 8)
    flat = np.ascontiguousarray(part[::-1]).ravel()
    column = np.arange(block, dtype=np.intp) * 256
    chain = []  # chain[k][b]: what byte k of the state becomes after a block
    for k in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(block):
            x = step[x & 255] ^ (x >> 8)
        chain.append(x.tolist())
    c0, c1, c2, c3 = chain

    def run(items: list[bytes]) -> np.ndarray:
        out = np.empty(len(items), np.uint32)
        start = 0
        while start < len(items):
            end, held = start, 0
            while end < len(items) and (end == start or held < 1 << 20):
                held += -(-len(items[end]) // block) * block
                end += 1
            padded = np.zeros(held, np.uint8)
            at, bounds = 0, []
            for x in items[start:end]:
                blocks = -(-len(x) // block)
                first = at + blocks * block - len(x)
                padded[first : at + blocks * block] = np.frombuffer(x, np.uint8)
                padded[first : first + 4] ^= 255
                bounds.append(blocks)
                at += blocks * block
            sums = np.bitwise_xor.reduce(flat[padded.reshape(-1, block) + column], axis=1).tolist()
            at = 0
            for i, blocks in enumerate(bounds, start):
                s = 0
                for x in sums[at : at + blocks]:
                    s = c0[s & 255] ^ c1[s >> 8 & 255] ^ c2[s >> 16 & 255] ^ c3[s >> 24] ^ x
                out[i] = s ^ 0xFFFFFFFF
                at += blocks
            start = end
        return out

    return run


def mask(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def text_encoder(tokenizer: str) -> tuple[Callable[[str], bytes], int]:
    """A function from a text to its ids as bytes, and the bytes of an id (2 or 4).

    Ids are those of the library's ``encode(text, add_special_tokens=False)``. A byte-level BPE
    never merges across the pieces that its pattern cuts, so each piece is encoded once and
    kept; other tokenizers, special tokens and characters on which tables may differ take whole
    texts through the library.
    """
    import json
    import re
    import sys
    from array import array

    import regex
    from tokenizers import Tokenizer

    kept = vars(sys).setdefault("_tessera_encoders", {})  # lives as long as the Python worker
    if tokenizer in kept:
        return kept[tokenizer]
    tk = Tokenizer.from_file(tokenizer)
    width = 2 if tk.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"

    def whole(text: str) -> bytes:
        return np.array(tk.encode(text, add_special_tokens=False).ids, kind).tobytes()

    spec = json.loads(tk.to_str())
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = (
        spec["model"]["type"] == "BPE"
        and spec["normalizer"] is None
        and spec["truncation"] is None
        and spec["padding"] is None
        and byte_level.items() <= (spec["pre_tokenizer"] or {}).items()
    )
    if not plain:
        kept[tokenizer] = whole, width
        return kept[tokenizer]

    specials = [t["content"] for t in spec["added_tokens"]]
    basic_plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    # classes spelled out as ranges, which the standard library looks up in a table
    sets, differ = {}, set()
    for theirs, ours in CLASSES.items():
        held = set(re.findall(ours, basic_plane))
        differ |= set(regex.findall(theirs, basic_plane)) ^ held
        runs: list[list[int]] = []
        for c in sorted(map(ord, held)):
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        sets[theirs] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
    letter, digit, space = (sets[c] for c in CLASSES)
    pattern = BYTE_LEVEL_PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")
    pattern = pattern.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", f"[{space}]")
    odd = re.compile("[" + UNSURE + "".join(map(re.escape, sorted(differ))) + "]")
    cut = re.compile(pattern).findall
    # bytes as the printable characters that a byte-level vocabulary is written in
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    merge = tk.model.tokenize

    numbers = "H" if width == 2 else "I"

    class Pieces(dict):
        """Ids by piece; a full cache stands back as ``older``, from which pieces in use return."""

        older: dict = {}

        def __missing__(self, piece: str) -> bytes:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            found = self.older.get(piece)
            if found is None:
                if piece.isascii() and piece.isprintable():  # all but the space show as they are
                    merged = merge(piece.replace(" ", letters[32]))
                else:
                    merged = merge(piece.encode().decode("latin-1").translate(letters))
                found = array(numbers, [t.id for t in merged]).tobytes()
            self[piece] = found
            return found

    ids_of = Pieces().__getitem__

    sure = bytes(b for b in range(128) if not odd.match(chr(b)))

    def is_odd(text: str) -> bool:
        # bytes that are left of an ASCII text show faster than by a search
        return bool(text.encode().translate(None, sure)) if text.isascii() else odd.search(text) is not None

    def encode(text: str) -> bytes:
        if is_odd(text) or any(s in text for s in specials):
            return whole(text)
        return b"".join(map(ids_of, cut(text)))

    kept[tokenizer] = encode, width
    return kept[tokenizer]


def frames(tokenizer: str, end_id: int | None) -> Callable:
    """Rows (doc_id, text) to framed records, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32c = crc32c_many()
        encode, width = text_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()
        wide = 2 * (width == 4)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for first, last in text_slices(texts.to_numpy(zero_copy_only=False), SLICE_BYTES):
                payloads = [
                    struct.pack("<qB", i or 0, (i is None) | wide) + encode(t.as_py() or "") + end
                    for i, t in zip(ids[first:last], texts.slice(first, last - first), strict=True)
                ]
                heads = [struct.pack("<Q", len(p)) for p in payloads]
                head_sums, sums = mask(crc32c(heads)).tolist(), mask(crc32c(payloads)).tolist()
                out = [
                    b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b)))
                    for h, a, p, b in zip(heads, head_sums, payloads, sums, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def frame_bounds(content: memoryview) -> Iterator[tuple[int, int]]:
    """(offset, payload length) of every frame of a file, by the lengths that the heads give."""
    at = 0
    while at < len(content):
        if at + 12 > len(content):
            raise ValueError(f"broken frame at byte {at}")
        (length,) = struct.unpack_from("<Q", content, at)
        if at + length + 17 > len(content) or content[at + 16 + length] != 0x0A:
            raise ValueError(f"broken frame at byte {at}")
        yield at, length
        at += length + 17


def each_frame(content: memoryview, verify: Callable[[list[bytes]], np.ndarray] | None) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of every frame of a file; raises where a length or a checksum is wrong.

    Frames are verified ``SLICE_BYTES`` at a time, so a file's payloads are never held together.
    """

    def checked(held: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        heads = [bytes(content[at : at + 8]) for at, _ in held]
        head_sums = [struct.unpack_from("<I", content, at + 8)[0] for at, _ in held]
        sums = [struct.unpack_from("<I", content, at + 12 + len(p))[0] for at, p in held]
        good = np.array_equal(mask(verify(heads)), np.array(head_sums, np.uint32))
        if not good or not np.array_equal(mask(verify([p for _, p in held])), np.array(sums, np.uint32)):
            raise ValueError("a checksum doesn't match")
        return held

    held, size = [], 0
    for at, length in frame_bounds(content):
        held.append((at, bytes(content[at + 12 : at + 12 + length])))
        size += length
        if size >= SLICE_BYTES:
            yield from checked(held) if verify else held
            held, size = [], 0
    if held:
        yield from checked(held) if verify else held


def split_frames(content: memoryview, verify: Callable[[list[bytes]], np.ndarray] | None) -> list[tuple[int, bytes]]:
    return list(each_frame(content, verify))


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (part, shard, content) to index rows; every checksum is verified on the way."""
    crc32c = crc32c_many()
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [*[pa.int32()] * 3, *[pa.int64()] * 6]
    for batch in batches:
        for part, shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            rows, start = [], 0
            for record, (offset, payload) in enumerate(each_frame(memoryview(content.as_buffer()), crc32c)):
                doc_id, ids = payload_ids(payload)
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((part, shard, record, doc_id, offset, len(payload) + 17, len(ids), start, crc))
                start += len(ids)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, content) of the data files; a file is of bounded size, save for one huge document."""
    files = spark.read.format("binaryFile").load(f"{path}/data")
    part, shard = (F.regexp_extract("path", r"part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("int") for k in (1, 2))
    return files.select(part.alias("part"), shard.alias("shard"), "content")


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode every text of ``docs`` and write data files and index under ``path``.

    A null or empty text has no ids but ``end_id``; rows that repeat a doc_id stand together,
    in an order fixed by content. ``tokenizer`` is a file that every executor can open. A task
    writes a range of doc_ids as several files of as many records as take ``FILE_BYTES`` of text
    on average.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="bigint", text="string")
    n_rows, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(1, min(-(-(size or 0) // PART_BYTES), MOST_PARTS))
    per_file = max(1, FILE_BYTES * n_rows // max(1, size or 0))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    framed = ordered.select("doc_id", "text").mapInArrow(frames(tokenizer, end_id), "frame binary")
    # the text writer puts a value's bytes as they are and one 0x0A after each
    lines = framed.select(F.col("frame").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", per_file).text(f"{path}/data")
    build_index(spark, path).write.parquet(f"{path}/index")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    return data_files(spark, path).mapInArrow(index_rows, RECORD)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{path}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all records before.

    One task sums a number per part, of which there are ``MOST_PARTS`` at most; the files of each
    part are summed apart.
    """
    totals = index.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_parts"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = totals.select("part", "shard", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_files"))
    joined = index.join(files.join(parts, "part"), ["part", "shard"])
    return joined.withColumn("start", F.col("_parts") + F.col("_files") + F.col("local_start")).drop("_parts", "_files")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(rank, doc_id, ids) in an order that ``seed`` fixes, every record once.

    The index is shuffled, not the data: each file's records are cut out at the offsets that
    the index gives and travel with their place in the order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                rows = []
                for w in wanted:
                    doc_id, ids = payload_ids(bytes(view[w["offset"] + 12 : w["offset"] + w["length"] - 5]))
                    rows.append((w["place"], doc_id, ids.tolist()))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["place", "doc_id", "ids"])

    file = ["part", "shard"]
    index = read_index(spark, path).select(*file, "offset", "length", F.xxhash64(F.lit(seed), *file, "record").alias("place"))
    per_file = index.groupBy(*file).agg(F.collect_list(F.struct("offset", "length", "place")).alias("wanted"))
    records = data_files(spark, path).join(per_file, file).select("content", "wanted")
    return records.mapInArrow(cut, "place bigint, doc_id bigint, ids array<bigint>").orderBy("place", "doc_id")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token records, read the files back.

    (doc_id, start, n_tokens, ids_crc32, part, shard, offset, length).
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_records(docs, path, tokenizer, end_id)
    index = with_starts(read_index(spark, path))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "shard", "offset", "length")

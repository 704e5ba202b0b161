"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; a line that stands in more documents of a host than the
host's limit is boilerplate and is taken off. A document of which too little is left is
rejected, as is one that fails the base rules on its own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, pick

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineLimits:
    """A line may stand in ``docs`` documents of a host, or in ``share`` of them if that is more.

    A document is depleted if fewer than ``min_words`` words are left or if lines above the
    limit held more than ``max_removed`` of its words.
    """

    docs: int = 10
    share: float = 0.001
    min_words: int = 50
    max_removed: float = 0.5


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(words) - width + 1
    key = ids[:n]
    for i in range(1, width):
        # pairs are renumbered, so that the product can't overflow
        _, key = np.unique(key * len(numbers) + ids[i : i + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= again
    return int(covered.sum())


def line_profile() -> Callable:
    """Rows (doc_id, text, host) to the text's own counts and its distinct lines by hash."""
    digits, blanks = re.compile(rb"[0-9]+"), re.compile(rb"[ \t\x0b\x0c\r]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                raw = text.encode()
                words = raw.split()
                spaces = len(raw) - len(raw.translate(None, SPACES))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                seen: set[bytes] = set()
                lines: dict[int, int] = {}
                copies = 0
                for line in raw.split(b"\n"):
                    n = len(line.split())
                    if not n:
                        continue
                    copies += line in seen
                    seen.add(line)
                    plain = blanks.sub(b" ", digits.sub(b"0", line.lower())).strip()
                    h = digest(plain) - (1 << 63)
                    lines[h] = lines.get(h, 0) + n
                rows.append((len(words), len(text) - spaces, symbols, copies, repeated_words(words), list(lines), list(lines.values())))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [*[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *made],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )

    return run


PROFILE = (
    "doc_id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, lines array<bigint>, line_words array<bigint>"
)


def quality_rules(docs: DataFrame, host: str = "source", limits: LineLimits = LineLimits()) -> DataFrame:
    """The profile of every row, words that common lines hold, and the verdict ``kept``.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    removed_words, kept). A null text has no words and fails; rows with a null host form one
    host; rows that repeat a doc_id count once per line, rows with a null doc_id one by one.
    An empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string", **{host: "string"})
    named = F.when(F.col(host).isNull(), "n").otherwise(F.concat(F.lit("h"), F.col(host)))
    profile = rows.select("doc_id", "text", named.alias("host")).mapInArrow(line_profile(), PROFILE)
    profile = materialize(profile.withColumn("row", F.monotonically_increasing_id()), "profile")
    lines = profile.select(
        "row", "doc_id", "host", F.explode(F.arrays_zip(F.col("lines").alias("h"), F.col("line_words").alias("w"))).alias("l")
    ).select("row", "doc_id", "host", "l.h", "l.w")
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.col("row").cast("string")))
    spread = lines.select("host", "h", who.alias("who")).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    hosts = profile.groupBy("host").agg(F.greatest(F.lit(float(limits.docs)), F.count(F.lit(1)) * limits.share).alias("most"))
    common = spread.filter(F.col("n") > limits.docs).join(hosts, "host").filter("n > most").select("host", "h")
    removed = lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("w").alias("removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < limits.min_words) | (F.col("removed_words") > limits.max_removed * F.col("n_words"))
    return (
        profile.drop("lines", "line_words")
        .join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    )

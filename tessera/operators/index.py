"""Prefix search over the inverted token index, catalog filters and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Searchable kinds; fixed values.
KINDS = ("image", "doc", "html", "text", "archive", "ipld", "package")
#: An index row's count weighs this much at most.
COUNT_CAP = 50


def policy(mime: str = "mime", kind: str = "kind") -> Column:
    """not an octet stream (null passes), and of a searchable kind (null does not)."""
    return (F.col(mime).isNull() | (F.col(mime) != "application/octet-stream")) & F.col(kind).isin(*KINDS)


def equality_filters(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """equality on each column that has a value given."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def flag_filters(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """boolean columns by '1' or '0'; any other value filters nothing."""
    for name, value in wanted.items():
        if value in ("0", "1"):
            rows = rows.filter(F.col(name) == (value == "1"))
    return rows


def prefix_match(tokens: Sequence[str], column: str = "token") -> Column:
    """the token starts with one of ``tokens``; a chain that reaches the scan as StringStartsWith."""
    return reduce(lambda a, b: a | b, (F.col(column).startswith(t) for t in tokens), F.lit(False))


def matches(index: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """A1: (cid, matched_tokens, token_score) over index rows, not query tokens: one row counts once."""
    found = index.filter(prefix_match(tokens))
    score = F.sum(F.least(F.col("count"), F.lit(COUNT_CAP))).cast("bigint")
    return found.groupBy("cid").agg(F.count(F.lit(1)).alias("matched_tokens"), score.alias("token_score"))


def first_paths(paths: DataFrame) -> DataFrame:
    """A3: least root, path and MIME hint of every leaf, each on its own."""
    return paths.groupBy(F.col("leaf_cid").alias("cid")).agg(
        F.min("root_cid").alias("root_cid"), F.min("path").alias("path"), F.min("mime_hint").alias("path_mime_hint")
    )


def search(index: DataFrame, catalog: DataFrame, paths: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Matches with their catalog rows under the policy, and a path where there is one.

    Matches are aggregated before any join, so what is shuffled is one row per matching item.
    """
    hits = matches(index, tokens).join(catalog.filter(policy()), "cid")
    return hits.join(first_paths(paths), "cid", "left")


def feed(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """The recency feed, as ``search`` without tokens."""
    return catalog.filter(policy()).join(first_paths(paths), "cid", "left")


def ranked_page(hits: DataFrame, limit: int = 50, offset: int = 0, by_match: bool = True) -> DataFrame:
    """One page in total order; the limit is capped at 200."""
    order = [F.desc("matched_tokens"), F.desc("token_score")] if by_match else []
    order += [F.desc_nulls_last("last_seen_at"), F.asc("cid")]
    return hits.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def has_tag(tags_json: str, tag: str, exact: bool = False, tags: str = "tags") -> Column:
    """a tag in the list (``exact``), or its quoted form anywhere in the document's JSON, case ignored."""
    if exact:
        return F.array_contains(tags, tag)
    # the stored pattern has no escape character, so % and _ in a tag are wild
    pattern = ('%"' + tag + '"%').replace("\\", "\\\\").replace("'", "''")
    return F.expr(f"{tags_json} ILIKE '{pattern}' ESCAPE '~'" if "\\" not in tag else f"{tags_json} ILIKE '{pattern}'")

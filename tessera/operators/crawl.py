"""What the crawler does to the catalog: candidates, directories, expansion, tags of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.detect import content_class
from tessera.functions.hits import TAGS
from tessera.operators import graph, merge

UNCLEAR = ("unknown", "ipld", "dag")
#: Marks of document extractions worth another try; fixed values.
RETRIED = ("doc:sample", "doc:too_large", "doc:full_fetch_failed", "doc:pdf_url_extract_failed")


def mentions(tags_json: Column, *needles: str) -> Column:
    """whether a tags document's text holds one of the strings, case ignored; false for none."""
    low = F.lower(F.coalesce(tags_json, F.lit("")))
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(low, F.lit(n.lower()))
    return found


def needs_crawl(version: str, cutoff: int) -> Column:
    """F8: rows whose type is unknown, outdated or failed, or whose text is worth another try.

    ``cutoff`` is the time before which a document extraction is tried again.
    """
    c, tags = F.col, F.col("tags_json")
    old = c("detector_version").isNull() | (c("detector_version") != version) | c("mime").isNull() | c("error").isNotNull()
    doc = F.coalesce(c("kind") == "doc", F.lit(False))
    epub = F.coalesce(c("ext_guess") == "epub", F.lit(False)) | F.contains(F.lower("mime"), F.lit("epub"))
    failed = mentions(tags, "doc:epub_parse_failed")
    again = tags.isNull() | mentions(tags, *RETRIED)
    return F.coalesce("present", F.lit(False)) & (
        old
        | (F.coalesce(c("kind") == "text", F.lit(False)) & ~mentions(tags, '"preview"'))
        | (doc & mentions(tags, '"description":"PK'))
        | (doc & epub & ~mentions(tags, "doc:epub_text_v2") & ~failed)
        | (doc & again & ~failed & (c("indexed_at").isNull() | (c("indexed_at") < cutoff)))
    )


def skipped_as_directory(is_directory: Column, kind: Column, mime: Column) -> Column:
    """a directory without a clear type is not sampled."""
    k, m = F.coalesce(kind, F.lit("")), F.coalesce(mime, F.lit(""))
    return F.coalesce(is_directory, F.lit(False)) & (k.isin("", *UNCLEAR) | (m == ""))


def likely_directory(kind: Column, source: Column, present_source: Column, depth: Column) -> Column:
    """items without a clear type; below pinned roots also those of which no detector knows."""
    k, s = F.coalesce(kind, F.lit("")), F.coalesce(source, F.lit(""))
    unclear = k.isin("", *UNCLEAR)
    root = F.coalesce(present_source == "pinls", F.lit(False)) & (F.greatest(F.coalesce(depth, F.lit(0)), F.lit(0)) == 0)
    return F.when(root, unclear).otherwise(unclear | (s == ""))


def expansion_candidates(items: DataFrame, max_depth: int, cutoff: int, limit: int) -> DataFrame:
    """present items within the depth that were never expanded, or long ago, or failed, or are unmarked pin roots."""
    c = F.col
    due = (
        c("expanded_at").isNull() | (c("expanded_at") < cutoff) | c("expand_error").isNotNull()
        | (~F.coalesce("is_directory", F.lit(False)) & F.coalesce(c("present_source") == "pinls", F.lit(False)))
    )
    rows = items.filter(c("present") & (c("expand_depth") < max_depth) & due)
    return rows.orderBy(F.desc_nulls_last("last_seen_at"), "cid").limit(limit)


def expand(items: DataFrame, edges: DataFrame, links: DataFrame, batch: DataFrame, now: int, max_children: int) -> tuple[DataFrame, DataFrame]:
    """One level of expansion: the next state of items and of edges.

    ``batch`` has the ids to expand, ``links`` their listings (parent_cid, cid, place). Those that
    aren't likely directories are marked as none. A directory's first ``max_children`` links by
    place become edges and present items one level deeper; links that are gone from a listing that
    isn't empty lose their edge, and an expanded item without a parent its presence.
    """
    asked = items.join(batch.select("cid").distinct(), "cid", "left_semi")
    directory = likely_directory(F.col("kind"), F.col("source"), F.col("present_source"), F.col("expand_depth"))
    opened = asked.filter(directory).select(F.col("cid").alias("parent_cid"), (F.greatest(F.coalesce("expand_depth", F.lit(0)), F.lit(0)) + 1).alias("depth"))
    place = F.row_number().over(Window.partitionBy("parent_cid").orderBy("place", "cid"))
    rows = links.join(opened, "parent_cid").withColumn("n", place)
    sizes = rows.groupBy("parent_cid").agg(F.count(F.lit(1)).alias("size"))
    taken = rows.filter(F.col("n") <= max_children).select("parent_cid", F.col("cid").alias("child_cid"), "depth")
    seen = taken.select("parent_cid", "child_cid").distinct()
    stamped = seen.withColumns({"first_seen_at": F.lit(now).cast("bigint"), "last_seen_at": F.lit(now).cast("bigint")})
    before = merge.upsert_edges(edges, stamped)
    after = merge.prune_edges(before, seen)
    long = F.concat(F.lit("too_many_children:"), "size", F.lit(f" (max={max_children})"))
    marks = asked.select("cid", directory.alias("_dir")).join(sizes.withColumnRenamed("parent_cid", "cid"), "cid", "left")
    marks = marks.select("cid", "_dir", F.when(F.col("_dir") & (F.col("size") > max_children), long).alias("_error"))
    marked = items.join(marks, "cid", "left").withColumns(
        {
            "is_directory": F.coalesce("_dir", "is_directory"),
            "expanded_at": F.when(F.col("_dir").isNotNull(), F.lit(now)).otherwise(F.col("expanded_at")).cast("bigint"),
            "expand_error": F.when(F.col("_dir").isNotNull(), F.col("_error")).otherwise(F.col("expand_error")),
        }
    ).drop("_dir", "_error")
    children = taken.groupBy(F.col("child_cid").alias("cid")).agg(F.min("depth").alias("_depth"))
    grown = marked.join(children, "cid", "full")
    found = F.col("_depth").isNotNull()
    grown = grown.withColumns(
        {
            "present": F.when(found, True).otherwise(F.col("present")),
            "present_source": F.when(found, F.coalesce("present_source", F.lit("expanded"))).otherwise(F.col("present_source")),
            "last_seen_at": F.when(found, F.lit(now)).otherwise(F.col("last_seen_at")).cast("bigint"),
            "expand_depth": F.least("expand_depth", "_depth").cast("int"),
            "removed_at": F.when(~found, F.col("removed_at")).cast("bigint"),
        }
    ).drop("_depth")
    return merge.flip_orphans(grown, before, after, now), after


def tags_document(meta: Column, kind: Column, confidence: Column, tags: Column) -> Column:
    """An item's tags document as JSON: what content analysis found, or a skeleton, with the tags."""
    none = F.array().cast("array<string>")
    skeleton = F.struct(
        none.alias("topics"), content_class(kind).alias("content_class"), F.lit("en").alias("lang"),
        F.coalesce(confidence, F.lit(0.0)).cast("double").alias("confidence"),
        F.struct(none.alias("from"), F.lit(0).cast("bigint").alias("bytes_read")).alias("signals"), tags.alias("tags"),
    )
    named = F.struct(*(F.coalesce(meta[c], skeleton[c]).alias(c) for c in ("topics", "content_class", "lang", "confidence", "signals")), tags.alias("tags"))
    return F.to_json(F.when(meta.isNotNull(), named).otherwise(skeleton))


def site_tags_of_roots(roots: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """(root_cid, topics, tokens, content_class, from, derived_cid, derived_path) for roots whose tags change.

    A root takes its entry page's tags with a mark of where they come from; one that has topics or
    tokens from the same entry stays as it is. ``entries`` has (root_cid, cid, path).
    """
    parsed = items.select("cid", F.from_json("tags_json", TAGS).alias("t"))
    now = parsed.select(F.col("cid").alias("root_cid"), F.col("t").alias("own"))
    page = parsed.select("cid", F.col("t").alias("page"))
    rows = roots.select("root_cid").join(entries, "root_cid").join(now, "root_cid", "left").join(page, "cid", "left")
    filled = (F.coalesce(F.size("own.topics"), F.lit(0)) > 0) | (F.coalesce(F.size("own.tokens"), F.lit(0)) > 0)
    same = F.coalesce((F.col("own.derived_from.cid") == F.col("cid")) & (F.col("own.derived_from.path") == F.col("path")) & filled, F.lit(False))
    none = F.array().cast("array<string>")
    topics = F.filter(F.transform(F.coalesce("page.topics", none), lambda t: F.trim(t)), lambda t: t != "")
    held = F.slice(F.coalesce("page.signals.from", none), 1, 20)
    mark = F.concat(F.lit("dir_entry:"), F.trim("path"))
    marks = F.when(F.array_contains(held, mark), held).otherwise(F.concat(F.array(mark), held))
    return rows.filter(~same).select(
        "root_cid", topics.alias("topics"), F.col("page.tokens").alias("tokens"), F.coalesce(F.nullif("page.content_class", F.lit("")), F.lit("site")).alias("content_class"),
        marks.alias("from"), F.col("cid").alias("derived_cid"), F.col("path").alias("derived_path"),
    )


def entry_updates(paths: DataFrame, listing: DataFrame, current: DataFrame) -> DataFrame:
    """(root_cid, path, cid) for roots whose entry page changes.

    The best page of the path index stands before the best one of the listing; ``current`` has
    (root_cid, entry_path, entry_cid).
    """
    first = graph.entry_pages(paths).select("root_cid", "path", F.col("leaf_cid").alias("cid"))
    scored = listing.withColumn("score", graph.entry_score(F.col("name"))).filter("score IS NOT NULL")
    order = F.struct(-F.col("score"), "name", "cid")
    second = scored.groupBy(F.col("parent_cid").alias("root_cid")).agg(F.min_by(F.struct("name", "cid"), order).alias("b"))
    second = second.select("root_cid", F.col("b.name").alias("l_path"), F.col("b.cid").alias("l_cid"))
    rows = first.join(second, "root_cid", "full").select(
        "root_cid", F.coalesce("path", "l_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("cid")).otherwise(F.col("l_cid")).alias("cid")
    )
    known = rows.join(current, "root_cid", "left")
    same = (clean_path("entry_path") == F.col("path")) & (clean_path("entry_cid") == F.col("cid"))
    return known.filter(~same).select("root_cid", "path", "cid")


def clean_path(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit("")))

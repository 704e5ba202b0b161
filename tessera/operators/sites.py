"""Domains, links and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.hits import entry_path, is_listing_path, is_listing_snippet, is_listing_title, is_name_pointer, pointer_name
from tessera.operators.rank import Cursor, page


def record_id(value: Column) -> Column:
    """The id that a record's value names, in a path or alone."""
    return F.regexp_extract(F.trim(value), r"^(?:/?ip[fn]s/)?([^/?#]+)", 1)


def linked_domain(owners: DataFrame, records: DataFrame) -> DataFrame:
    """(cid, domain): the domain of an owner with a record that names the item.

    Of several, the one with fewer labels, then the first by name.
    """
    named = records.select("owner", "domain", record_id(F.col("record_value")).alias("cid"))
    rows = owners.join(named, (owners.wallet == named.owner) & (owners.cid == named.cid)).select(owners.cid, "domain")
    order = F.struct(F.size(F.split("domain", r"\.")), "domain")
    return rows.groupBy("cid").agg(F.min_by("domain", order).alias("domain"))


def domain_match(domain: Column, tokens: list[str]) -> Column:
    """How much of the first label the tokens cover, and whether one is the extension."""
    label, ext = F.substring_index(domain, ".", 1), F.substring_index(domain, ".", -1)
    covered = F.lit(0)
    for t in tokens:
        covered = covered + F.when(F.contains(label, F.lit(t)), len(t)).otherwise(0)
    share = F.least(covered / F.greatest(F.length(label), F.lit(1)), F.lit(1.0))
    return 0.8 * share + 0.2 * F.when(ext.isin(*tokens) if tokens else F.lit(False), 1.0).otherwise(0.0)


def candidate_sites(records: DataFrame, candidates: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Sites (domain, wallet) with a record that leads to a candidate, each with its best content score.

    A record of an id counts 1.0 if the id is a candidate and 0.85 if it is the parent of one; a
    record of a mutable name, which ``names`` (name, cid) resolves, counts 0.9 and 0.8. Of one
    record the exact match stands before the parent's. ``candidates`` has (cid, score), one row an
    id; the parent hop is an equi-join through the edges. A site's content is its best record's
    score times the coefficient; ``record_type`` and ``root`` are that record's, of equal ones the
    first root by name.
    """
    key, value = F.lower(F.trim(F.coalesce("record_key", F.lit("")))), F.trim("record_value")
    rows = records.select(
        F.col("owner").alias("wallet"), full_domain(F.col("domain"), key).alias("domain"), F.lower(F.trim("domain")).alias("root_domain"),
        ((key == "ipns") | is_name_pointer(value)).alias("pointer"), value.alias("value"),
    )
    site = ["wallet", "domain", "root_domain"]
    ids = rows.filter(~F.col("pointer")).select(*site, record_id(F.col("value")).alias("root"), F.lit("cid").alias("record_type"))
    if names is not None:
        asked = rows.filter("pointer").withColumn("name", pointer_name(F.col("value")))
        found = asked.join(names.select("name", F.col("cid").alias("root")), "name")
        ids = ids.unionByName(found.select(*site, "root", F.lit("ipns").alias("record_type")))
    exact = candidates.select(F.col("cid").alias("root"), F.col("score").alias("exact"))
    wanted = ids.select("root").distinct()
    hops = edges.join(wanted, edges.parent_cid == wanted.root, "left_semi").join(candidates, F.col("child_cid") == candidates.cid)
    hop = hops.groupBy(F.col("parent_cid").alias("root")).agg(F.max("score").alias("below"))
    named = F.col("record_type") == "ipns"
    matched = ids.join(exact, "root", "left").join(hop, "root", "left").filter("exact IS NOT NULL OR below IS NOT NULL")
    matched = matched.withColumn(
        "coefficient",
        F.when(F.col("exact").isNotNull(), F.when(named, 0.9).otherwise(1.0)).otherwise(F.when(named, 0.8).otherwise(0.85)),
    )
    matched = matched.withColumn("content", F.coalesce("exact", "below") * F.col("coefficient"))
    best = F.min_by(F.struct("root", "coefficient", "record_type", "content"), F.struct(-F.col("content"), "root", "record_type")).alias("b")
    return matched.groupBy(*site).agg(best).select("domain", "root_domain", "wallet", "b.content", "b.root", "b.coefficient", "b.record_type")


def full_domain(domain: Column, key: Column) -> Column:
    """A record's key stands before the domain unless it is ``cid``, ``ipns`` or empty."""
    name = F.lower(F.trim(domain))
    return F.when(key.isin("cid", "ipns", ""), name).otherwise(F.concat(key, F.lit("."), name))


def site_scores(sites: DataFrame, tokens: list[str], root_scores: DataFrame | None = None) -> DataFrame:
    """0.7 of the content score over the best one and 0.3 of the domain match, between 0 and 1.

    The best one is that of ``root_scores`` (score) if given, else of the sites. It is one row, an
    aggregate, which joins every site; no window holds them all. Sites without a domain take their
    content's share alone.
    """
    best = root_scores.agg(F.max("score").alias("_most")) if root_scores is not None else sites.agg(F.max("content").alias("_most"))
    rows = sites.crossJoin(F.broadcast(best))  # one row
    share = F.col("content") / F.when(F.col("_most") > 0, F.col("_most")).otherwise(1.0)
    matched = 0.7 * share + 0.3 * domain_match(F.coalesce("domain", F.lit("")), tokens)
    score = F.when(F.col("domain").isNull(), share).otherwise(matched)
    return rows.withColumn("site_score", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6)).drop("_most")


def eligible_sites(sites: DataFrame, entries: DataFrame, children: DataFrame, found_entries: DataFrame) -> DataFrame:
    """The sites that open as a page, with the path to open (null for a site that is one file).

    ``sites`` has (site_id, entry_cid, entry_path, title, snippet); ``entries`` has what is known of an
    entry: (cid, mime, ext_guess, path, is_directory, site_entry_path, content_class, title, snippet);
    ``children`` has (parent_cid, child_cid); ``found_entries`` (root_cid, path) are pages that a
    search below a directory has found. A directory needs an HTML entry; a file must be HTML or
    unknown to the catalog; directory listings are no sites. An entry with children is a directory
    unless it is HTML, whose parts can show as children.
    """
    known = entries.select(*(F.col(c).alias(f"e_{c}") for c in ("cid", "mime", "ext_guess", "path", "is_directory", "site_entry_path", "content_class", "title", "snippet")))
    parents = children.select(F.col("parent_cid").alias("p_cid")).distinct().withColumn("has_children", F.lit(True))
    pages = found_entries.select(F.col("root_cid").alias("f_cid"), F.col("path").alias("found_path"))
    rows = sites.join(known, F.col("entry_cid") == F.col("e_cid"), "left")
    rows = rows.join(parents, F.col("entry_cid") == F.col("p_cid"), "left").join(pages, F.col("entry_cid") == F.col("f_cid"), "left")

    def html_path(c: Column) -> Column:
        return F.when(F.lower(F.trim(c)).rlike(r"\.html?$"), entry_path(c))

    ok = F.col("e_cid").isNotNull()
    ext, mime = F.lower(F.coalesce("e_ext_guess", F.lit(""))), F.lower(F.coalesce("e_mime", F.lit("")))
    is_html = ext.isin("html", "htm") | F.contains(mime, F.lit("text/html")) | F.contains(mime, F.lit("application/xhtml+xml"))
    directory = ok & (F.coalesce("e_is_directory", F.lit(False)) | (F.coalesce("has_children", F.lit(False)) & ~is_html))
    opened = F.coalesce(html_path(F.col("entry_path")), html_path(F.col("e_site_entry_path")), html_path(F.col("found_path")))
    title, snippet = F.coalesce("e_title", "title"), F.coalesce("e_snippet", "snippet")
    has_path = F.coalesce(F.col("e_path") != "", F.lit(False))
    listing = (
        (F.lower(F.trim(F.coalesce("e_content_class", F.lit("")))) == "dir_listing")
        | is_listing_path(title)
        | is_listing_snippet(snippet)
        | (~has_path & is_listing_title(title))
    )
    a_file = ~listing & (is_html | ~ok | F.coalesce(F.lower(F.trim("e_path")).rlike(r"\.html?$"), F.lit(False)))
    keep = F.when(directory, opened.isNotNull()).otherwise(a_file)
    shown = F.when(directory, opened).alias("entry_path")
    return rows.filter(keep).select(*(shown if c == "entry_path" else F.col(c) for c in sites.columns))


def site_page(sites: DataFrame, limit: int, cursor: Cursor | None = None, offset: int = 0) -> DataFrame:
    """The page of eligible sites, by score and id descending; what isn't eligible takes no place.

    ``sites`` has (site_id, site_score) and is filtered before it is paged, so walking on to the next
    eligible site is a plain top-k.
    """
    rows = sites.withColumnsRenamed({"site_score": "score", "site_id": "cid"})
    return page(rows, limit, cursor, offset).withColumnsRenamed({"score": "site_score", "cid": "site_id"})


def domain_ranking(records: DataFrame, pins: DataFrame, tokens: list[str]) -> DataFrame:
    """(domain, roots, score): the domain match and 0.1 for each root of the owner, 0.2 and 1 in all at most; matches alone."""
    per = records.join(pins, records.owner == pins.wallet).groupBy("domain").agg(F.count_distinct("cid").alias("roots"))
    rows = per.withColumn("match", domain_match(F.col("domain"), tokens)).filter("match > 0")
    score = F.least(F.lit(1.0), F.col("match") + F.least(0.1 * F.col("roots"), F.lit(0.2)))
    return rows.select("domain", "roots", F.round(score, 6).alias("score"))


def capped_domains(owners: DataFrame, records: DataFrame, most_wallets: int = 10, most_domains: int = 30) -> DataFrame:
    """(cid, wallet, domain): a root's first wallets and each one's first domains, by name."""
    first = F.row_number().over(Window.partitionBy("cid").orderBy("wallet"))
    wallets = owners.withColumn("k", first).filter(F.col("k") <= most_wallets).drop("k")
    held = records.select("owner", "domain").distinct()
    named = held.withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy("domain"))).filter(F.col("k") <= most_domains)
    return wallets.join(named, wallets.wallet == named.owner).select("cid", "wallet", "domain")

"""Sites: records that lead to candidates, grouping, scores, eligibility and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.operators import rank, sites
from tessera.queries.ranking import RANKED, ranked
from tessera.registry import query

TOKENS = ["nation", "web"]
#: Records of ids and of mutable names, and what the names resolve to.
RECORDS = """recs AS (SELECT 'W' || s_suppkey AS owner, 'D' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '.web' ELSE '.site' END AS domain, ['cid', 'www', 'ipns', ''][CAST(s_suppkey % 4 + 1 AS INTEGER)] AS record_key,
    CASE WHEN s_suppkey % 4 = 2 OR s_suppkey % 5 = 0 THEN 'ipns://name' || (s_suppkey % 40) ELSE CASE WHEN s_suppkey % 3 = 0 THEN '/ipfs/O' || (s_suppkey * 7 % 500) ELSE 'P' || s_suppkey END END AS record_value FROM supplier),
  names AS (SELECT DISTINCT 'name' || (s_suppkey % 40) AS name, CASE WHEN s_suppkey % 40 % 2 = 0 THEN 'P' || (s_suppkey % 40 * 3) ELSE 'O' || (s_suppkey % 40) END AS cid FROM supplier WHERE s_suppkey % 40 < 35),
  cand AS (SELECT 'P' || p_partkey AS cid, round(p_retailprice % 97, 2) AS score FROM part WHERE p_partkey % 3 = 0)"""
SITES = f"""{RECORDS},
  r AS (SELECT owner AS wallet, CASE WHEN record_key IN ('cid', 'ipns', '') THEN lower(domain) ELSE record_key || '.' || lower(domain) END AS domain, lower(domain) AS root_domain, record_key = 'ipns' OR starts_with(record_value, 'ipns://') AS p, record_value AS v FROM recs),
  ids AS (SELECT wallet, domain, root_domain, regexp_replace(v, '^/ipfs/', '') AS root, 'cid' AS record_type FROM r WHERE NOT p
    UNION ALL SELECT wallet, domain, root_domain, n.cid, 'ipns' FROM r JOIN names n ON n.name = replace(v, 'ipns://', '') WHERE p),
  hop AS (SELECT parent_cid AS root, max(score) AS below FROM edges JOIN cand ON child_cid = cid GROUP BY 1),
  m AS (SELECT ids.*, CASE WHEN c.score IS NOT NULL THEN CASE record_type WHEN 'ipns' THEN 0.9 ELSE 1.0 END ELSE CASE record_type WHEN 'ipns' THEN 0.8 ELSE 0.85 END END::DOUBLE AS coefficient, coalesce(c.score, below) AS s
    FROM ids LEFT JOIN cand c ON c.cid = ids.root LEFT JOIN hop USING (root) WHERE c.score IS NOT NULL OR below IS NOT NULL),
  sites AS (SELECT domain, root_domain, wallet, s * coefficient AS content, root, coefficient, record_type FROM (SELECT *, row_number() OVER (PARTITION BY domain, root_domain, wallet ORDER BY s * coefficient DESC, root, record_type) AS k FROM m) WHERE k = 1)"""
WITH = f"WITH edges AS ({b.SQL['edges']}), {SITES}"


def records(spark, d):
    i = F.col("s_suppkey")
    key = F.element_at(F.array(*map(F.lit, ("cid", "www", "ipns", ""))), (i % 4 + 1).cast("int"))
    plain = F.when(i % 3 == 0, F.concat(F.lit("/ipfs/O"), (i * 7 % 500).cast("string"))).otherwise(b.tagged("P", "s_suppkey"))
    value = F.when((i % 4 == 2) | (i % 5 == 0), F.concat(F.lit("ipns://name"), (i % 40).cast("string"))).otherwise(plain)
    domain = F.concat(b.tagged("D", "s_nationkey"), F.when(i % 2 == 0, ".web").otherwise(".site"))
    return b.table(spark, d, "supplier").select(b.tagged("W", "s_suppkey").alias("owner"), domain.alias("domain"), key.alias("record_key"), value.alias("record_value"))


def names(spark, d):
    n = F.col("s_suppkey") % 40
    cid = F.when(n % 2 == 0, F.concat(F.lit("P"), (n * 3).cast("string"))).otherwise(F.concat(F.lit("O"), n.cast("string")))
    return b.table(spark, d, "supplier").filter(n < 35).select(F.concat(F.lit("name"), n.cast("string")).alias("name"), cid.alias("cid")).distinct()


def candidates(spark, d):
    parts = b.table(spark, d, "part").filter("p_partkey % 3 = 0")
    return parts.select(b.tagged("P", "p_partkey").alias("cid"), F.round(F.col("p_retailprice") % 97, 2).alias("score"))


def found(spark, d):
    return sites.candidate_sites(records(spark, d), candidates(spark, d), b.edges(spark, d), names(spark, d))


@query("j7_candidate_sites", f"{WITH} SELECT domain, wallet, round(content, 6) AS content, root, coefficient, record_type FROM sites")
def j7(spark, d):
    return found(spark, d).select("domain", "wallet", F.round("content", 6).alias("content"), "root", "coefficient", "record_type")


@query("r14_site_groups", f"{WITH} SELECT domain, root_domain, count(*) AS wallets, round(max(content), 6) AS best FROM sites GROUP BY ALL")
def r14(spark, d):
    per = found(spark, d).groupBy("domain", "root_domain")
    return per.agg(F.count(F.lit(1)).alias("wallets"), F.round(F.max("content"), 6).alias("best"))


LABEL = "split_part({0}, '.', 1)"
MATCH = "0.8 * least((CASE WHEN contains({l}, 'nation') THEN 6 ELSE 0 END + CASE WHEN contains({l}, 'web') THEN 3 ELSE 0 END) / greatest(length({l}), 1), 1.0) + 0.2 * CASE WHEN regexp_extract({d}, '[^.]*$') IN ('nation', 'web') THEN 1 ELSE 0 END"
SCORED = f"{WITH}, scored AS (SELECT *, CAST(round(greatest(0, least(0.7 * (content / (SELECT max(score) FROM cand)) + 0.3 * ({MATCH.format(l=LABEL.format('domain'), d='domain')}), 1)), 6) AS DOUBLE) AS site_score FROM sites)"


def scored(spark, d):
    return sites.site_scores(found(spark, d), TOKENS, candidates(spark, d))


@query("r12_site_scores", f"{SCORED} SELECT domain, wallet, site_score FROM scored")
def r12(spark, d):
    return scored(spark, d).select("domain", "wallet", "site_score")


ENTRY_INFO = "items AS ({items}), listings AS ({listings})"
ELIGIBLE = f""", h AS (SELECT cid, lower(coalesce(mime, '')) AS m, lower(coalesce(ext_guess, '')) AS e, path, is_directory, j->>'$.title' AS title, coalesce(CASE WHEN kind = 'text' THEN j->>'$.preview' END, j->>'$.description') AS snippet FROM (SELECT *, tags_json::JSON AS j FROM items)),
  kids AS (SELECT DISTINCT parent_cid FROM listings), pages AS (SELECT parent_cid, min(name) AS found_path FROM listings WHERE name LIKE '%.html' GROUP BY 1),
  s AS (SELECT cid AS site_id, CASE WHEN CAST(substr(cid, 5) AS BIGINT) % 9 = 1 THEN 'gone-' || cid ELSE cid END AS entry_cid, CASE WHEN CAST(substr(cid, 5) AS BIGINT) % 5 = 0 THEN '/sub/page.HTML' WHEN CAST(substr(cid, 5) AS BIGINT) % 5 = 1 THEN 'x.txt' END AS entry_path,
    CAST(round((CAST(substr(cid, 5) AS BIGINT) % 13) / 13.0, 6) AS DOUBLE) AS site_score FROM items),
  x AS (SELECT s.*, h.cid IS NOT NULL AS ok, coalesce(h.is_directory, false) AS isdir, k.parent_cid IS NOT NULL AS haskids, coalesce(e IN ('html', 'htm') OR contains(m, 'text/html') OR contains(m, 'application/xhtml+xml'), false) AS html,
    found_path, lower(trim(coalesce(h.title, ''))) AS t, lower(trim(coalesce(h.snippet, ''))) AS n, h.path FROM s LEFT JOIN h ON h.cid = s.entry_cid LEFT JOIN kids k ON k.parent_cid = s.entry_cid LEFT JOIN pages p ON p.parent_cid = s.entry_cid),
  y AS (SELECT *, ok AND (isdir OR (haskids AND NOT html)) AS dir, coalesce(CASE WHEN lower(entry_path) LIKE '%.html' THEN ltrim(entry_path, '/') END, found_path) AS opened,
    regexp_matches(t, '^/?ipfs/') OR contains(n, 'a directory of content-addressed files hosted on') OR (coalesce(path, '') = '' AND (t = 'index of' OR starts_with(t, 'index of '))) AS listing FROM x),
  eligible AS (SELECT site_id, entry_cid, CASE WHEN dir THEN opened END AS entry_path, site_score FROM y WHERE CASE WHEN dir THEN opened IS NOT NULL ELSE NOT listing AND (html OR NOT ok OR coalesce(path LIKE '%.html', false)) END)"""


def eligible(spark, d):
    from tessera.functions import hits

    items, links = hits.projected(b.items(spark, d)), b.listings(spark, d)
    n = F.substring("cid", 5, 20).cast("bigint")
    none = F.lit(None).cast("string")
    asked = items.select(
        F.col("cid").alias("site_id"), F.when(n % 9 == 1, F.concat(F.lit("gone-"), "cid")).otherwise(F.col("cid")).alias("entry_cid"),
        F.when(n % 5 == 0, "/sub/page.HTML").when(n % 5 == 1, "x.txt").alias("entry_path"), none.alias("title"), none.alias("snippet"),
        F.round((n % 13) / 13.0, 6).alias("site_score"),
    )
    known = items.select("cid", "mime", "ext_guess", "path", "is_directory", none.alias("site_entry_path"), none.alias("content_class"), "title", "snippet")
    pages = links.filter("name LIKE '%.html'").groupBy(F.col("parent_cid").alias("root_cid")).agg(F.min("name").alias("path"))
    return sites.eligible_sites(asked, known, links.select("parent_cid", F.col("cid").alias("child_cid")), pages)


@query("r13_eligible_sites", b.with_frames("items listings", ELIGIBLE + " SELECT site_id, entry_cid, entry_path FROM eligible"))
def r13(spark, d):
    return eligible(spark, d).select("site_id", "entry_cid", "entry_path")


@query("t14_site_page", b.with_frames("items listings", ELIGIBLE + " SELECT site_id, site_score FROM eligible WHERE site_score < 0.5 OR (site_score = 0.5 AND site_id < 'z') ORDER BY site_score DESC, site_id DESC LIMIT 15"))
def t14(spark, d):
    rows = eligible(spark, d).select("site_id", "site_score")
    return sites.site_page(rows, 15, rank.Cursor(0.5, "z"))


@query(
    "a13_domain_ranking",
    b.with_frames("domain_records wallet_pins", f""", m AS (SELECT r.domain, count(DISTINCT p.cid) AS roots FROM domain_records r JOIN wallet_pins p ON p.wallet = r.owner GROUP BY 1),
  s AS (SELECT domain, roots, {MATCH.format(l=LABEL.format('domain'), d='domain')} AS match FROM m)
  SELECT domain, roots, CAST(round(least(1.0, match + least(0.1 * roots, 0.2)), 6) AS DOUBLE) AS score FROM s WHERE match > 0"""),
)
def a13(spark, d):
    return sites.domain_ranking(b.domain_records(spark, d), b.wallet_pins(spark, d), TOKENS)


@query(
    "t13_capped_links",
    f"""{RANKED}, domain_records AS ({b.SQL['domain_records']}), best AS (SELECT 'P' || (CAST(substr(cid, 5) AS BIGINT) % 100) AS cid, max(score) AS best FROM scored_hits GROUP BY 1 ORDER BY best DESC, cid DESC LIMIT 40),
  o AS (SELECT DISTINCT cid, wallet FROM wallet_pins WHERE cid IN (SELECT cid FROM best)), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY wallet) AS k FROM o) WHERE k <= 10),
  dm AS (SELECT owner, domain FROM (SELECT owner, domain, row_number() OVER (PARTITION BY owner ORDER BY domain) AS k FROM (SELECT DISTINCT owner, domain FROM domain_records)) WHERE k <= 30)
  SELECT cid, wallet, domain FROM w JOIN dm ON owner = wallet""",
)
def t13_links(spark, d):
    """The 40 best roots of the search (A11), their first ten owners, and those owners' first thirty domains."""
    best = ranked(spark, d).groupBy(F.col("root_cid").alias("cid")).agg(F.max("score").alias("best")).orderBy(F.desc("best"), F.desc("cid")).limit(40)
    wanted = b.wallet_pins(spark, d).join(best.select("cid"), "cid", "left_semi").select("cid", "wallet").distinct()
    return sites.capped_domains(wanted, b.domain_records(spark, d), 10, 30)

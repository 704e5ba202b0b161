"""Predicates and normalisers of hits, names, ids and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.detect import file_extension

#: Shapes of content ids; fixed values.
ID_V0, ID_V1 = "Qm[1-9A-HJ-NP-Za-km-z]{44}", "[bB][a-z2-7]{50,}"
LISTING_PHRASE = "a directory of content-addressed files hosted on"
PDF_SYNTAX = ("pdf", "obj", "endobj", "xref", "linearized")


def clean(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def is_id(x: Column) -> Column:
    """F25."""
    return F.coalesce(F.trim(x).rlike(f"^({ID_V0}|{ID_V1})$"), F.lit(False))


def id_in_value(x: Column) -> Column:
    """a value that is an id, or the id in a path."""
    found = F.regexp_extract(F.trim(x), rf"(?:^|/)({ID_V0}|{ID_V1})(?=$|[/?#])", 1)
    return F.when(found != "", found)


def is_name_pointer(x: Column) -> Column:
    """a mutable name in any of its forms."""
    return F.coalesce(F.trim(x).rlike(r"(?i)^k51[0-9a-z]{10,}$|^ipns://|(?:^|/)ipns/[^/?#]+"), F.lit(False))


def pointer_name(x: Column) -> Column:
    """the name that a pointer's value holds, else the value."""
    raw = F.trim(x)
    scheme = F.regexp_extract(raw, r"(?i)^ipns://(?:ipns/)?([^/?#]+)", 1)
    path = F.regexp_extract(raw, r"(?i)(?:^|/)ipns/([^/?#]+)", 1)
    return F.when(raw == "", F.lit(None)).when(scheme != "", scheme).when(path != "", path).otherwise(raw)


def activity_at(*times: Column) -> Column:
    """The first positive time in epoch milliseconds, else 0."""
    return F.coalesce(*(F.when(t > 0, t) for t in times), F.lit(0)).cast("bigint")


def entry_path(x: Column) -> Column:
    """A relative path without one leading slash; null for an empty or climbing one."""
    p = F.regexp_replace(F.trim(x), "^/", "")
    return F.when((p != "") & ~F.contains(p, F.lit("..")), p)


def display_name(x: Column, most: int = 256) -> Column:
    """P24."""
    name = F.trim(F.regexp_replace(F.regexp_replace(x, "\\x00", ""), r"[\r\n\t]+", " "))
    return F.nullif(F.substring(name, 1, most), F.lit(""))


def resource_type(kind: Column) -> Column:
    """P35."""
    return F.when(clean(kind).isin("site", "image"), clean(kind)).otherwise("all")


def media_type(header: Column) -> Column:
    """A content type without its parameters."""
    return F.nullif(F.lower(F.trim(F.substring_index(header, ";", 1))), F.lit(""))


def contract_metadata(x: Column) -> Column:
    """A JSON object as a map, anything else as an empty one."""
    return F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))


def content_id(x: Column) -> Column:
    """P41."""
    return F.concat(F.lit("cid-sha256-"), F.sha2(x, 256))


def is_listing_title(title: Column) -> Column:
    return (clean(title) == "index of") | clean(title).startswith("index of ")


def is_listing_path(title: Column) -> Column:
    return clean(title).rlike("^/?ipfs/")


def is_listing_snippet(snippet: Column) -> Column:
    return F.contains(clean(snippet), F.lit(LISTING_PHRASE))


def is_listing(title: Column, snippet: Column) -> Column:
    """a directory listing by its title, the path in it, or its snippet."""
    return is_listing_title(title) | is_listing_path(title) | is_listing_snippet(snippet)


def is_html_site(path: Column, title: Column, mime: Column, ext: Column) -> Column:
    """F14."""
    by_path = F.coalesce(entry_path(path).rlike(r"(?i)\.html?$"), F.lit(False))
    kind = F.contains(clean(mime), F.lit("text/html")) | F.contains(clean(mime), F.lit("application/xhtml+xml")) | clean(ext).isin("html", "htm")
    return by_path | (~is_listing_title(title) & F.coalesce(kind, F.lit(False)))


def is_zip_snippet(x: Column) -> Column:
    """packed bytes shown as text."""
    s = F.trim(F.coalesce(x, F.lit("")))
    return s.startswith("PK") | F.lower(s).rlike("mimetypeapplication/epub\\+zip|jfif")


def is_broken_pdf(mime: Column, ext: Column, signals: Column, tokens: Column) -> Column:
    """extraction failed, the sample said little, and no word but PDF syntax is left."""
    pdf = (clean(ext) == "pdf") | F.contains(clean(mime), F.lit("pdf"))
    has = lambda *names: F.coalesce(F.arrays_overlap(F.transform(signals, F.lower), F.array(*map(F.lit, names))), F.lit(False))
    words = F.filter(F.map_keys(tokens), lambda k: ~clean(k).isin("", *PDF_SYNTAX))
    said = F.coalesce(F.size(words) > 0, F.lit(False))
    return pdf & has("doc:pdf_url_extract_failed", "doc:full_fetch_failed") & has("text:head:low_signal", "doc:sample") & ~said


def is_broken_epub(mime: Column, ext: Column, path: Column, title: Column, snippet: Column, signals: Column) -> Column:
    """F18."""
    epub = (clean(ext) == "epub") | F.contains(clean(mime), F.lit("epub")) | clean(path).endswith(".epub")
    has = lambda name: F.coalesce(F.array_contains(F.transform(signals, F.lower), name), F.lit(False))
    empty = (clean(title) == "") & (clean(snippet) == "") & has("doc:sample")
    return epub & (is_zip_snippet(snippet) | has("doc:epub_parse_failed") | empty)


def is_low_signal(path: Column, title: Column, snippet: Column, tokens: Column, topics: Column) -> Column:
    """no path, title or snippet, and labels of several words instead of tokens, or nothing at all."""
    keys = F.filter(F.transform(F.map_keys(tokens), lambda k: F.trim(k)), lambda k: k != "")
    n = F.coalesce(F.size(tokens), F.lit(0))
    phrases = F.size(F.filter(keys, lambda k: k.rlike(r"\s")))
    labels = (F.size(keys) >= 15) & (phrases >= 0.8 * F.size(keys))
    bare = (clean(path) == "") & (clean(title) == "") & (clean(snippet) == "")
    return bare & F.when(n > 0, labels).otherwise(F.coalesce(F.size(topics), F.lit(0)) <= 0)


def explore_type(kind: Column, mime: Column, ext: Column, path: Column, title: Column, snippet: Column, broken: Column) -> Column:
    """what a hit is shown as: image, pdf, epub, html, txt, or nothing.

    ``broken`` says that a PDF, EPUB or text hit isn't fit to be shown (F16, F18, F20).
    """
    m, e, p = clean(mime), clean(ext), clean(path)
    pdf = (e == "pdf") | F.contains(m, F.lit("pdf")) | p.endswith(".pdf")
    epub = (e == "epub") | F.contains(m, F.lit("epub")) | p.endswith(".epub")
    html = e.isin("html", "htm") | p.rlike(r"\.(html|htm|xhtml)$") | F.contains(m, F.lit("text/html")) | F.contains(m, F.lit("application/xhtml+xml"))
    text = (e == "txt") | p.endswith(".txt") | m.startswith("text/plain")
    return (
        F.when((clean(kind) == "image") | m.startswith("image/"), "image")
        .when(pdf, F.when(~broken, "pdf"))
        .when(epub, F.when(~broken, "epub"))
        .when(html, F.when(~is_listing(title, snippet), "html"))
        .when(text, F.when(~broken, "txt"))
    )


#: Words of a PDF's inside that a hit's tokens or snippet show; fixed values.
PDF_WORDS = ("endobj", "xref", "trailer", "stream", "endstream", "xobject", "flatedecode", "mediabox", "cropbox", "resources", "font")


def is_pdf_internal_hit(title: Column, snippet: Column, tokens: Column) -> Column:
    """F16: a hit that shows a PDF's inside: offset tables, or object syntax in its snippet or token counts."""
    t, s = clean(title), clean(snippet)
    both = F.trim(F.concat(t, F.lit("\n"), s))
    offsets = F.regexp_count(both, F.lit(r"\b\d{6,12}\s+\d{5}\s+[nf]\b")) >= 3
    bare = F.length(F.regexp_replace(both, r"[0-9nf\s]", "")) <= 10
    keys = F.coalesce(F.map_keys(tokens), F.array().cast("array<string>"))
    numbers = F.size(F.filter(keys, lambda k: clean(k).rlike(r"^\d{6,12}$"))) >= 8
    count = lambda w: F.coalesce(F.try_element_at(tokens, F.lit(w)), F.lit(0))
    has = {w: (count(w) > 0) | F.contains(s, F.lit(w)) for w in PDF_WORDS}
    score = sum((x.cast("int") for x in has.values()), F.lit(0))
    object_mark = s.rlike(r"\b\d+\s+\d+\s+obj\b") | t.rlike(r"\b\d+\s+\d+\s+obj\b") | (count("obj") >= 2)
    streamed = (has["stream"] | has["endstream"]) & (
        has["flatedecode"] | has["mediabox"] | has["cropbox"] | has["resources"] | has["font"] | has["xobject"]
    )
    syntax = F.when(object_mark, score >= 2).otherwise(streamed & (score >= 3))
    return (offsets & bare) | (F.array_contains(keys, "00000") & (count("00000") != 0) & numbers) | syntax


#: Extensions that keep an octet stream among the hits; fixed values.
RESCUED = ("pdf", "docx", "epub", "html", "htm", "txt")


def is_kept_stream(mime: Column, ext: Column, path: Column) -> Column:
    """anything but an octet stream, or one whose extension or path names a type that can be shown."""
    known = clean(ext).isin(*RESCUED) | clean(path).rlike(r"\.(" + "|".join(RESCUED) + ")$")
    return (clean(mime) != "application/octet-stream") | known


def is_of_strict_type(kind: Column, mime: Column, wanted: Column) -> Column:
    """images only where images are asked for; any other filter lets all pass."""
    image = (clean(kind) == "image") | clean(mime).startswith("image/")
    return ~clean(wanted).isin("image", "images") | image


#: Markup words that are no site tags; fixed values. A deployment adds its own names through the parameter.
TAG_STOP_WORDS = (
    "doctype", "html", "head", "meta", "charset", "viewport", "width", "device", "initial", "scale", "name", "content", "lang",
    "utf", "title", "href", "rel", "link", "stylesheet", "src", "class", "id", "div", "span", "button", "self", "script", "style",
    "http", "https", "www", "com", "gateway",
)


def site_tags(topics: Column, tokens: Column, extra_stop_words: tuple[str, ...] = (), top: int = 50, most: int = 20) -> Column:
    """Topics, then the ``top`` tokens by count and name, without markup words and short ones, each once."""
    stop = (*TAG_STOP_WORDS, *extra_stop_words)
    named = F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: clean(t))
    pairs = F.filter(
        F.transform(F.map_entries(tokens), lambda e: F.struct((-e["value"]).alias("n"), clean(e["key"]).alias("k"))),
        lambda e: (e["k"] != "") & (e["n"] < 0),
    )
    counted = F.transform(F.slice(F.array_sort(pairs), 1, top), lambda e: e["k"])
    words = F.concat(named, F.coalesce(counted, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stop))), 1, most)


#: The parts of a tags document that queries read.
TAGS = (
    "topics array<string>, title string, description string, preview string, content_class string, lang string, confidence double, "
    "tokens map<string,double>, signals struct<from:array<string>,bytes_read:bigint>, tags array<string>, derived_from struct<cid:string,path:string>"
)


def projected(items: DataFrame) -> DataFrame:
    """Hits from catalog rows (``tags_json``, ``kind``, ``cid``, ``root_cid``): topics, title, snippet, root.

    A text's snippet is its preview, else any item's description; a document that isn't JSON counts
    as none.
    """
    rows = items.withColumn("_t", F.from_json("tags_json", TAGS))
    topics = F.filter(F.transform("_t.topics", clean), lambda t: t != "")
    snippet = F.coalesce(F.when(clean(F.col("kind")) == "text", F.col("_t.preview")), F.col("_t.description"))
    root = F.coalesce(F.nullif("root_cid", F.lit("")), F.col("cid")) if "root_cid" in items.columns else F.col("cid")
    return rows.withColumns(
        {
            "topics": F.coalesce(topics, F.array().cast("array<string>")), "tokens": F.col("_t.tokens"),
            "signals": F.col("_t.signals.from"), "title": F.nullif("_t.title", F.lit("")), "snippet": F.nullif(snippet, F.lit("")),
            "root_cid": root, "resource_type": resource_type(F.col("kind")),
        }
    ).drop("_t")


def score_pairs(labels: Column, scores: Column) -> Column:
    """Label and score pairs of two lists, as long as the shorter one; none where a list is missing."""
    n = F.when(labels.isNotNull() & scores.isNotNull(), F.least(F.size(labels), F.size(scores)))
    both = F.transform(F.arrays_zip(labels.alias("label"), scores.alias("score")), lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score")))
    none = F.array().cast("array<struct<label:string,score:double>>")
    return F.when(n > 0, F.slice(both, F.lit(1), n).cast("array<struct<label:string,score:double>>")).otherwise(none)


def is_chunk_list(names: Column, types: Column) -> Column:
    """links that are numbered blocks of one file."""
    named = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    numbered = (F.size(named) > 0) & F.forall(named, lambda n: n.rlike(r"^\d+$"))
    return numbered & ~F.exists(types, lambda t: F.lower(t) == "dir")


def path_suffix(path: Column) -> Column:
    """F32: which of the document types a path ends in, or null."""
    return F.nullif(F.regexp_extract(clean(path), r"\.(docx|epub|pdf|txt)$", 1), F.lit(""))


def has_record_value(values: Column, wanted: Column) -> Column:
    """F33."""
    return F.exists(values, lambda v: F.trim(v) == wanted)


def is_address(x: Column, prefix: str) -> Column:
    """a wallet's syntax."""
    return F.coalesce(F.trim(x).rlike(f"^{prefix}1[0-9a-z]+$"), F.lit(False))


def is_public_v4(ip: Column) -> Column:
    """a unicast address outside of private and link-local ranges."""
    o = F.transform(F.split(F.trim(ip), r"\."), lambda x: F.when(x.rlike(r"^\d{1,3}$"), x).cast("int"))
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    shaped = (F.size(o) == 4) & F.forall(o, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    )
    return F.coalesce(shaped & ~private, F.lit(False))


def is_global_v6(ip: Column) -> Column:
    """F27."""
    s = clean(ip)
    return ~s.isin("", "::", "::1") & ~s.rlike("^(fe80:|fc|fd|ff)") & ~F.contains(s, F.lit("%"))


def is_usable_multiaddress(x: Column) -> Column:
    """A public first hop that isn't a relay."""
    parts = F.filter(F.split(F.trim(x), "/"), lambda p: p != "")
    proto, value = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    named = ~clean(value).isin("", "localhost")
    ok = F.when(proto == "ip4", is_public_v4(value)).when(proto == "ip6", is_global_v6(value)).when(proto.isin("dns", "dns4", "dns6"), named)
    return F.coalesce(F.trim(x).startswith("/") & ~F.contains(F.lower(x), F.lit("/p2p-circuit")) & ok, F.lit(False))


def without_peer(x: Column) -> Column:
    """A multiaddress without its peer suffix."""
    return F.regexp_replace(F.trim(x), "(?i)/p2p/[^/]+$", "")


def is_private_remote(ip: Column) -> Column:
    """a caller from this machine or a private network."""
    plain = F.regexp_replace(F.trim(ip), "^::ffff:", "")
    return F.coalesce(plain.isin("127.0.0.1", "::1") | plain.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"), F.lit(False))


def is_indexed_path(x: Column, extensions: tuple[str, ...]) -> Column:
    """F28."""
    return F.coalesce(file_extension(F.trim(x)).isin(*extensions), F.lit(False))

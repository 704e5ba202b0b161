"""Text, titles and metadata of documents: HTML, XML, office paragraphs, book packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.html import bind, decode_entities

EDGES = r"^\s+|\s+$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, EDGES, "")


def squeeze_lines(text: Column) -> Column:
    """CR as LF, no blanks before LF, two LF at most, single blanks, trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(t, "[ \t]{2,}", " "))


def html_to_text(html: Column) -> Column:
    """Scripts and styles out, line ends where blocks end, tags off, entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</div>|</li>", "\n")
    return squeeze_lines(decode_entities(F.regexp_replace(t, "<[^>]+>", " ")))


def xml_to_text(xml: Column) -> Column:
    """The marks of CDATA off, tags off, entities decoded."""
    t = F.regexp_replace(F.coalesce(xml, F.lit("")), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1 ")
    return squeeze_lines(decode_entities(F.regexp_replace(t, "<[^>]+>", " ")))


def document_title(text: Column, title_most: int = 120, description_most: int = 280) -> Column:
    """Struct (title, description): the first line, and the beginning in single blanks; null for no text."""

    def both(clean: Column) -> Column:
        lines = F.filter(F.transform(F.split(clean, "\n"), trimmed), lambda x: x != "")
        title = trimmed(F.substring(F.get(lines, F.lit(0)), 1, title_most))
        compact = trimmed(F.substring(trimmed(F.regexp_replace(clean, r"\s+", " ")), 1, description_most))
        return F.struct(F.nullif(title, F.lit("")).alias("title"), F.nullif(compact, F.lit("")).alias("description"))

    return bind(squeeze_lines(text), both)


def paragraphs_text(xml: Column) -> Column:
    """P10: the text runs of an office document's paragraphs, a line each; without paragraphs, all text."""
    paras = F.regexp_extract_all(xml, F.lit(r"(?s)<w:p.*?</w:p>"), F.lit(0))
    runs = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"(?s)<w:t[^>]*>(.*?)</w:t>"), F.lit(1)), decode_entities), "")
    lines = F.filter(F.transform(paras, lambda p: trimmed(runs(p))), lambda x: x != "")
    plain = squeeze_lines(decode_entities(F.regexp_replace(xml, "<[^>]+>", " ")))
    return bind(lines, lambda x: F.when(F.size(x) > 0, squeeze_lines(F.array_join(x, "\n"))).otherwise(plain))


def first_tag_text(xml: Column, name: str) -> Column:
    """The text of the first element of a name that has any."""
    bodies = F.regexp_extract_all(xml, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1))
    return F.get(F.filter(F.transform(bodies, xml_to_text), lambda x: x != ""), F.lit(0))


def package_metadata(xml: Column) -> Column:
    """P10: struct (title, description, creator) of a book package, with or without their namespace."""
    found = {n: F.coalesce(first_tag_text(xml, f"dc:{n}"), first_tag_text(xml, n)) for n in ("title", "description", "creator")}
    return F.struct(*(c.alias(n) for n, c in found.items()))


def attribute(tag: Column, name: str) -> Column:
    """An attribute in single or double quotes, decoded; empty where there is none."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"(.*?)"|'(.*?)')"""
    return F.trim(decode_entities(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))))


def resolve_href(package: Column, href: Column) -> Column:
    """P10: a package's link as a path in the archive: decoded, without fragment and query, relative to the package."""
    base = F.regexp_extract(F.regexp_replace(package, r"^/+", ""), r"^(.*)/[^/]*$", 1)
    plain = F.regexp_extract(F.coalesce(F.try_url_decode(F.replace(F.trim(href), F.lit("+"), F.lit("%2B"))), F.trim(href)), r"^([^#?]*)", 1)
    clean = F.regexp_replace(F.regexp_replace(F.translate(plain, "\\", "/"), r"^/+", ""), r"^\./", "")
    joined = F.when(base == "", clean).otherwise(F.concat(base, F.lit("/"), clean))
    steps = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")

    def walk(path: Column, step: Column) -> Column:
        back = F.when((F.size(path) > 0) & (F.element_at(path, -1) != ".."), F.slice(path, 1, F.size(path) - 1)).otherwise(F.concat(path, F.array(step)))
        return F.when(step == "..", back).otherwise(F.concat(path, F.array(step)))

    return F.when(clean != "", F.array_join(F.aggregate(steps, none, walk), "/"))


def spine_files(xml: Column, package: Column) -> Column:
    """P10: the files of a book in reading order: the spine's references through the manifest."""
    part = lambda name: F.regexp_extract(xml, rf"(?is)<{name}\b.*?</{name}>", 0)
    items = F.transform(
        F.regexp_extract_all(part("manifest"), F.lit(r"(?is)<item\b[^>]*?>"), F.lit(0)),
        lambda t: F.struct(attribute(t, "id").alias("id"), attribute(t, "href").alias("href")),
    )
    refs = F.transform(F.regexp_extract_all(part("spine"), F.lit(r"(?is)<itemref\b[^>]*?>"), F.lit(0)), lambda t: attribute(t, "idref"))
    named = bind(F.filter(items, lambda i: (i["id"] != "") & (i["href"] != "")), lambda held: F.transform(
        refs, lambda r: F.try_element_at(F.filter(held, lambda i: i["id"] == r), F.lit(-1))["href"]
    ))
    files = F.transform(F.filter(named, lambda h: h.isNotNull()), lambda h: resolve_href(package, h))
    return F.filter(files, lambda f: f.isNotNull())

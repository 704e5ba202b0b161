"""HTML metadata and readable text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind, squeeze

#: Named entities that are decoded, in order; fixed values.
ENTITIES = (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"))


def code_point(number: Column) -> Column:
    """A character for a code point; a space where there is none."""
    ok = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    # UTF-32 has no decoder here; UTF-16 with surrogates by hand has
    high, low = F.lit(0xD800) + F.floor((number - 0x10000) / 1024), F.lit(0xDC00) + (number - 0x10000) % 1024
    units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    return F.when(ok, F.decode(F.unhex(F.when(ok, units)), "UTF-16BE")).otherwise(F.lit(" "))


def decode_numeric(text: Column, pattern: str, base: int) -> Column:
    """Every numeric reference of ``pattern`` (digits in group 1) replaced by its character."""
    number = lambda x: F.coalesce(F.conv(F.when(F.length(x) <= 10, x), base, 10).cast("bigint"), F.lit(0))

    def decode(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        chars = F.transform(found, lambda x: bind(number(x), code_point))
        both = F.arrays_zip(F.split(t, pattern, -1).alias("piece"), chars.alias("char"))
        joined = F.array_join(F.transform(both, lambda p: F.concat(F.coalesce(p["piece"], F.lit("")), F.coalesce(p["char"], F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&#")), joined).otherwise(t)

    return bind(text, decode)


def decode_entities(text: Column) -> Column:
    """P5: six named entities, then hexadecimal and decimal references."""
    for name, char in ENTITIES:
        text = F.regexp_replace(text, f"(?i)&{name};", char)
    text = decode_numeric(text, "&#[xX]([0-9A-Fa-f]+);", 16)
    return decode_numeric(text, "&#([0-9]+);", 10)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def readable_text(html: Column) -> Column:
    """Comments and script-like blocks out, tags off, entities decoded, tags off again, single spaces."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for block in ("script", "style", "noscript", "svg"):
        text = F.regexp_replace(text, rf"(?is)<{block}.*?</{block}>", " ")
    return squeeze(strip_tags(decode_entities(strip_tags(text))))


def html_attribute(tag: Column, name: str) -> Column:
    """An attribute's value in any quoting; the name may end a longer one, as in ``data-name``."""
    pattern = rf"""(?i){name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    parts = [F.regexp_extract(tag, pattern, i) for i in (2, 3, 4)]
    found = F.trim(F.coalesce(*(F.when(p != "", p) for p in parts)))
    return F.when(found != "", found)


def html_metadata(html: Column) -> Column:
    """Struct (title, description) from <title> and <meta>, the first of each that has text."""
    body = F.regexp_extract(html, r"(?is)<title[^>]*>(.{0,512}?)</title>", 1)
    title = squeeze(decode_entities(strip_tags(body)))
    metas = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)),
        lambda m: F.struct(
            F.lower(F.coalesce(html_attribute(m, "name"), html_attribute(m, "property"))).alias("name"),
            squeeze(decode_entities(html_attribute(m, "content"))).alias("content"),
        ),
    )

    def first(*names: str) -> Column:
        return F.get(F.filter(metas, lambda m: m["name"].isin(*names) & (m["content"] != "")), F.lit(0))["content"]

    named = F.coalesce(F.when(title != "", title), first("og:title", "twitter:title"))
    return F.struct(
        F.substring(named, 1, 200).alias("title"),
        F.substring(first("description", "og:description", "twitter:description"), 1, 300).alias("description"),
    )

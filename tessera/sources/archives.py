"""Archives: names from the directory at the end of a blob, members inflated in tasks, texts of office documents and books.

A ZIP ends in a record that says where its directory stands, so a sample of the tail tells what is inside by the names
of the entries, whatever the entries hold. Members are read where whole bodies are; what they say is column expressions.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.detect import OFFICE
from tessera.functions.docs import document_title, html_to_text, package_metadata, paragraphs_text, resolve_href, spine_files, squeeze_lines

#: Bytes of a member, characters of a text, members of a book that are read; fixed values.
MOST_BYTES, MOST_CHARS, MOST_FILES = 32 << 20, 20_000, 25
#: Extensions of a book's members that can hold text.
TEXTS = ("xhtml", "html", "htm", "txt", "xml")


def pack(entries: dict[str, str], stored: tuple[str, ...] = ()) -> bytes:
    """A ZIP of named texts, the same bytes for the same entries; those ``stored`` are not deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, body in entries.items():
            box.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def names_in_tail(tail: bytes | None, size: int | None) -> list[str] | None:
    """The entries' names if the end record and the whole directory stand in ``tail``, the last bytes of ``size``; else null."""
    if not tail or size is None:
        return None
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(tail):
        return None
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    at, names = offset - (size - len(tail)), []
    if at < 0 or at + length > end:
        return None
    for _ in range(count):
        if tail[at : at + 4] != b"PK\x01\x02":
            return None
        flags = struct.unpack("<H", tail[at + 8 : at + 10])[0]
        n, extra, comment = struct.unpack("<HHH", tail[at + 28 : at + 34])
        names.append(tail[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace"))
        at += 46 + n + extra + comment
    return names


@F.pandas_udf(ArrayType(StringType()))
def entry_names(tail: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([names_in_tail(t, None if pd.isna(n) else int(n)) for t, n in zip(tail, size, strict=True)], dtype=object)


def archive_detect(names: Column) -> Column:
    """P12 by the names of the entries: struct (mime, ext_guess, kind, confidence); null where they are not known."""
    holds = lambda test: F.exists(names, test)
    under = lambda folder: holds(lambda n: n.startswith(folder))
    named = lambda *which: holds(lambda n: F.lower(n).isin(*which))
    ext = (
        F.when(under("word/"), "docx").when(under("xl/"), "xlsx").when(under("ppt/"), "pptx")
        .when(named("mimetype") & named("meta-inf/container.xml"), "epub")
        .when(named("androidmanifest.xml", "classes.dex", "resources.arsc"), "apk").otherwise("zip")
    )
    mime = (
        F.when(ext == "docx", OFFICE + "wordprocessingml.document").when(ext == "xlsx", OFFICE + "spreadsheetml.sheet")
        .when(ext == "pptx", OFFICE + "presentationml.presentation").when(ext == "epub", "application/epub+zip")
        .when(ext == "apk", "application/vnd.android.package-archive").otherwise("application/zip")
    )
    kind = F.when(ext == "epub", "doc").when(ext == "apk", "package").otherwise("archive")
    confidence = F.when(ext == "zip", 0.9).otherwise(0.97)
    return F.when(names.isNotNull(), F.struct(mime.alias("mime"), ext.alias("ext_guess"), kind.alias("kind"), confidence.alias("confidence")))


def members(blobs: DataFrame, *extensions: str, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(key, mark, place, name, text) of the members of ``blobs`` (key, body) with one of the extensions.

    ``mark`` is ok, large (a member of over ``most_bytes``, if given), encrypted or broken. A blob of which no member can be read has
    one row without a name; a null body is broken.
    """

    def read(body: bytes | None) -> Iterator[tuple]:
        try:
            box = zipfile.ZipFile(io.BytesIO(body or b""))
            wanted = [(i, m) for i, m in enumerate(box.infolist()) if not m.is_dir() and m.filename.lower().rpartition(".")[2] in extensions]
        except (zipfile.BadZipFile, ValueError, struct.error, OSError, NotImplementedError):
            yield "broken", None, None, None
            return
        for place, m in wanted:
            if m.flag_bits & 1:
                yield "encrypted", place, m.filename, None
            elif most_bytes is not None and m.file_size > most_bytes:
                yield "large", place, m.filename, None
            else:
                try:
                    with box.open(m) as f:
                        yield "ok", place, m.filename, f.read(most_bytes).decode("utf-8", "replace")
                except Exception:  # a member whose data doesn't inflate or match its sum
                    yield "broken", place, m.filename, None
        if not wanted:
            yield "ok", None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for mark, place, name, text in read(body.as_py()):
                    columns = [pa.array([key]), pa.array([mark]), pa.array([place], pa.int32()), pa.array([name], pa.string()), pa.array([text], pa.string())]
                    columns[0] = columns[0].cast(pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "mark", "place", "name", "text"])

    return blobs.select(F.col("key").cast("string"), "body").mapInArrow(run, "key string, mark string, place int, name string, text string")


def titled(rows: DataFrame, title: Column, description: Column) -> DataFrame:
    """``rows`` (key, mark, text) with title and description: those given, else from the text's beginning."""
    clamp = lambda c, n: F.nullif(F.trim(F.substring(F.trim(c), 1, n)), F.lit(""))
    rows = rows.withColumns({"_t": clamp(title, 120), "_d": clamp(description, 280), "_own": document_title(F.col("text"))})
    return rows.select("key", "mark", "text", F.coalesce("_t", "_own.title").alias("title"), F.coalesce("_d", "_own.description").alias("description"))


def office_texts(blobs: DataFrame) -> DataFrame:
    """P10: (key, mark, text, title, description) of office documents; the text is empty where there is none."""
    found = members(blobs, "xml")
    worst = F.max_by("mark", F.struct((F.col("name") == "word/document.xml"), F.col("mark") != "ok")).alias("mark")
    body = F.max(F.when(F.col("name") == "word/document.xml", F.col("text"))).alias("xml")
    per = found.groupBy("key").agg(worst, body)
    text = F.coalesce(F.substring(paragraphs_text(F.col("xml")), 1, MOST_CHARS), F.lit(""))
    none = F.lit(None).cast("string")
    return titled(per.select("key", "mark", text.alias("text")), none, none)


def book_texts(
    blobs: DataFrame, held: DataFrame | None = None, most_files: int | None = MOST_FILES, most_chars: int | None = MOST_CHARS, most_bytes: int | None = MOST_BYTES
) -> DataFrame:
    """P10: (key, mark, text, title, description) of books: their members in the order of the package's spine.

    The container names the package, else the first one by place is taken. Without a spine the members that can
    hold text come by name. ``most_files`` members and ``most_chars`` characters are read, all of them without such a bound.
    ``held`` are the members, if they are at hand.
    """
    found = held if held is not None else members(blobs, "opf", *TEXTS, most_bytes=most_bytes)
    cut = lambda text: text if most_chars is None else F.substring(text, 1, most_chars)
    found = found.withColumn("low", F.lower("name"))
    at = F.regexp_extract("text", r"(?i)<rootfile\b[^>]*full-path\s*=\s*['\"]([^'\"]+)['\"][^>]*>", 1)
    container = F.max(F.when((F.col("low") == "meta-inf/container.xml") & (at != ""), F.lower(resolve_href(F.lit(""), at))))
    first = F.min_by("low", F.when(F.col("low").endswith(".opf"), F.col("place")))
    mark = F.max_by("mark", F.struct(F.col("mark") != "ok", "mark")).alias("mark")
    books = found.groupBy("key").agg(mark, F.coalesce(container, first).alias("package"))
    package = found.select("key", F.col("low").alias("package"), F.col("name").alias("at"), F.col("text").alias("xml"))
    books = books.join(package, ["key", "package"], "left")
    spine = books.select("key", F.posexplode(F.transform(spine_files(F.col("xml"), F.col("at")), F.lower)).alias("n", "low"))
    looks = F.lower(F.substring("text", 1, 4096)).rlike("<html|<body|<p|xmlns=[\"']http://www\\.w3\\.org/1999/xhtml[\"']")
    body = F.when(F.col("low").endswith(".txt"), squeeze_lines(F.col("text"))).when(~F.col("low").endswith(".xml") | looks, html_to_text(F.col("text")))
    texts = found.filter("mark = 'ok' AND name IS NOT NULL").select("key", "low", body.alias("body"))
    plain = F.col("low").rlike(rf"\.({'|'.join(TEXTS)})$") & ~F.col("low").startswith("meta-inf/")
    listed = spine.join(texts, ["key", "low"])
    others = texts.filter(plain).join(listed.select("key").distinct(), "key", "left_anti").withColumn("n", F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("n", "low", cut(F.col("body")).alias("b"))))
    parts = listed.unionByName(others).groupBy("key").agg((ordered if most_files is None else F.slice(ordered, 1, most_files)).alias("p"))
    said = F.filter(F.transform("p", lambda x: x["b"]), lambda x: x != "")
    # parts are trimmed before they are cut; a blank where a cut falls stays
    joined = parts.select("key", cut(F.array_join(said, "\n")).alias("text"))
    meta = package_metadata(F.col("xml"))
    rows = books.join(joined, "key", "left").withColumns({"m": meta, "text": F.coalesce("text", F.lit(""))})
    return titled(rows, F.col("m.title"), F.col("m.description"))

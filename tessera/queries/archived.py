"""Archives made of the documents' texts: what they are by their directories, and what they say."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.queries.sourcing import SQUEEZED
from tessera.registry import query
from tessera.sources import archives
from tessera.storage import bound_batches

CONTAINER = "<container><rootfiles><rootfile full-path='OEBPS/book.opf' media-type='x'/></rootfiles></container>"


def blobs(spark, d):
    """(key, body): every document's text in an archive: an office document, a book, a plain archive that speaks of others' names, a package, a sheet."""

    def entries_of(kind, text):
        safe = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        if kind == 0:
            lines = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in safe.split("\n"))
            return {"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document>{lines}</w:document>"}
        if kind == 1:
            half = safe.find(" ", len(safe) // 2) if "&" not in safe else len(safe)
            half = half if half >= 0 else len(safe)
            items = "<manifest><item id='b' href='two.xhtml'/><item id='a' href='text/one.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='b'/></spine>"
            pages = {"OEBPS/two.xhtml": safe[half:], "OEBPS/text/one.xhtml": safe[:half]}
            book = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/book.opf": f"<package><metadata><dc:title>Book</dc:title></metadata>{items}</package>"}
            return book | {name: f"<html><body>{part}</body></html>" for name, part in pages.items()}
        return {2: {"notes.txt": "word/ xl/ application/epub+zip classes.dex " + text}, 3: {"AndroidManifest.xml": "x", "a.txt": text}, 4: {"xl/workbook.xml": safe}}[kind]

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = archives.pack(entries_of(doc_id % 5, text or ""), ("mimetype", "notes.txt"))
                yield pa.RecordBatch.from_arrays([pa.array([f"doc-{doc_id}"]), pa.array([body], pa.binary())], names=["key", "body"])

    bound_batches(spark)  # a worker holds texts, archives and tails of some MB, however many rows those are
    return b.table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "key string, body binary")


KINDS = """CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'epub' WHEN 2 THEN 'zip' WHEN 3 THEN 'apk' ELSE 'xlsx' END"""


@query("p12_archive_kinds", f"SELECT 'doc-' || doc_id AS key, {KINDS} AS ext_guess, CASE doc_id % 5 WHEN 1 THEN 'doc' WHEN 3 THEN 'package' ELSE 'archive' END AS kind FROM documents")
def p12(spark, d):
    """By the last 64 KiB of each blob."""
    rows = blobs(spark, d).select("key", F.octet_length("body").cast("bigint").alias("n"), "body")
    tail = F.substring("body", F.greatest(F.col("n") - 65_535, F.lit(1)).cast("int"), F.lit(65_536))
    found = rows.select("key", archives.archive_detect(archives.entry_names(tail, F.col("n"))).alias("x"))
    return found.select("key", "x.ext_guess", "x.kind")


LINES = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@query("p10_office_texts", f"SELECT 'doc-' || doc_id AS key, 'ok' AS mark, substr({SQUEEZED.format(LINES)}, 1, 20000) AS text FROM documents WHERE doc_id % 5 = 0")
def p10_office(spark, d):
    rows = blobs(spark, d).filter(F.substring("key", 5, 20).cast("bigint") % 5 == 0)
    return archives.office_texts(rows).select("key", "mark", "text")


HALF = "CASE WHEN contains(text, '&') OR contains(text, '<') OR contains(text, '>') THEN length(text) WHEN strpos(substr(text, length(text) // 2 + 1), ' ') = 0 THEN length(text) ELSE length(text) // 2 + strpos(substr(text, length(text) // 2 + 1), ' ') - 1 END"


@query(
    "p10_book_texts",
    f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, {HALF} AS n FROM documents WHERE doc_id % 5 = 1),
  s AS (SELECT doc_id, {SQUEEZED.format("substr(text, 1, n)")} AS a, {SQUEEZED.format("substr(text, n + 1)")} AS z FROM h)
  SELECT 'doc-' || doc_id AS key, 'ok' AS mark, 'Book' AS title, a || CASE WHEN a <> '' AND z <> '' THEN chr(10) ELSE '' END || z AS text FROM s""",
)
def p10_books(spark, d):
    rows = blobs(spark, d).filter(F.substring("key", 5, 20).cast("bigint") % 5 == 1)
    return archives.book_texts(rows, most_files=None, most_chars=None, most_bytes=None).select("key", "mark", "title", "text")
